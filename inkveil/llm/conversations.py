"""Operator 13: repair of conversations' structure at the least cost."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: States of the grammar (s?(ua)+)? as bits: nothing read, after s, after u, after a. It may end in the first and the last.
START, AFTER_S, AFTER_U, AFTER_A = 1, 2, 4, 8
ACCEPTING = START | AFTER_A
MOVES = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
FORCED, SHORT = 1, 2
#: Cost layers that are kept above the least one. Any state is at most 7 from the cheapest: two inserts or an insert and a deletion take the one to the other's language.
LAYERS = 8


def _before(initial: str) -> list[int]:
    """For each set of states, the states from which `initial` leads into it."""
    return [sum(a for a, b in MOVES.get(initial, {}).items() if b & into) for into in range(16)]


BEFORE = {r: _before(r) for r in "sua-"}
#: The states from which some u or a, inserted or given by a new role, leads into a set.
BEFORE_ANY = [x | y for x, y in zip(BEFORE["u"], BEFORE["a"])]
KINDS = [(r, f) for r in "sua-" for f in (0, FORCED, SHORT)]


def inserted(layers: list[int]) -> tuple[int, ...]:
    """Layers of states from which the end can be reached, with insertions in front."""
    out: list[int] = []
    for c, own in enumerate(layers):
        out.append(own | (out[c - 1] if c else 0) | (BEFORE_ANY[out[c - INSERT]] if c >= INSERT else 0))
    return tuple(out)


class Layers:
    """Cost layers of suffixes of a conversation.

    Layer c is the bitset of states from which the remaining turns can be brought to an end at a cost of c at most. Layers are kept from the least
    cost on, LAYERS of them, so the work is linear in the turns. Their values are few: each has a number, and each step from one by one kind of turn is done once."""

    def __init__(self) -> None:
        self.values: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.end = self.number(inserted([ACCEPTING] + [0] * (LAYERS - 1)))

    def number(self, layers: tuple[int, ...]) -> int:
        if layers not in self.numbers:
            self.numbers[layers] = len(self.values)
            self.values.append(layers)
        return self.numbers[layers]

    def step(self, at: int, kind: int) -> tuple[int, int]:
        """The number of the layers with a turn of `kind` in front of those of number `at`, and how much the least cost rises."""
        if (at, kind) not in self.steps:
            initial, fault = KINDS[kind]
            after, more = self.values[at], TRUNCATED * (fault == SHORT)
            room = LAYERS + DELETE + TRUNCATED
            get = lambda c: after[min(c, LAYERS - 1)] if c >= 0 else 0  # noqa: E731  beyond the last layer kept nothing new can be best
            raw = [get(c - DELETE) | (0 if fault == FORCED else BEFORE[initial][get(c - more)] | BEFORE_ANY[get(c - REROLE - more)]) for c in range(room)]
            raw = list(inserted(raw))
            least = next(c for c, x in enumerate(raw) if x)
            self.steps[at, kind] = self.number(tuple(raw[least : least + LAYERS])), least
        return self.steps[at, kind]


def repair(kinds: bytes, layers: Layers | None = None) -> tuple[int, str]:
    """Least cost and the ASCII-least audit of that cost of turns given by their numbers in KINDS.

    Layers are built from the last turn to the first; the first layer with the starting state gives the cost. From there the trace takes, among
    the edits that keep to that cost, the least letter: D, I, K, R."""
    layers = layers or Layers()
    own = np.empty(len(kinds) + 1, np.int32)
    rise = np.zeros(len(kinds) + 1, np.int8)
    own[-1] = layers.end
    for i in range(len(kinds) - 1, -1, -1):
        own[i], rise[i] = layers.step(int(own[i + 1]), kinds[i])
    values = layers.values
    state, i, left = START, 0, next(c for c, x in enumerate(values[own[0]]) if x & START)
    cost, out = left + int(rise.sum(dtype=np.int64)), []

    def reaches(i: int, c: int, to: int) -> bool:
        return c >= 0 and to and bool(values[own[i]][min(c, LAYERS - 1)] & to)

    while True:
        # `left` counts from the least cost at turn i; taking the turn moves the count to turn i + 1
        if i < len(kinds):
            initial, fault = KINDS[kinds[i]]
            after, more = left + int(rise[i]), TRUNCATED * (fault == SHORT)
            if reaches(i + 1, after - DELETE, state):
                out.append("D")
                i, left = i + 1, after - DELETE
                continue
        elif left == 0 and state & ACCEPTING:
            return cost, "".join(out)
        to = next((MOVES[r][state] for r in "ua" if state in MOVES[r]), 0)
        if reaches(i, left - INSERT, to):
            out.append("I")
            state, left = to, left - INSERT
        elif fault != FORCED and reaches(i + 1, after - more, MOVES.get(initial, {}).get(state, 0)):
            out.append("K")
            state, i, left = MOVES[initial][state], i + 1, after - more
        else:
            out.append("R")
            state, i, left = to, i + 1, after - more - REROLE


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies): conversations with faults put in by the CRC-32 of `conv_id:turn` modulo 20.

    0 drops a row (copies 0), 1 empties its text, 2 takes `[.!?]` out of it, 3 repeats it (copies 2), 4 gives it the role user. Null ids, turns,
    roles and texts are read as one space there."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(or_space("text"), ".!?", "")).otherwise(or_space("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(k == 4, "user").otherwise(or_space("role")).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
SPACE = " \t\n\x0b\x0c\r"


def _order(turn: Column) -> Column:
    return F.struct(turn.isNotNull().alias("k"), F.coalesce(turn, F.lit(0)).alias("t"))


def _streams(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df` with all rows of a conversation in one task, in order; sorting spills, and what reads them takes batches."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *keys)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)


def audits(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of rows like those of damaged(), one for each conv_id.

    Turns are taken by turn, nulls first, then by role and the MD5 of the text. Only these and the kinds of faults are moved here, equal ones once
    with their number. Turns seen before in a conversation are found by an aggregation over (conv_id, role, MD5), so no task holds a set of
    a conversation's texts; what a conversation holds in its task is a few bytes a turn, of the size of its audit."""
    text = F.col("text")
    bare = F.rtrim(text, F.lit(SPACE))
    fault = F.when(bare == "", "b").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    light = rows.select("conv_id", "turn", "role", F.md5(text.cast("binary")).alias("digest"), fault.alias("fault"), "copies").groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("copies"))
    firsts = light.filter("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(_order(F.col("turn"))).alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    marked = light.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    marked = marked.select("conv_id", "turn", F.substr("role", F.lit(1), F.lit(1)).alias("initial"), "fault", "copies", F.coalesce(_order(F.col("turn")) > F.col("first"), F.lit(False)).alias("seen"), "role", "digest")
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in FIGURES), ("audit", pa.string())])
    numbers = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = Layers()

        def done(conv, kinds: bytearray, n: dict, turns: tuple) -> tuple:
            low, high, distinct = turns
            cost, audit = repair(bytes(kinds), layers)
            return conv, high - low + 1 - distinct if distinct else 0, n["b"], n["d"], n["t"], n["i"], cost, audit

        def each() -> Iterator[tuple]:
            conv, kinds, n, turns, before = None, None, {}, (None, None, 0), ""
            for c, turn, initial, fault, copies, seen in _rows(batches):
                if kinds is None or c != conv:
                    if kinds is not None:
                        yield done(conv, kinds, n, turns)
                    conv, kinds, n, turns, before = c, bytearray(), dict.fromkeys("bdti", 0), (None, None, 0), None
                if not copies:
                    continue
                if turn is not None:
                    low, high, distinct = turns
                    turns = (turn, turn, 1) if low is None else (low, turn, distinct + (turn != high))
                for k in range(copies):
                    f = fault if fault == "b" else "d" if seen or k else fault
                    if f:
                        n[f] += 1
                    n["i"] += before is not None and before + initial not in ("su", "ua", "au")
                    before = initial
                    kinds.append(numbers[initial if initial in ("s", "u", "a") else "-", FORCED if f in ("b", "d") else SHORT if f else 0])
            if kinds is not None:
                yield done(conv, kinds, n, turns)

        yield from _batches(each(), schema)

    cols = ["conv_id", "turn", "initial", "fault", "copies", "seen"]
    return _streams(marked, ["turn", "role", "digest"]).select(*cols).mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in FIGURES) + ", audit string")


def repairs(rows: DataFrame) -> DataFrame:
    """The rows of audits() with `repaired_sha256`, of the repaired conversation as lines `role:text`.

    The texts of a conversation pass through one task in order behind its audit and are hashed one by one; they are never held together."""
    found = audits(rows)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    heads = found.select("conv_id", F.lit(0).alias("k"), none("turn", "long"), none("role", "string"), none("digest", "string"), none("text", "string"), F.lit(1).alias("copies"), *FIGURES, "audit")
    body = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("k"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "text", "copies", *(none(c, "long") for c in FIGURES), none("audit", "string"))
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in FIGURES), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Repaired:
            def __init__(self, head: tuple) -> None:
                self.head, self.audit, self.at, self.state, self.sha, self.empty = head, head[-1], 0, START, hashlib.sha256(), True

            def line(self, initial: str, role: str, text: str) -> None:
                self.state = MOVES[initial][self.state]
                self.sha.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                self.empty = False

            def next_initial(self) -> str:
                return "a" if self.state == AFTER_U else "u"

            def insertions(self) -> None:
                while self.at < len(self.audit) and self.audit[self.at] == "I":
                    self.at += 1
                    r = self.next_initial()
                    self.line(r, ROLES[r], "")

            def take(self, role: str, text: str) -> None:
                self.insertions()
                edit = self.audit[self.at]
                self.at += 1
                if edit == "K":
                    self.line(role[:1], role, text)
                elif edit == "R":
                    r = self.next_initial()
                    self.line(r, ROLES[r], text)

            def done(self) -> tuple:
                self.insertions()
                return *self.head, self.sha.hexdigest()

        def each() -> Iterator[tuple]:
            now = None
            for conv, k, role, text, copies, *figures in _rows(batches):
                if not k:
                    if now:
                        yield now.done()
                    now = Repaired((conv, *figures))
                else:
                    for _ in range(copies):
                        now.take(role, text)
            if now:
                yield now.done()

        yield from _batches(each(), schema)

    both = heads.unionByName(body)
    return _streams(both, ["k", "turn", "role", "digest"]).select("conv_id", "k", "role", "text", "copies", *FIGURES, "audit").mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in FIGURES) + ", audit string, repaired_sha256 string")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired conversations of the damaged table; nulls: see damaged(). Conversations of which no row is left give zeros, an empty audit and the hash of nothing."""
    return repairs(damaged(table(spark, sf_dir, "conversations")))
