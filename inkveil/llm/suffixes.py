"""Operator 9: exact substring dedup by a distributed merge sort of suffixes that never compares known prefixes again."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, probable, table

#: Bytes of a repeated string.
LENGTH = 400
#: Bytes of the seed by which suffixes are chosen; every string of LENGTH bytes has SEEDS of them.
SEED = 150
SEEDS = LENGTH - SEED + 1
#: Bytes to the left or to the right of a seed of which a string over it holds at least one whole.
SIDE = (LENGTH - SEED) // 2
#: Suffixes of one merge, and the most merges, which bounds the splitters that are broadcast.
MERGE, MOST_MERGES = 50_000, 200_000
#: Suffixes that a task sorts at a time.
RUN = 20_000
#: Keys from which a merge's splitter is taken, and the most keys that the driver sees.
SAMPLES, MOST_SAMPLES = 32, 800_000

_rng = np.random.default_rng(20240229)
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 17)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over each `width` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x = pick(x[: len(x) - size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def thinned(raw: bytes, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The seeds to keep of those at `at` with hashes `h`, and stretches (start, end) of a text that repeat themselves.

    Equal seeds at equal distances q of SEED at most lie in a stretch of period q. In a stretch of LENGTH + 2q bytes or more, every string of LENGTH bytes starts
    again q bytes later or earlier, so the stretch is removed and nothing need be looked up for strings within it. A string over its
    left end holds the first of these seeds, one over its right end the last; an equal string elsewhere has the same end and holds the same one. A
    string within a shorter stretch of another text equals one here that has the second seed where it has its own first. So these three are kept."""
    order = np.lexsort((at, h))
    p, same = at[order], h[order][1:] == h[order][:-1]
    step = np.where(same, np.diff(p), 0)
    drop, stretches = np.zeros(len(at), bool), []
    starts = np.nonzero((step > 0) & (step <= SEED) & (np.append(0, step[:-1]) != step))[0]
    for i in starts.tolist():
        q, j = int(step[i]), i
        while j < len(step) and step[j] == q:
            j += 1
        a, b = int(p[i]), int(p[j]) + SEED
        while a > 0 and raw[a - 1] == raw[a - 1 + q]:
            a -= 1
        while b < len(raw) and raw[b] == raw[b - q]:
            b += 1
        if b - a >= LENGTH + 2 * q:
            drop[order[i + 2 : j]] = True
            stretches.append((a, b))
    return ~drop, np.array(stretches, np.int64).reshape(-1, 2)


def seeds(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the seeds of a text that are least in some string of LENGTH bytes, and hashes of each with SIDE bytes more to the left and to the right (0: there aren't so many); stretches of thinned().

    Equal strings have equal least seeds at equal places, wherever they stand. All of equally small seeds are taken, but in periodic stretches (see thinned). A
    string of LENGTH bytes over a seed holds SIDE bytes to its left or to its right, so one of the hashes recurs with it."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    up, down = _power(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_LETTER[np.frombuffer(raw, np.uint8)] * down)])
    h = _mix((sums[SEED:] - sums[:-SEED]) * up[: n - SEED + 1])
    least = _slide(h, SEEDS, np.minimum)
    pad = np.zeros(SEEDS - 1, np.uint64)
    at = np.nonzero(_slide(np.concatenate([pad, least, pad]), SEEDS, np.maximum) == h)[0]
    keep, stretches = thinned(raw, at, h[at])
    at = at[keep]

    def wide(start: np.ndarray, kind: int) -> np.ndarray:
        ok = (start >= 0) & (start + SEED + SIDE <= n)
        a = start[ok]
        out = np.zeros(len(at), np.uint64)
        out[ok] = _mix((sums[a + SEED + SIDE] - sums[a]) * up[a] + np.uint64(kind)) | np.uint64(1)
        return out

    return at, wide(at - SIDE, 1), wide(at, 2), stretches


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of a and b, of which `start` bytes are known to be equal."""
    n, step = min(len(a), len(b)), 32
    while start < n:
        x, y = a[start : start + step], b[start : start + step]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m]) ^ int.from_bytes(y[:m])
            return start + m - (d.bit_length() + 7) // 8
        start += step
        step *= 2
    return n


def front_code(keys: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A sorted run as the bytes in which each key differs from the one before, the shared lengths and the lengths."""
    shared = np.zeros(len(keys), np.int32)
    for i in range(1, len(keys)):
        shared[i] = common_prefix(keys[i - 1], keys[i])
    return b"".join(k[s:] for k, s in zip(keys, shared.tolist())), shared, np.array([len(k) for k in keys], np.int32)


def decode(rest: bytes, shared: list[int], sizes: list[int]) -> Iterator[tuple[int, bytes]]:
    key, at = b"", 0
    for s, n in zip(shared, sizes):
        key = key[:s] + rest[at : at + n - s]
        at += n - s
        yield s, key


def merge(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """Loser tree over sorted front-coded runs: (common prefix with the key before, run, key) in order.

    A key carries the length of the prefix that it is known to share with the last key given out. Of two keys the one with
    the longer such prefix is smaller, without a look at either; if they are equal, the comparison starts behind it."""
    size = 1 << max(0, (len(runs) - 1).bit_length())
    key: list[bytes | None] = [None] * size
    known = [0] * size
    for i, r in enumerate(runs):
        known[i], key[i] = next(r, (0, None))
    losers = [0] * size

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix is then that with the winner."""
        if key[i] is None or key[j] is None:
            return (j, i) if key[i] is None else (i, j)
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        a, b = key[i], key[j]
        m = common_prefix(a, b, known[i])
        w, x = (i, j) if a[m:] < b[m:] or a[m:] == b[m:] and i < j else (j, i)
        known[x] = m
        return w, x

    def build(node: int) -> int:
        if node >= size:
            return node - size
        w, losers[node] = play(build(2 * node), build(2 * node + 1))
        return w

    for i in range(size):
        known[i] = 0
    top = build(1)
    while key[top] is not None:
        yield known[top], top, key[top]
        known[top], key[top] = next(runs[top], (0, None)) if top < len(runs) else (0, None)
        node = (top + size) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def spans_of(lcp: np.ndarray, sizes: np.ndarray, left: np.ndarray, left_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in order, the least and the most bytes o before a suffix (SEEDS: none) at which a string of LENGTH bytes starts that another of these suffixes has at the same o.

    lcp: common prefix with the suffix before; left: the bytes before each suffix, nearest first."""
    n = len(lcp)
    low, high = np.full(n, SEEDS), np.full(n, -1)
    hashed = np.zeros(n, np.uint64)
    for o in range(SEEDS):
        if o:
            hashed = hashed * _BASE + _LETTER[left[:, o - 1]]
        ok = np.nonzero((left_sizes >= o) & (sizes >= LENGTH - o))[0]
        if len(ok) < 2:
            continue
        group = np.cumsum(lcp < LENGTH - o).astype(np.uint64)
        key = _mix(hashed[ok] + group[ok] * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key)
        equal = key[order][1:] == key[order][:-1]
        hit = np.zeros(len(ok), bool)
        hit[order[1:]] = equal
        hit[order[:-1]] |= equal
        hit = ok[hit]
        low[hit] = np.minimum(low[hit], o)
        high[hit] = o
    return low, high


def _edge_strings(right: list[bytes], reach: np.ndarray, left: np.ndarray, left_sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(o, members, hashes): the strings that start o bytes before each suffix, by 64-bit hashes, each distinct one once.

    reach: bytes that a suffix can share with any suffix of another merge, i.e. shares with the splitter between them."""
    block = np.zeros((len(right), LENGTH), np.uint8)
    for i, x in enumerate(right):
        block[i, : len(x)] = np.frombuffer(x, np.uint8)
    up, _ = _power(LENGTH + 1)
    total = np.zeros((len(right), SEEDS), np.uint64)  # hash of the first LENGTH - o bytes
    rolling = np.zeros(len(right), np.uint64)
    for j in range(LENGTH):
        rolling = rolling * _BASE + _LETTER[block[:, j]]
        if j + 1 >= SEED:
            total[:, LENGTH - j - 1] = rolling
    before = np.zeros(len(right), np.uint64)
    for o in range(SEEDS):
        if o:
            before = before + _LETTER[left[:, o - 1]] * up[o - 1]
        ok = np.nonzero((left_sizes >= o) & (reach >= LENGTH - o))[0]
        if len(ok):
            h, first = np.unique(_mix(before[ok] * up[LENGTH - o] + total[ok, o]), return_index=True)
            yield o, ok[first], h


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed), one for each row of `docs`; removed: array of (start, length).

    A byte is removed if a LENGTH-byte string over it starts anywhere else too. Texts with copies are removed whole from
    LENGTH bytes on. Of distinct texts, only suffixes at seeds are sorted, at which every such string has one: a seed
    that occurs once only with the SIDE bytes to its left, and once with those to its right, isn't in a repeat. Tasks sort suffixes into front-coded runs; runs go to merges by sampled
    splitters, which stand between seeds unless a seed alone has more than a merge; then ties are split by text and place, so
    a very common suffix doesn't gather in one merge. In a merge's order,
    shared prefixes are known, and the bytes before the suffixes complete the strings. A class of suffixes that may
    go on in another merge sends its distinct strings' hashes to be counted over all merges.

    Null texts are empty; texts shorter than LENGTH stay. Null and repeated ids keep their rows.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("sha", F.sha2(F.col("t").cast("binary"), 256))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raws = [t.encode("utf-8", "replace") for t in pdf["t"]]
            found = [seeds(r) for r in raws]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "sha": pdf["sha"], "n_bytes": [len(r) for r in raws], "at": [x[0] for x in found], "l": [x[1].view(np.int64) for x in found], "r": [x[2].view(np.int64) for x in found], "own": [[{"start": a, "end": b} for a, b in x[3].tolist()] for x in found]})

    spans_type = "array<struct<start:long,end:long>>"
    all_docs = cut(src.mapInPandas(find, f"doc_id long, sha string, n_bytes long, at array<int>, l array<long>, r array<long>, own {spans_type}"), "seeds")
    texts = all_docs.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("at", "l", "r", "own")))
    texts = cut(texts.filter(F.size("at") > 0).withColumn("uid", F.monotonically_increasing_id()), "texts")
    flat = texts.select("uid", F.explode(F.arrays_zip("at", "l", "r")).alias("x")).select("uid", "x.at", F.explode(F.array("x.l", "x.r")).alias("h")).filter("h <> 0")
    # written first, so that the join's partitions can be split where a key is very common
    often = cut(flat.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "often")
    places = probable(flat, "h", often).join(often, "h").select("uid", "at").distinct().groupBy("uid").agg(F.collect_list("at").alias("at"))
    chosen = texts.select("uid", "sha", "doc_id", "own").join(places, "uid", "left").filter("at is not null or size(own) > 0")
    chosen = cut(chosen.select("uid", F.col("sha").alias("kind"), F.col("doc_id").alias("rep"), "own", F.coalesce("at", F.array().cast("array<int>")).alias("at")), "chosen")
    # a text's copies stay where they are, but for the one that stands for them (and rows that repeat its id)
    pick = probable(src, "sha", chosen.select(F.col("kind").alias("sha"))).join(chosen, (F.col("sha") == F.col("kind")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    cand = cut(pick.dropDuplicates(["uid"]).select("uid", "sha", "t", "at"), "candidates")
    total = cand.agg(F.sum(F.size("at"))).first()[0] or 0

    def keyed(pdf: pd.DataFrame) -> Iterator[tuple[bytes, bytes, int]]:
        for uid, text, at in zip(pdf["uid"], pdf["t"], pdf["at"]):
            raw = text.encode("utf-8", "replace")
            for p in at.tolist():
                right = raw[p : p + LENGTH]
                yield right + int(uid).to_bytes(8) + int(p).to_bytes(4), raw[max(0, p - SEEDS + 1) : p], len(right)

    merges = max(1, min(MOST_MERGES, -(-total // MERGE)))
    splitters: list[bytes] = []
    if merges > 1:
        one_in = max(1, total // min(merges * SAMPLES, MOST_SAMPLES))

        def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"k": [k for k, *_ in keyed(pdf) if int.from_bytes(hashlib.blake2b(k[-12:], digest_size=8).digest()) % one_in == 0]})

        got = sorted(bytes(r[0]) for r in cand.mapInPandas(sample, "k binary").collect())
        # merges meet between seeds, but for seeds of which there is more than one merge
        marks = [got[i * len(got) // merges] for i in range(1, merges)] if got else []
        splitters = sorted({m if i and m[:SEED] == marks[i - 1][:SEED] else m[:SEED] for i, m in enumerate(marks)})
    held = spark.sparkContext.broadcast(splitters)

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            suffixes = keyed(pdf)
            while rows := sorted(islice(suffixes, RUN)):
                keys = [r[0] for r in rows]
                cuts = [0, *(bisect_right(keys, s) for s in held.value), len(rows)]
                out = []
                for target, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    if j > i:
                        rest, shared, sizes = front_code(keys[i:j])
                        out.append((target, rest, shared, sizes, b"".join(r[1] for r in rows[i:j]), [len(r[1]) for r in rows[i:j]]))
                yield pd.DataFrame(out, columns=["target", "rest", "shared", "sizes", "before", "before_sizes"])

    runs = cand.mapInPandas(sort, "target int, rest binary, shared array<int>, sizes array<int>, before binary, before_sizes array<int>")

    def by_target(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_rows: list[pd.DataFrame] = []
        for pdf in batches:
            for target, own in pdf.groupby("target", sort=True):
                if own_rows and own_rows[0]["target"].iloc[0] != target:
                    yield from merged(pd.concat(own_rows))
                    own_rows = []
                own_rows.append(own)
        if own_rows:
            yield from merged(pd.concat(own_rows))

    def merged(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        target = int(pdf["target"].iloc[0])
        lefts = []
        for before, sizes in zip(pdf["before"], pdf["before_sizes"]):
            ends = np.cumsum(sizes)
            lefts.append([before[e - s : e][::-1] for e, s in zip(ends.tolist(), sizes.tolist())])
        n = sum(map(len, lefts))
        lcp, keys, left, left_sizes = np.zeros(n, np.int64), [b""] * n, np.zeros((n, SEEDS - 1), np.uint8), np.zeros(n, np.int64)
        used = [0] * len(pdf)
        for i, (shared, run, key) in enumerate(merge([decode(r, s.tolist(), z.tolist()) for r, s, z in zip(pdf["rest"], pdf["shared"], pdf["sizes"])])):
            own = lefts[run][used[run]]
            used[run] += 1
            lcp[i], keys[i], left_sizes[i] = shared, key, len(own)
            left[i, : len(own)] = np.frombuffer(own, np.uint8)
        uid = np.array([int.from_bytes(k[-12:-4]) for k in keys], np.int64)
        at = np.array([int.from_bytes(k[-4:]) for k in keys], np.int64)
        sizes = np.array([len(k) - 12 for k in keys], np.int64)
        lcp = np.minimum(lcp, np.minimum(sizes, np.append(0, sizes[:-1])))
        low, high = spans_of(lcp, sizes, left, left_sizes)
        hit = high >= 0
        yield pd.DataFrame({"uid": uid[hit], "start": (at - high)[hit], "end": (at - low + LENGTH)[hit], "h": np.int64(0), "edge": False})
        # a seed's class goes on in the neighbouring merge where the splitter between them stands within it
        new = np.nonzero(lcp < SEED)[0]
        within = [0 < i + 1 <= len(held.value) and len(held.value[i]) > SEED and held.value[i][:SEED] == k[:SEED] for i, k in ((target - 1, keys[0]), (target, keys[-1]))]
        first = np.arange(0, new[new > 0][0] if (new > 0).any() else n) if within[0] else np.zeros(0, np.int64)
        last = np.arange(new[-1] if len(new) else 0, n) if within[1] else np.zeros(0, np.int64)
        edge = np.unique(np.concatenate([first, last]))
        reach = np.zeros(n, np.int64)
        if len(first):
            shares = np.append(common_prefix(keys[0], held.value[target - 1]), lcp[1 : len(first)])
            reach[first] = np.minimum.accumulate(shares)
        if len(last):
            shares = np.append(common_prefix(keys[-1], held.value[target]), lcp[last[-1] : last[0] : -1])
            reach[last] = np.maximum(reach[last], np.minimum.accumulate(shares)[::-1])
        for k in range(0, len(edge), 8192):
            e = edge[k : k + 8192]
            for o, who, h in _edge_strings([keys[i][:-12] for i in e], np.minimum(reach, sizes)[e], left[e], left_sizes[e]):
                yield pd.DataFrame({"uid": uid[e[who]], "start": at[e[who]] - o, "end": at[e[who]] - o + LENGTH, "h": h.view(np.int64), "edge": True})

    # a partition has whole merges, one after the other
    runs = runs.repartition(merges, "target").sortWithinPartitions("target")
    found = cut(runs.mapInPandas(by_target, "uid long, start long, end long, h long, edge boolean"), "found")
    edges = found.filter("edge").dropDuplicates(["h", "uid", "start"])
    twice = cut(edges.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "twice")
    hits = found.filter("not edge").select("uid", "start", "end").unionByName(edges.join(twice, "h").select("uid", "start", "end"))
    hits = hits.unionByName(chosen.select("uid", F.explode("own").alias("x")).select("uid", "x.start", "x.end"))

    def carve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sha, text, spans in zip(pdf["sha"], pdf["t"], pdf["spans"]):
                raw, runs = text.encode("utf-8", "replace"), []
                for s in sorted((x["start"], x["end"]) for x in spans):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                kept = hashlib.sha256()
                at = 0
                for a, b in runs:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((sha, [(a, b - a) for a, b in runs], kept.hexdigest()))
            yield pd.DataFrame(rows, columns=["sha", "removed", "kept"])

    carved = cand.join(hits.distinct().groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "uid").mapInPandas(carve, "sha string, removed array<struct<start:long,length:long>>, kept string")
    # written first, so that the join's partitions can be split where a text has very many copies
    copies = cut(all_docs.groupBy("sha").agg(F.count("*").alias("copies")).join(carved, "sha", "left").filter("copies > 1 or removed is not null"), "copies")
    whole = (F.coalesce("copies", F.lit(1)) > 1) & (F.col("n_bytes") >= LENGTH)
    spans = F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("length")))).otherwise(F.coalesce("removed", F.array().cast("array<struct<start:long,length:long>>")))
    out = all_docs.select("doc_id", "sha", "n_bytes").join(copies, "sha", "left").withColumn("removed", spans)
    return out.select(
        "doc_id", "n_bytes", F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"), "removed",
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
