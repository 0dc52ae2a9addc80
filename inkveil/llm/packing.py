"""Operator 2: best-fit packing by exact-complement hashing."""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table, tidy

LENGTH = 2048
#: How the tokenizer file splits normalised text before it looks for merges; no token crosses these pieces or white space.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Texts with these go through the tokenizer whole: separators that only Python takes for white space, and a letter whose lower case depends on its neighbours.
ODD = re.compile("[\x1c-\x1f\u03a3]")
#: Texts, or words, of ASCII and letters that every Unicode version classes alike, without separators that only Python takes for white space.
PLAIN = re.compile(r"[\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*\Z")
#: PIECE for such texts in lower case, quicker.
PLAIN_PIECE = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\x09-\x0d a-z0-9\xdf-\xf6\xf8-\xff]+")
#: Pieces whose ids a Python worker keeps before it begins anew (see Kept).
MEMORY = 100_000
#: Texts by which it is seen whether a tokenizer file splits as PIECE does; if not, whole texts go through it.
PROBES = ("Hello, world's 2nd caf\u00e9: na\u00efve?!", "a\x00b\x01 \x7f\x0ec", "it's WE'LL '' x_y-z 12.5%", "\u00c9t\u00e9 \u00df\u00fc", " lead  and\ttrail\n")


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write the 256 bytes: printable ones themselves, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Kept(dict):
    """What `make` gives for each key. Beyond `most` keys a new table begins, which takes over what is asked for again from the last one; nothing older is kept."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        value = self.before.get(key) or self.make(key)
        self[key] = value
        return value


class WordTokenizer:
    """Ids of whole texts by a tokenizer file of lower-case words, a worker keeping the ids of pieces that it has met."""

    _made: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.pieces = Kept(self._piece, MEMORY)
        self.words = Kept(self._word, MEMORY // 4)  # of texts that aren't plain
        self.known = True
        self.known = all(self.encode(t).tolist() == self._whole(t).tolist() for t in PROBES)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _piece(self, piece: str) -> bytes:
        # printable ASCII is written as itself
        written = piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(written)]).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PLAIN_PIECE.findall(text.lower())))

    def _word(self, word: str) -> bytes:
        return self._plain(word) if PLAIN.match(word) else self._whole(word).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not self.known or any(s in text for s in self.special):
            return self._whole(text)
        if PLAIN.match(text):
            return np.frombuffer(self._plain(text), np.uint32)
        if ODD.search(text):
            return self._whole(text)
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.split())), np.uint32)


def plan(counts: dict[int, int], size: int = LENGTH) -> list[tuple[list[tuple[int, int]], int]]:
    """Fillings of sequences of `size` for `counts` (length: how many): pairs ([(length, copies), ...], sequences so filled).

    First, from the longest length down, a gap is looked up among single lengths, pair sums and triple sums; a combination
    that fills it exactly is used as often as the counts allow, which uses up one of its lengths. What is left goes
    best-fit, longest first, whole groups of equal sequences at a time. The work depends on the number of distinct
    lengths, not on the number of pieces.
    """
    n = np.zeros(size + 1, np.int64)
    for length, k in counts.items():
        n[length] = k
    out: list[tuple[list[tuple[int, int]], int]] = []
    here = n > 0
    pairs = np.zeros(size + 1, np.int64)  # how many pairs a <= b of lengths at hand have this sum
    for a in np.nonzero(here)[0]:
        b = np.nonzero(here[a : size - a + 1])[0] + a if a * 2 <= size else np.zeros(0, np.int64)
        pairs[a + b] += 1

    triples = np.zeros(size + 1, np.int64)  # how many lengths at hand go with some pair to this sum
    for a in np.nonzero(here)[0]:
        triples[a:] += pairs[: size + 1 - a] > 0

    def gone(a: int) -> None:
        had = pairs > 0
        triples[a:] -= had[: size + 1 - a]
        here[a] = False
        b = np.nonzero(here[: size - a + 1])[0]
        pairs[a + b] -= 1
        if 2 * a <= size:
            pairs[2 * a] -= 1
        for s in np.nonzero(had & (pairs == 0))[0]:
            triples[np.nonzero(here[: size - s + 1])[0] + s] -= 1

    def use(combination: list[int]) -> bool:
        need = Counter(combination)
        k = min(n[x] // c for x, c in need.items())
        if k <= 0:
            return False
        out.append((sorted(need.items(), reverse=True), int(k)))
        for x, c in need.items():
            n[x] -= k * c
            if not n[x]:
                gone(x)
        return True

    def pair(gap: int, most: int) -> Iterator[tuple[int, int]]:
        a = np.arange(min(most, gap - 1), (gap + 1) // 2 - 1, -1)
        a = a[(a > 0) & here[a] & here[gap - a]] if len(a) else a
        yield from ((int(x), gap - int(x)) for x in a)

    for a in range(size, 0, -1):
        while n[a]:
            gap = size - a
            if not gap:
                use([a])
            elif not ((gap <= a and n[gap] and use([a, gap])) or (pairs[gap] > 0 and any(use([a, *p]) for p in pair(gap, a)))):
                b = np.arange(min(a, gap - 2) if triples[gap] > 0 else 0, 0, -1)
                b = b[here[b] & (pairs[gap - b] > 0)]
                if not any(use([a, int(x), *p]) for x in b for p in pair(gap - int(x), int(x))):
                    break
    # best fit of the rest: by gap, groups (filling, sequences)
    gaps: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    for a in range(size, 0, -1):
        left = int(n[a])
        for gap in sorted(g for g in gaps if g >= a):
            while left and gaps[gap]:
                filling, k = gaps[gap].pop()
                q = min(gap // a, left)
                used = min(k, left // q)
                gaps[gap - q * a].append(([*filling, (a, q)], used))
                left -= used * q
                if k > used:
                    gaps[gap].append((filling, k - used))
            if not left:
                break
        each = size // a
        if left >= each:
            gaps[size - each * a].append(([(a, each)], left // each))
        if left % each:
            gaps[size - left % each * a].append(([(a, left % each)], 1))
    return out + [g for v in gaps.values() for g in v]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, size: int, keep_ids: bool) -> DataFrame:
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = WordTokenizer(tokenizer_path)  # goes with its task, else every worker of a job would keep one
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["id"], pdf["t"]):
                ids = np.append(tokenizer.encode(text or ""), np.uint32(0))
                for k, s in enumerate(range(0, len(ids), size)):
                    x = ids[s : s + size]
                    rows.append((None if pd.isna(doc) else int(doc), k, s, len(x), zlib.crc32(x.astype("<u4").tobytes()), *([x.astype(np.int32)] if keep_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])
            yield out.astype({"doc_id": "Int64"})
        del tokenizer
        gc.collect()  # it refers to itself

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInPandas(tidy(run), schema)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = LENGTH, keep_ids: bool = False, groups: int | None = None) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), every token of `docs` in one place.

    A document is its text's ids, then id 0. Only documents longer than `size` are cut. Null and empty texts are one token.
    Null ids and repeated ids keep a row for each of their pieces.

    The plan is made from the counts of the lengths, at most `size` rows, so what the driver sees and what is broadcast
    have that bound whatever the corpus. Pieces of one length, however many, are numbered in parallel: first within
    (length, group) for hashed groups, then by the groups' running counts. A piece's number gives its place in the plan.
    """
    spark = docs.sparkSession
    groups = groups or max(16, 4 * docs.rdd.getNumPartitions())
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(groups)).cast("int")
    got = cut(pieces(docs, tokenizer_path, id_col, text_col, size, keep_ids).withColumn("g", spread), "pieces")
    by_group = got.groupBy("length", "g").agg(F.count("*").alias("n"))
    before = by_group.selectExpr("length", "g", "sum(n) OVER (PARTITION BY length ORDER BY g) - n AS before")
    counts = {r[0]: r[1] for r in got.groupBy("length").agg(F.count("*")).collect()}  # at most `size` rows
    starts, copies, base, offset, lengths = [], [], [], [], []
    taken: Counter[int] = Counter()
    sequence = 0
    for filling, k in plan(counts, size):
        at = 0
        for length, q in filling:
            starts.append((length << 48) + taken[length])
            copies.append(q)
            base.append(sequence)
            offset.append(at)
            lengths.append(length)
            taken[length] += k * q
            at += length * q
        sequence += k
    order = np.argsort(np.array(starts, np.int64))
    places = spark.sparkContext.broadcast([np.array(x, np.int64)[order] for x in (starts, copies, base, offset, lengths)])
    schema = T.StructType([*(f for f in got.schema if f.name != "g"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, q, seq, off, size_of = places.value
        for pdf in batches:
            key = (pdf["length"].to_numpy(np.int64) << 48) + pdf["number"].to_numpy(np.int64)
            i = np.searchsorted(first, key, "right") - 1
            r = key - first[i]
            pdf["sequence_id"] = seq[i] + r // q[i]
            pdf["offset"] = off[i] + r % q[i] * size_of[i]
            yield pdf[[f.name for f in schema]].astype({"doc_id": "Int64"})

    numbered = got.withColumn("r", F.expr("row_number() OVER (PARTITION BY length, g ORDER BY doc_id, piece, ids_crc32) - 1"))
    numbered = numbered.join(before, ["length", "g"]).withColumn("number", F.col("r") + F.col("before")).drop("r", "before", "g")
    return numbered.select(*(f.name for f in schema.fields[:-2]), "number").mapInPandas(tidy(place), schema)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
