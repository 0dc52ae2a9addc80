"""Operator 7: SimHash near-duplicates through an inverted index of positional bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_pairs, components, cut, probable, table, tidy

BYTES = 8
#: Fingerprints of a posting list that are compared in one piece.
BLOCK = 256


def fingerprint(text: str | None, k: int = 3, distinct: bool = False) -> int:
    """64-bit SimHash of the k-word shingles of `text`, repeats included unless `distinct`; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i : len(words) - k + 1 + i] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, set(shingles) if distinct else shingles, repeat(42)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def covering(shared: int, size: int) -> list[tuple[int, ...]]:
    """Sets of `size` byte positions such that every `shared` positions hold one of them, found greedily."""
    want = set(combinations(range(BYTES), shared))
    out = []
    while want:
        best = max(combinations(range(BYTES), size), key=lambda k: sum(set(k) <= set(s) for s in want))
        out.append(best)
        want = {s for s in want if not set(best) <= set(s)}
    return out


def _under(fp: Column, positions: tuple[int, ...]) -> Column:
    """The list under which a fingerprint is posted for these byte positions."""
    mask = sum(0xFF << 8 * p for p in positions)
    return F.xxhash64(F.lit(mask - (1 << 64) if mask >> 63 else mask), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))


def post(nodes: DataFrame, lists: list[tuple[int, ...]]) -> DataFrame:
    """`nodes` (u, fp) once for each set of positions, with the list's key `h`. Dealt out before, for a small table has few partitions but gives many rows."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.repartition(n, "u").withColumn("h", F.explode(F.array(*[_under(F.col("fp"), p) for p in lists])))


def close_pairs(x: np.ndarray, bits: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of fingerprints that share `shared` positional bytes or more, by a tally, and differ in `bits` bits or fewer."""
    differ = x[:, None] ^ x[None, :]
    tally = (differ.view(np.uint8).reshape(len(x), len(x), BYTES) == 0).sum(2, dtype=np.uint8)
    i, j = np.nonzero(np.triu(tally >= shared, 1))
    near = np.bitwise_count(differ[i, j]) <= bits
    return i[near], j[near]


def forest(values: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links at `bits` or fewer differing bits among the distinct fingerprints of one posting list.

    Lists over BLOCK have all but `bits` bytes equal, hence 256 ** bits values at most; there neighbours are looked up."""
    n = len(values)
    if n <= BLOCK:
        i, j = close_pairs(values, bits, BYTES - bits)
        pairs = zip(i.tolist(), j.tolist())
    else:
        at = {v: i for i, v in enumerate(values.tolist())}
        free = int(np.bitwise_or.reduce(values ^ values[0]))
        ones = [1 << b for b in range(64) if free >> b & 1]
        flips = [sum(c) for r in range(1, bits + 1) for c in combinations(ones, r)]
        pairs = ((i, j) for v, i in at.items() for f in flips if (j := at.get(v ^ f, -1)) > i)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            yield i, j


ONES = 0x1111111111111111
#: Of the bins of two sketches that aren't both empty, this share must be equal; asked of ENOUGH bins or more. At a similarity of 0.8, 16 bins are under it once in 50,000 times, 32 bins never.
SAME, ENOUGH = 1 / 3, 16


def sketch(s: np.ndarray) -> tuple[int, int]:
    """Four bits for each of 32 ranges of hashes, as two longs: of the least of the sorted values `s` in the range, 0 if there is none."""
    first = np.searchsorted(s, np.arange(32, dtype=np.uint64) << np.uint64(59))
    out = np.zeros(32, np.uint64)
    held = np.append(first[1:], len(s)) > first
    out[held] = s[first[held]] % np.uint64(15) + np.uint64(1)
    half = (out.reshape(2, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64).view(np.int64)
    return int(half[0]), int(half[1])


def may_be_alike(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], threshold: float) -> np.ndarray:
    """Whether sets, as triples of arrays (halves of sketches, sizes), may have a Jaccard similarity of `threshold` or more.

    Two bounds hold for certain: the smaller size is `threshold` of the larger one or more, and bins differ by no more than the values
    that one set alone has, (1 - threshold) / (1 + threshold) of both sizes at most. The third is SAME."""

    def filled(x: np.ndarray) -> np.ndarray:
        return (x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & np.uint64(ONES)

    used = sum(np.bitwise_count(filled(x) | filled(y)).astype(np.int32) for x, y in zip(a[:2], b[:2]))
    differ = sum(np.bitwise_count(filled(x ^ y)).astype(np.int32) for x, y in zip(a[:2], b[:2]))
    sizes = (np.minimum(a[2], b[2]) >= threshold * np.maximum(a[2], b[2]) - 1e-9) & (differ <= (1 - threshold) / (1 + threshold) * (a[2] + b[2]) + 1e-9)
    return sizes & ((used < ENOUGH) | (used - differ >= SAME * used))


def _may_be_alike(a: list[Column], b: list[Column], threshold: float) -> Column:
    def filled(x: Column) -> Column:
        return x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3)).bitwiseAND(F.lit(ONES))

    used = sum((F.bit_count(filled(x).bitwiseOR(filled(y))) for x, y in zip(a[:2], b[:2])), F.lit(0))
    differ = sum((F.bit_count(filled(x.bitwiseXOR(y))) for x, y in zip(a[:2], b[:2])), F.lit(0))
    sizes = (F.least(a[2], b[2]) >= threshold * F.greatest(a[2], b[2]) - 1e-9) & (differ <= (1 - threshold) / (1 + threshold) * (a[2] + b[2]) + 1e-9)
    return sizes & ((used < ENOUGH) | (used - differ >= SAME * used))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2, k: int = 3) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id) for every row of `docs`.

    Fingerprints that differ in `bits` (1 or 2) or fewer bits share at least 8 - `bits` positional bytes, the guaranteed
    minimum. Distinct fingerprints are posted under sets of four byte positions, so chosen that any two with the minimum
    meet in a list (2 bits: 6 lists each). In a list shared bytes are tallied, pairs under the minimum are dropped, the
    others' Hamming distance is verified. Lists of over BLOCK fingerprints are posted again under sets of 8 - `bits`
    positions, which no more than 256 ** bits can share, whatever the corpus. Only a spanning forest leaves a list.
    Equal fingerprints are one node, so copies are never expanded.

    component_id is the smallest id reachable, also through rows with a null id. Null or empty texts have fingerprint zero and link to each other. Rows with
    a null id get a null component unless others give one. Repeated ids keep their rows. Other columns of `docs` are
    ignored, whatever their names.
    """
    if bits not in (1, 2):
        raise ValueError("bits must be 1 or 2")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, k) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    fps = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(tidy(prints), "id long, fp long"), "fingerprints")
    reps = cut(fps.groupBy("fp").agg(F.min("id").alias("u")), "reps")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for fp, rep in zip(pdf["fp"], pdf["u"]):
                order = np.argsort(rep)
                rep = np.asarray(rep)[order]
                out += [(rep[i], rep[j]) for i, j in forest(np.asarray(fp, np.int64)[order].view(np.uint64), bits)]
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    def linked(posts: DataFrame) -> DataFrame:
        lists = posts.groupBy("h").agg(F.collect_list(F.struct("fp", "u")).alias("l")).filter(F.size("l") > 1)
        return lists.select("l.fp", "l.u").mapInPandas(tidy(join), "u long, v long").distinct()

    short = covering(BYTES - bits, 4)
    posts = post(reps.select(F.col("fp").alias("u"), "fp"), short).repartition("h")
    large = cut(posts.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("h"), "large")
    if large.isEmpty():
        edges = cut(linked(posts), "links")
    else:
        again = posts.join(large, "h", "left_semi").select("u", "fp").distinct()
        again = post(again, list(combinations(range(BYTES), BYTES - bits)))
        edges = cut(linked(posts.join(large, "h", "left_anti")).unionByName(linked(again)).distinct(), "links")
    classes = reps.join(components(edges), F.col("fp") == F.col("node"), "left").select("fp", "u", F.coalesce("component", "fp").alias("c"))
    lowest = cut(classes.groupBy("c").agg(F.min("u").alias("component_id")), "lowest")
    classes = classes.join(lowest, "c").select("fp", "component_id")
    return fps.join(classes, "fp", "left").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, row_col: str, text_col: str = "text", threshold: float = 0.8, bits: int = 8, shared: int = 3) -> DataFrame:
    """Rows (row, component) for every row of `docs`; `row_col` is a distinct long for each row.

    Candidates come from the byte-position index over SimHash fingerprints of the distinct words: pairs that share `shared`
    positional bytes or more and differ in `bits` or fewer bits. Any pair of 8 - `shared` differing bits has that minimum;
    of pairs with more bits, up to `bits`, those are found that do share so many bytes. Candidates whose sketches (the least shingle of each
    of 32 ranges, 16 bytes together) or sizes say that they are under the threshold are dropped; any other is linked if the
    Jaccard similarity of its 5-word shingles (words in lower case, 64-bit hashes) is `threshold` or more. component is
    the least row reachable. Texts of equal shingle sets are one node, so copies are never expanded; texts without words
    are copies of each other.

    Each node of a list is first compared with the list's least one. In lists that then still hold several components,
    pairs of different components are tallied, in blocks of at most BLOCK x BLOCK.
    """
    from .paragraphs import alike, shingle_set, word_lists

    src = docs.select(F.col(row_col).alias("row"), F.col(text_col).alias("t"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for (i, t), _, _, _, h in word_lists(zip(pdf["row"], pdf["t"]), pdf["t"]):
                s = shingle_set(h)
                rows.append((i, *(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), x)).view(np.int64) for x in (0, 1)), len(s), np.uint64(fingerprint(t, 1, True)).view(np.int64), *sketch(s)))
            yield pd.DataFrame(rows, columns=["row", "same", "also", "n", "fp", "s1", "s2"])

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, shingle_set(h).tobytes()) for i, _, _, _, h in word_lists(pdf["u"], pdf["t"])], columns=["u", "s"])

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(alike([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)], threshold)[0]) > 0 for x, y in zip(a, b)], dtype=bool)

    def verified(pairs: DataFrame) -> DataFrame:
        """Of candidates (u, v) those with the similarity."""
        wanted = cut(pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct(), "wanted")
        sets = cut(probable(src.withColumnRenamed("row", "u"), "u", wanted).join(wanted, "u").mapInPandas(tidy(carry), "u long, s binary"), "sets")
        both = pairs.join(sets.withColumnRenamed("s", "a"), "u").join(sets.select(F.col("u").alias("v"), F.col("s").alias("b")), "v")
        sizes = F.least(F.length("a"), F.length("b")) >= F.lit(threshold) * F.greatest(F.length("a"), F.length("b")) - 1e-9
        return cut(both.filter(sizes).filter(close("a", "b")).select("u", "v"), "verified")

    units = cut(src.mapInPandas(tidy(sign), "row long, same long, also long, n int, fp long, s1 long, s2 long"), "signatures")
    own = ["u", "fp", "s1", "s2", "n"]
    kinds = cut(units.groupBy("same", "also", "n").agg(F.min("row").alias("u"), *(F.min(c).alias(c) for c in own[1:4])), "kinds")
    posts = post(kinds.filter("n > 0").select(*own), covering(shared, shared)).repartition("h")
    heads = posts.groupBy("h").agg(F.min(F.struct(*own)).alias("hub"), F.count("*").alias("size")).filter("size > 1")
    members = cut(posts.join(heads, "h"), "members")
    likely = _may_be_alike([F.col(c) for c in own[2:]], [F.col(f"hub.{c}") for c in own[2:]], threshold)
    hubs = cut(members.filter((F.col("u") != F.col("hub.u")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))) <= bits) & likely).select("u", F.col("hub.u").alias("v")).distinct(), "pairs")
    links = verified(hubs)
    label = cut(components(links), "labels")

    tagged = members.filter("size > 2").join(label, F.col("u") == F.col("node"), "left").select("h", "size", *own, F.coalesce("component", "u").alias("c"))
    spans = tagged.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("h")
    rest = tagged.join(spans, "h").select("h", F.ceil(F.col("size") / (BLOCK // 2)).alias("blocks"), "c", *own)
    rest = block_pairs(rest, "u").select(F.when(F.col("o").isNull(), 0).otherwise(F.size("l")).alias("apart"), F.when(F.col("o").isNull(), F.col("l")).otherwise(F.concat("l", "o")).alias("l"))

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for apart, u, c, n, *rest in zip(*(pdf[x] for x in ("apart", "u", "c", "n", "fp", "s1", "s2"))):
                n = np.asarray(n, np.int64)
                fp, s1, s2 = (np.asarray(x, np.int64).view(np.uint64) for x in rest)
                i, j = close_pairs(fp, bits, shared)
                if apart:  # two blocks: each has met itself elsewhere
                    across = (i < apart) & (j >= apart)
                    i, j = i[across], j[across]
                other = (np.asarray(c)[i] != np.asarray(c)[j]) & may_be_alike((s1[i], s2[i], n[i]), (s1[j], s2[j], n[j]), threshold)
                a, b = np.asarray(u)[i[other]], np.asarray(u)[j[other]]
                out.append(pd.DataFrame({"u": np.maximum(a, b), "v": np.minimum(a, b)}))
            yield pd.concat(out) if out else pd.DataFrame({"u": [], "v": []}, dtype="int64")

    more = cut(rest.select("apart", "l.u", "l.c", "l.fp", "l.s1", "l.s2", "l.n").mapInPandas(tidy(tally), "u long, v long").distinct().join(hubs, ["u", "v"], "left_anti"), "more")
    if not more.isEmpty():
        label = cut(components(links.unionByName(verified(more))), "labels")
    told = kinds.join(label, F.col("u") == F.col("node"), "left").select("same", "also", "n", F.coalesce("component", "u").alias("component"))
    return units.select("row", "same", "also", "n").join(told, ["same", "also", "n"]).select("row", "component")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
