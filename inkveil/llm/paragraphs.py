"""Operator 1: substring dedup by MinHash banding of paragraphs, and exact repeated runs of words wherever lines break."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import block_pairs, components, cut, free, probable, table, tidy

SHINGLE = 5
#: Shorter paragraphs are no passages.
MIN_WORDS = 8
#: Paragraphs that repeat count as a passage where neighbouring ones have so many words together; NEAR bytes apart is neighbouring.
MIN_RUN, NEAR = 20, 80
#: Members of a bucket, and bytes of their sets, that are compared with as many others at a time; cells of a matrix for that.
BLOCK, BLOCK_BYTES, CELLS = 256, 1 << 20, 1 << 18
#: White space other than spaces and line feeds becomes a space.
SPACES = bytes.maketrans(b"\t\v\f\r", b"    ")
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

#: Multipliers of a word's bytes by place; bytes of a text that are hashed at a time.
POWERS = np.cumprod(np.full(1024, MIX[4]))
STEP = 1 << 19


def tune_bands(threshold: float, recall: float = 0.99) -> int:
    """Bands of one row each that let a pair at `threshold` collide with probability `recall`.

    Shingles of five words are rare, so bands of one row find few false candidates; each is verified anyway."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and hashes of a text's words, in blocks so that very long texts need little memory.

    Hashes only propose candidates and places to divide; equality is decided elsewhere."""
    parts, at = [], 0
    while at < len(raw):
        end = at + STEP
        if end < len(raw):
            end = min((x for x in (raw.find(b" ", end), raw.find(b"\n", end)) if x >= 0), default=len(raw))
        block = np.frombuffer(raw[at:end], np.uint8)
        inside = (block != 32) & (block != 10)
        edge = np.diff(inside.view(np.int8), prepend=0, append=0)
        start, stop = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        if len(start):
            size = stop - start
            first = np.cumsum(size) - size
            place = np.arange(size.sum()) - np.repeat(first, size)
            h = np.add.reduceat(block[inside] * POWERS[place % len(POWERS)], first)
            parts.append((start + at, stop + at, _mix(h + size.astype(np.uint64) * MIX[4])))
        at = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def gathered(ids: Iterable, texts: Iterable[str | None]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and lower-case bytes of texts, about STEP bytes at a time, which bounds what a worker holds."""
    own, raws, size = [], [], 0
    for i, text in zip(ids, texts):
        own.append(i)
        raws.append((text or "").encode("utf-8", "replace").lower().translate(SPACES))
        size += len(raws[-1])
        if size > STEP:
            yield own, raws
            own, raws, size = [], [], 0
    if own:
        yield own, raws


def word_lists(ids: Iterable, texts: Iterable[str | None]) -> Iterator[tuple[object, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Id, lower-case bytes, byte starts, byte ends and hashes of the words of each text."""
    for own, raws in gathered(ids, texts):
        base = np.cumsum([0] + [len(r) + 1 for r in raws])
        start, end, h = words(b"\n".join(raws))
        at = np.searchsorted(start, base)
        for k, i in enumerate(own):
            s = slice(at[k], at[k + 1])
            yield i, raws[k], start[s] - base[k], end[s] - base[k], h[s]


def lines(raw: bytes, start: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) words of a text's paragraphs: its lines of `min_words` words or more."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.searchsorted(np.nonzero(np.frombuffer(raw, np.uint8) == 10)[0], start)
    first = np.nonzero(np.diff(number, prepend=-1))[0]
    last = np.append(first[1:], len(start))
    keep = last - first >= min_words
    return first[keep], last[keep]


def signatures(first: np.ndarray, last: np.ndarray, h: np.ndarray, bands: int) -> np.ndarray:
    """MinHash values of each paragraph's 5-word shingles (paragraphs x bands); a paragraph has SHINGLE words at least."""
    if len(first) == 0:
        return np.empty((0, bands), np.uint64)
    s = sum((h[i : len(h) - SHINGLE + 1 + i] * MIX[i] for i in range(SHINGLE)), np.uint64(0))
    ends = np.stack([first, last - SHINGLE + 1], 1).ravel()
    out = np.empty((len(first), bands), np.uint64)
    for b in range(bands):
        x = np.append(_mix(s + np.uint64((b + 1) * 0x9E3779B97F4A7C15 % 2**64)), ~np.uint64(0))
        out[:, b] = np.minimum.reduceat(x, ends)[::2]
    return out


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a text with the word hashes `h`; a shorter text is one shingle."""
    n = min(len(h), SHINGLE)
    if n == 0:
        return np.zeros(0, np.uint64)
    s = sum((h[i : len(h) - n + 1 + i] * MIX[i] for i in range(n)), np.uint64(n))
    return np.unique(_mix(s))


def alike(sets: list[np.ndarray], threshold: float, apart: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of sets whose Jaccard similarity is `threshold` or more; only pairs with i < `apart` <= j, if it isn't 0."""
    n = len(sets)
    x = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, place, often = np.unique(x, return_inverse=True, return_counts=True)
    rank = np.cumsum(often > 1) - 1
    shared = np.nonzero(often[place] > 1)[0]
    owner, column = owner[shared], rank[place[shared]]
    # sets against sets by products of 0/1 matrices, so many shared values at a time as need little memory
    a, b = (slice(0, apart), slice(apart, n)) if apart else (slice(0, n), slice(0, n))
    common = np.zeros((a.stop - a.start, b.stop - b.start), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n_columns = int(column[-1]) + 1 if len(column) else 0
    wide = min(max(64, CELLS // n), n_columns)
    for at in range(0, n_columns, wide or 1):
        s = slice(*np.searchsorted(column, [at, at + wide]))
        own = np.zeros((n, wide), np.float32)
        own[owner[s], column[s] - at] = 1
        common += own[a] @ own[b].T
    size = np.array([len(s) for s in sets])
    close = common >= threshold * (size[a][:, None] + size[b][None, :] - common) - 1e-9
    close &= common > 0
    i, j = np.nonzero(close if apart else np.triu(close, 1))
    return i, j + b.start


def verified(members: DataFrame, sets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Labels (node, component) of nodes that share a bucket and whose sets have a Jaccard similarity of `threshold` or more.

    members: (h, u, hub, size), a row for each node u of bucket h with the bucket's hub and size. sets: (u, s), sorted
    64-bit values. Every node is compared with its bucket's hub. If a bucket then still spans several components, all its
    pairs of different components are compared, in blocks of about `block` nodes or BLOCK_BYTES, so no link is lost in large buckets.
    """

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(alike([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)], threshold)[0]) > 0 for x, y in zip(a, b)], dtype=bool)

    pairs = members.filter("u <> hub").select("u", F.col("hub").alias("v")).distinct()
    near = pairs.join(sets.select("u", F.col("s").alias("a")), "u").join(sets.select(F.col("u").alias("v"), F.col("s").alias("b")), "v")
    # sets whose sizes differ by more than the threshold can't reach it
    sizes = F.least(F.length("a"), F.length("b")) >= F.lit(threshold) * F.greatest(F.length("a"), F.length("b")) - 1e-9
    links = cut(near.filter(sizes).filter(close("a", "b")).select("u", "v"), "links")
    label = cut(components(links), "labels")
    tagged = members.filter("size > 2").join(label, F.col("u") == F.col("node"), "left").select("h", "u", F.coalesce("component", "u").alias("c"))
    spans = tagged.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("h")
    rest = cut(tagged.join(spans, "h").join(sets, "u"), "rest")
    weight = rest.groupBy("h").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.length("s")) / BLOCK_BYTES)).alias("blocks"))
    pairs = block_pairs(rest.join(weight, "h").select("h", "blocks", "u", "c", "s"), "u")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for mine, others in zip(pdf["l"], pdf["o"]):
                # only links that join what isn't joined yet, so a pair of blocks gives fewer links than it has members
                own = list(mine) if others is None else [*mine, *others]
                c = np.array([m["c"] for m in own], np.int64)
                group = dict(zip(c.tolist(), c.tolist()))
                i, j = alike([np.frombuffer(m["s"], np.uint64) for m in own], threshold, 0 if others is None else len(mine))
                new = c[i] != c[j]
                for i, j in zip(i[new].tolist(), j[new].tolist()):
                    a, b = (own[x]["c"] for x in (i, j))
                    while group[a] != a:
                        group[a] = a = group[group[a]]
                    while group[b] != b:
                        group[b] = b = group[group[b]]
                    if a != b:
                        group[max(a, b)] = min(a, b)
                        out.append((own[i]["u"], own[j]["u"]))
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    more = cut(pairs.mapInPandas(tidy(compare), "u long, v long").distinct(), "more")
    return label if more.isEmpty() else cut(components(links.unionByName(more)), "labels")


def prints(src: DataFrame, bands: int, min_words: int) -> DataFrame:
    """One row for each distinct (doc_id, text) of `src` (u, doc_id, t): what its words are, its paragraphs and its grams.

    Texts of equal words (in lower case) are one kind, told apart by two 64-bit hashes and the number of words; `first` is
    the (doc_id, u) of the kind's first text. Written as a file.
    """
    from .runs import chains, chosen

    arrays = {"p_start": "int", "p_len": "int", "p_words": "int", "p_same": "long", "p_also": "long", **{f"p_b{i}": "long" for i in range(bands)}, "w": "int", "start": "int", "stop": "int", "g": "long", "c": "long", "k_from": "int", "k_to": "int", "k_hash": "long"}

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for (u, doc_id), raw, start, end, h in word_lists(zip(pdf["u"], pdf["doc_id"]), pdf["t"]):
                first, last = lines(raw, start, min_words)
                begin, stop = start[first], end[last - 1]
                values = signatures(first, last, h, bands).view(np.int64)
                norm = [h[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist())]
                same = [np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in norm), np.uint64, len(norm)).view(np.int64) for seed in (0, 1)]
                kind = [np.uint64(xxhash.xxh64_intdigest(h.tobytes(), seed)).view(np.int64) for seed in (0, 1)]
                grams = chosen(start, end, h)
                rows.append((u, doc_id, len(h), len(raw), *kind, begin, stop - begin, last - first, *same, *values.T, *grams, *chains(*grams[3:])))
            yield pd.DataFrame(rows, columns=["u", "doc_id", "n_words", "n_bytes", "kind", "also", *arrays])

    schema = "u long, doc_id long, n_words int, n_bytes int, kind long, also long" + "".join(f", {k} array<{v}>" for k, v in arrays.items())
    return cut(src.mapInPandas(tidy(look), schema), "prints")


def _paragraphs(texts: DataFrame, src: DataFrame, bands: int, threshold: float, min_run: int) -> DataFrame:
    values = [f"b{i}" for i in range(bands)]
    own = ["p_start", "p_len", "p_words", "p_same", "p_also", *(f"p_{v}" for v in values)]
    x = F.explode(F.arrays_zip(*own)).alias("x")
    units = texts.select("u", "doc_id", x).select("u", "doc_id", *(F.col(f"x.{c}").alias(c.removeprefix("p_")) for c in own)).withColumnsRenamed({"len": "length", "words": "n_words", "same": "k"})
    # equal paragraphs are one kind; what follows deals with kinds only, so copies cost nothing more
    kinds = units.groupBy("k", "also").agg(F.min(F.struct("doc_id", "start", "u", "length")).alias("o"), F.count("*").alias("n"), *[F.min(v).alias(v) for v in values])
    # bands have different hash functions, so a value stands for its band too; both sides of the join share one shuffle
    flat = kinds.select("k", "o", F.explode(F.array(*values)).alias("h")).repartition("h")
    buckets = flat.groupBy("h").agg(F.min("k").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    members = cut(flat.join(buckets, "h").withColumnRenamed("k", "node"), "members")
    asked = members.groupBy("node").agg(F.min("o").alias("o")).groupBy(F.col("o.u").alias("u")).agg(F.collect_list(F.struct("node", "o.start", "o.length")).alias("own"))
    asked = cut(asked, "asked")

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for own, raw, start, _, h in word_lists(pdf["own"], pdf["t"]):
                for x in own:
                    a, b = np.searchsorted(start, [x["start"], x["start"] + x["length"]])
                    rows.append((x["node"], shingle_set(h[a:b]).tobytes()))
            yield pd.DataFrame(rows, columns=["u", "s"])

    sets = cut(probable(src, "u", asked).join(asked, "u").mapInPandas(tidy(carry), "u long, s binary").dropDuplicates(["u"]), "sets")
    label = verified(members.select("h", F.col("node").alias("u"), "hub", "size"), sets, threshold)
    told = units.groupBy("k", "also").agg(F.count("*").alias("n")).join(label, F.col("k") == F.col("node"), "left").filter("n > 1 or node is not null").select("k", "also", F.coalesce("component", "k").alias("component"))
    told = cut(told, "told")
    out = cut(probable(units.select("u", "doc_id", "start", "length", "n_words", "k", "also"), "k", told).join(told, ["k", "also"]).drop("k", "also"), "clustered")
    first = cut(out.groupBy("component").agg(F.min(F.struct("doc_id", "start", "u")).alias("first")), "firsts")
    out = out.join(first, "component").select(
        "u", "doc_id", "start", "length", "n_words", F.col("first.doc_id").alias("cluster_doc_id"), F.col("first.start").alias("cluster_start"), (F.struct("doc_id", "start", "u") != F.col("first")).alias("removed")
    )
    w = Window.partitionBy("u").orderBy("start")
    apart = F.coalesce(F.col("start") - F.lag(F.col("start") + F.col("length")).over(w) > NEAR, F.lit(False))
    out = out.withColumn("run", F.sum(apart.cast("int")).over(w))
    return out.withColumn("run", F.sum("n_words").over(Window.partitionBy("u", "run"))).filter(F.col("run") >= min_run).drop("run", "u")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, min_run: int = MIN_RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, start, length, n_words, cluster_doc_id, cluster_start, removed), one for each repeated passage found.

    start and length are in bytes of the UTF-8 text. Three kinds of passages are found; their spans may overlap:

    - whole texts of `min_run` words or more whose words (in lower case) equal those of another text; the first stays, the others are `removed`;
    - paragraphs, i.e. lines of `min_words` (5 at least) words or more, whose 5-word shingles have a Jaccard similarity of `threshold`
      or more. They are linked, clusters are the links' components; the first paragraph by doc_id and start stays and is
      returned too, the others are `removed`. A single short line that recurs, such as a licence note, isn't a passage: a
      run of clustered paragraphs of a text counts from `min_run` words on (1: every clustered paragraph);
    - runs of over 50 equal words, wherever lines break (see `runs`), all but the first.

    Equality is of 64-bit hashes of words; equal texts and paragraphs have two more such hashes in common. Null and empty
    texts have no passages. Rows with a null id are left out; equal rows count once; texts that share an id are
    searched one by one, but their spans can't be told apart, so give each row an id of its own.
    """
    from .runs import runs

    bands = tune_bands(threshold)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).filter("doc_id is not null and t is not null")
    src = src.withColumn("u", F.xxhash64("doc_id", "t"))
    all_texts = prints(src, bands, max(SHINGLE, min_words))
    own = all_texts.filter("n_words > 0").groupBy("u").agg(*(F.min(c).alias(c) for c in ("doc_id", "n_words", "n_bytes", "kind", "also")))
    # written first, so that the join's partitions can be split where a text has very many copies
    first = cut(own.groupBy("kind", "also", "n_words").agg(F.min(F.struct("doc_id", "u")).alias("first"), F.count("*").alias("n")).filter("n > 1"), "firsts")
    copies = cut(probable(own, "kind", first).join(first, ["kind", "also", "n_words"]).withColumn("removed", F.struct("doc_id", "u") != F.col("first")), "copies")
    # of equal rows one is looked at, of equal texts the first
    twice = cut(all_texts.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u"), "twice")
    single = all_texts.join(copies.filter("removed").select("u"), "u", "left_anti")
    doubled = single.join(twice, "u", "left_semi").dropDuplicates(["u"])
    texts = single.join(twice, "u", "left_anti").unionByName(doubled)
    whole = copies.filter(F.col("n_words") >= min_run).select(
        "doc_id", F.lit(0).alias("start"), F.col("n_bytes").alias("length"), "n_words", F.col("first.doc_id").alias("cluster_doc_id"), F.lit(0).alias("cluster_start"), "removed"
    )
    return whole.unionByName(_paragraphs(texts, src, bands, threshold, min_run)).unionByName(runs(texts, src))


def remove(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the bytes of `spans` (doc_id, start, length). Documents without spans stay as they are; a text of which only white space is left becomes empty."""
    key, held = free("_id", docs), free("_spans", docs)
    own = cut(spans.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start", "length")).alias(held)), "spans")

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans):
            if own is None or text is None:
                out.append(text)
                continue
            raw, at, kept = text.encode("utf-8", "replace"), 0, []
            for s in sorted(own, key=lambda x: x["start"]):
                kept.append(raw[at : s["start"]])
                at = max(at, s["start"] + s["length"])
            rest = b"".join([*kept, raw[at:]]).decode("utf-8", "replace")
            out.append(rest if rest.strip() else "")
        return pd.Series(out, dtype=object)

    # most texts have no spans, as a bitmap tells, and need no shuffle
    wanted = own.select(F.col(key).alias(id_col))
    maybe = probable(docs, id_col, wanted)
    done = maybe.join(own, maybe[id_col] == own[key], "left").withColumn(text_col, without(F.col(text_col), F.col(held))).select(*(F.col(f"`{c}`") for c in docs.columns))
    return probable(docs, id_col, wanted, absent=True).unionByName(done)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
