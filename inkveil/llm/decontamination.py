"""Operator 5: benchmark decontamination by a BM25 inverted index of test items with block-max WAND."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, tidy

TERM = re.compile(r"\w+")
#: Words of half a passage. A passage is two neighbouring halves, so any run of HALF words lies in one passage.
HALF = 64
#: Items per block of the block maxima.
BLOCK = 8
#: Postings of one index shard, the bound of what is broadcast at once; a larger benchmark is taken shard by shard.
SHARD_POSTINGS = 2_000_000
K1, B = 1.2, 0.75
#: Bounds (halves x blocks) that are computed at once.
CELLS = 1 << 20


#: ASCII characters that end a word become spaces.
SPACES = bytes.maketrans(bytes(c for c in range(128) if not TERM.match(chr(c))), b" " * sum(not TERM.match(chr(c)) for c in range(128)))
BEYOND = re.compile(r"[^\x00-\x7f\w]")


def raw_terms(text: str | None) -> list[bytes]:
    """Words in lower case, in UTF-8: runs of letters, digits and underscores."""
    text = (text or "").lower()
    if not text.isascii():
        text = BEYOND.sub(" ", text)
    return text.encode("utf-8", "replace").translate(SPACES).split()


def terms_of(text: str | None) -> list[str]:
    return [w.decode() for w in raw_terms(text)]


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of a test item's question and answer: the answer is the last line or sentence; a single sentence has none."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if TERM.search(p)]
    return terms_of(" ".join(parts[:-1] or parts)), terms_of(parts[-1]) if len(parts) > 1 else []


def grams(words: list[str]) -> list[str]:
    """The index's terms: pairs of neighbouring words, which a passage shares with few items by chance; a lone word is one."""
    return [f"{a} {b}" for a, b in zip(words, words[1:])] or words


def shingles(words: list[str], k: int = 5) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


class Index:
    """Posting lists of one shard: weights are BM25 scores, scaled so that a passage with all of a probe's terms scores 1."""

    def __init__(self, probes: list[tuple[int, str]], postings: list[tuple[str, int, float]]):
        self.items = probes  # (item id, text) by probe number
        self.parts = [question_answer(text) for _, text in probes]
        self.shingles = [shingles(q) for q, _ in self.parts]
        self.terms = {t: i for i, t in enumerate(sorted({p[0] for p in postings}))}
        self.words = {w: i for i, w in enumerate(sorted({w for t in self.terms for w in t.split()}))}
        self.raw = {w.encode(): i for w, i in self.words.items()}
        keys = {self._key(*t.split()): i for t, i in self.terms.items()}
        self.keys = np.array(sorted(keys), np.int64)
        self.term = np.array([keys[k] for k in self.keys.tolist()], np.int64)
        self.lone = any(" " not in t for t in self.terms)
        by: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for t, probe, w in postings:
            by[self.terms[t]].append((probe, w))
        self.lists = [sorted(x) for x in by]
        self.most = [max(w for _, w in x) for x in self.lists]
        self.maxima = [{} for _ in by]  # block -> largest weight
        for maxima, x in zip(self.maxima, self.lists):
            for probe, w in x:
                maxima[probe // BLOCK] = max(w, maxima.get(probe // BLOCK, 0.0))
        self.blocks = -(-len(probes) // BLOCK)
        counts = np.array([len(m) for m in self.maxima], np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.block = np.array([b for m in self.maxima for b in m], np.int64)
        self.weight = np.array([w for m in self.maxima for w in m.values()])

    def _key(self, word: str, after: str | None = None) -> int:
        return self.words[word] * (len(self.words) + 1) + (self.words[after] + 1 if after is not None else 0)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys).clip(max=len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.term[at], -1)

    def postings_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places in `words` where a term of the index starts, and the terms."""
        ids = np.array(list(map(self.raw.get, words, repeat(-1))), np.int64)
        n = len(self.words) + 1
        at = np.nonzero((ids[:-1] >= 0) & (ids[1:] >= 0))[0]
        found = self._find(ids[at] * n + ids[at + 1] + 1)
        if self.lone:
            one = np.nonzero(ids >= 0)[0]
            at, found = np.concatenate([at, one]), np.concatenate([found, self._find(ids[one] * n)])
        return at[found >= 0], found[found >= 0]

    def may_hold(self, at: np.ndarray, found: np.ndarray, n_words: int, least: float) -> list[int]:
        """Halves h whose passage h, h + 1 has a block that can reach `least` by its block maxima."""
        n = max(1, -(-n_words // HALF))
        key = np.unique(at // HALF * len(self.terms) + found)
        half, term = key // len(self.terms), key % len(self.terms)
        out: set[int] = set()
        step = max(1, min(n, CELLS // self.blocks))
        for first in range(0, max(1, n - 1), step):  # some halves at a time, so very long texts and large indexes need little memory
            a, b = np.searchsorted(half, [first, first + step + 1])
            own, size = term[a:b], self.first[term[a:b] + 1] - self.first[term[a:b]]
            posting = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[own], size)
            bound = np.bincount(np.repeat(half[a:b] - first, size) * self.blocks + self.block[posting], self.weight[posting], (step + 1) * self.blocks).reshape(step + 1, -1)
            passage = bound[:-1] + bound[1:] if n > 1 else bound[:1]
            out.update((np.nonzero((passage >= least - 1e-9).any(1))[0] + first).tolist())
        return sorted(h for h in out if h < max(1, n - 1))

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All probes that score `least` or more for distinct `terms`: block-max WAND with a fixed threshold."""
        least -= 1e-9
        cursors = [[self.lists[t][0][0], t, 0] for t in terms]  # current probe, term, place in its list
        found = []

        def move(c: list[int], to: int) -> None:
            items, i = self.lists[c[1]], c[2]
            while i < len(items) and items[i][0] < to:
                i += 1
            c[2] = i
            c[0] = items[i][0] if i < len(items) else -1

        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.most[c[1]]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            probe = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == probe:
                pivot += 1
            block = probe // BLOCK
            if sum(self.maxima[c[1]].get(block, 0.0) for c in cursors[: pivot + 1]) < least:
                # no probe of this block up to the next list's current one can reach it
                to = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                for c in cursors[: pivot + 1]:
                    move(c, max(to, probe + 1))
            elif cursors[0][0] == probe:
                score = sum(self.lists[c[1]][c[2]][1] for c in cursors[: pivot + 1])
                if score >= least:
                    found.append((probe, score))
                for c in cursors[: pivot + 1]:
                    move(c, probe + 1)
            else:
                for c in cursors[:pivot]:
                    if c[0] < probe:
                        move(c, probe)
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def matches(self, text: str | None, least: float, overlap: float) -> dict[int, tuple[float, float, float]]:
        """Test items that `text` holds: item id -> (best passage score, question overlap, answer overlap)."""
        words = raw_terms(text)
        at, found = self.postings_of(words)
        out: dict[int, tuple[float, float, float]] = {}
        for h in self.may_hold(at, found, len(words), least) if len(at) else ():
            start, stop = h * HALF, (h + 2) * HALF
            terms = np.unique(found[(at >= start) & (at < stop)])
            for probe, score in self.search(terms.tolist(), least):
                item = self.items[probe][0]
                question, answer = self.parts[probe]
                margin = len(question) + len(answer)
                window = [w.decode() for w in words[max(0, start - margin) : stop + margin]]
                want = self.shingles[probe]
                k = min(5, len(question))
                q = len(want & shingles(window, k)) / len(want) if want else 1.0
                a = len(set(answer) & set(window)) / len(set(answer)) if answer else 1.0
                if q >= overlap and a >= overlap and (item not in out or score > out[item][0]):
                    out[item] = (score, q, a)
        return out


def index_shards(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_postings: int = SHARD_POSTINGS) -> Iterator[Index]:
    """Indexes that together hold every test item with a word. Document frequencies are counted over all items in Spark.

    A probe is a run of at most HALF words of an item, so that it fits into a passage."""
    schema = "item long, text string, part int, size int, terms map<string,int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item"], pdf["text"]):
                words = terms_of(text)
                n = -(-len(words) // HALF)
                for part in range(n):
                    own = words[part * len(words) // n : (part + 1) * len(words) // n]
                    rows.append((item, text, part, len(own), dict(Counter(grams(own)))))
            yield pd.DataFrame(rows, columns=["item", "text", "part", "size", "terms"])

    items = bench.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).dropna().distinct()
    probes = cut(items.mapInPandas(tidy(run), schema).withColumn("probe", F.xxhash64("item", "text", "part")), "probes")
    n, mean, postings = probes.agg(F.count("*"), F.avg("size"), F.sum(F.size("terms"))).first()
    if not n:
        return
    flat = probes.select("probe", "size", F.explode("terms").alias("term", "tf"))
    df = flat.groupBy("term").agg(F.count("*").alias("df"))
    bm25 = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
    weights = flat.join(df, "term").select("probe", "term", bm25.alias("w"))
    weights = cut(weights.join(weights.groupBy("probe").agg(F.sum("w").alias("all")), "probe").select("probe", "term", (F.col("w") / F.col("all")).alias("w")), "weights")
    shards = -(-postings // shard_postings)
    for shard in range(shards):
        mine = F.pmod(F.col("probe"), F.lit(shards)) == shard
        own = [tuple(r) for r in probes.filter(mine).select("probe", "item", "text").orderBy("item", "part").collect()]
        number = {r[0]: i for i, r in enumerate(own)}
        yield Index([r[1:] for r in own], [(r[1], number[r[0]], r[2]) for r in weights.filter(mine).collect()])


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, overlap: float = 0.8, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """Rows (doc_id, item_id, score, question_overlap, answer_overlap): documents that hold a test item.

    Every passage of every document is a query. A pair is retrieved if a passage scores at least `least` of the score that
    the item gives itself, and kept if `overlap` of the question's 5-word shingles and of the answer's words stand near it.
    Null and empty texts match nothing; an empty benchmark gives no rows; repeated ids keep their rows.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    parts = []
    for index in index_shards(bench, shard_postings=shard_postings):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            index = held.value
            for pdf in batches:
                rows = [(doc, item, *m) for doc, text in zip(pdf["id"], pdf["t"]) for item, m in index.matches(text, least, overlap).items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        parts.append(src.mapInPandas(tidy(run), schema))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
