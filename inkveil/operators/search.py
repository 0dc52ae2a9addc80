"""Search in pages of words with boxes: terms, phrases, and what stands in a box. Words are rows (doc_id, page, idx, w, x0, y0, x1, y1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.operators import entities

#: ASCII punctuation, stripped from both ends of words.
PUNCTUATION = r"""!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"""
NEAR = 10
_BOX = ["x0", "y0", "x1", "y1"]


def bare(word: Column | str) -> Column:
    """A word without punctuation at its ends."""
    return F.regexp_replace(F.col(word) if isinstance(word, str) else word, f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", "")


def terms(words: DataFrame, wanted: DataFrame, case: bool = False) -> DataFrame:
    """Words that are one of the terms (column term) without punctuation at the ends; a semi-join, so any number of terms."""
    fold = (lambda c: c) if case else F.lower
    keys = wanted.select(fold(bare("term")).alias("_k")).filter("_k <> ''").distinct()
    return words.withColumn("_k", fold(bare("w"))).join(keys, "_k", "left_semi").drop("_k")


def padded(words: DataFrame, top: float = 2, bottom: float = 2) -> DataFrame:
    """Words with boxes a little lower and flatter."""
    return words.withColumns({"y0": F.col("y0") + top, "y1": F.col("y1") - bottom})


def entity_words(found: DataFrame, words: DataFrame) -> DataFrame:
    """Page words equal to a word of an entity's text (doc_id, page, original_text), each once."""
    token = found.select("doc_id", "page", F.explode(F.split(F.trim("original_text"), r"\s+")).alias("w")).filter("w <> ''").distinct()
    return words.join(token, ["doc_id", "page", "w"], "left_semi").select(words.columns)


def in_box(words: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Words whose centre is in the box, edges included."""
    return words.filter(((F.col("x0") + F.col("x1")) / 2).between(x0, x1) & ((F.col("y0") + F.col("y1")) / 2).between(y0, y1))


def islands(words: DataFrame) -> DataFrame:
    """Runs of words with neighbouring numbers: (doc_id, page, first, n, phrase, box)."""
    run = F.col("idx") - F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("idx"))
    own = F.array_sort(F.collect_list(F.struct("idx", "w")))
    out = words.withColumn("_r", run).groupBy("doc_id", "page", "_r").agg(F.min("idx").alias("first"), F.count("*").alias("n"), F.array_join(F.transform(own, lambda x: x["w"]), " ").alias("phrase"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return out.drop("_r")


def phrase_places(words: DataFrame, phrase: str) -> DataFrame:
    """Boxes (doc_id, page, x0, y0, x1, y1) of a phrase: of words equal to a single one without punctuation, else of every occurrence in the page's text."""
    if len(phrase.split()) == 1:
        rows = words.select("doc_id", "page", F.inline("words")) if "words" in words.columns else words
        return rows.filter(bare("w") == bare(F.lit(phrase))).select("doc_id", "page", *_BOX)
    return _places(entities.paged(words), F.lit(phrase))


def _places(pages: DataFrame, phrase: Column) -> DataFrame:
    """Boxes (doc_id, page, x0, y0, x1, y1) of every occurrence of a phrase in the pages' texts, found where the page is, without a shuffle."""
    p = F.trim(phrase)
    one = F.struct("words", F.array_join(F.transform("words", lambda x: x["w"]), " ").alias("_t"), p.alias("_q"))
    # filtered in an array of one: Spark would move a filter of rows below what makes the words, and make them twice
    texts = pages.select("doc_id", "page", F.inline(F.filter(F.array(one), lambda x: F.contains(x["_t"], x["_q"]))))
    found = texts.withColumn("spans", F.transform(entities.occurrences("_t", "_q"), lambda at: F.struct(at.alias("start"), (at + F.length("_q")).alias("end"))))
    return entities.boxed(found).select("doc_id", "page", *_BOX)


def phrase_in_box(words: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """For each document the first run of words in the box, by page and place, whose own box equals it up to NEAR: (doc_id, page, first, n, phrase)."""
    target = dict(zip(_BOX, (x0, y0, x1, y1)))
    close = lambda c: F.abs(F.col(c) - target[c]) < NEAR
    runs = islands(in_box(words, x0, y0, x1, y1)).filter(close("x0") & close("y0") & close("x1") & close("y1"))
    return runs.groupBy("doc_id").agg(F.min_by(F.struct("page", "first", "n", "phrase"), F.struct("page", "first")).alias("b")).select("doc_id", "b.*")


def first_run(words: Column | str, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Of a page's words, an array in order, the first run in the box whose own box equals it up to NEAR, as a struct (first, n, phrase); null without one."""
    target = dict(zip(_BOX, (x0, y0, x1, y1)))
    inside = F.filter(words, lambda w: ((w["x0"] + w["x1"]) / 2).between(x0, x1) & ((w["y0"] + w["y1"]) / 2).between(y0, y1))
    begins = lambda own: F.filter(F.transform(own, lambda w, i: F.when(F.get(own, i - 1)["idx"] == w["idx"] - 1, None).otherwise(i)), lambda i: i.isNotNull())
    runs = lambda own, at: F.transform(at, lambda i, k: F.slice(own, i + 1, F.coalesce(F.get(at, k + 1), F.size(own)) - i))
    end = lambda run, c: (F.array_min if c in ("x0", "y0") else F.array_max)(F.transform(run, lambda w: w[c]))
    close = lambda run: reduce(lambda p, c: p & (F.abs(end(run, c) - target[c]) < NEAR), _BOX, F.lit(True))
    found = lambda run: F.struct(run[0]["idx"].alias("first"), F.size(run).alias("n"), F.array_join(F.transform(run, lambda w: w["w"]), " ").alias("phrase"))
    # words in the box, and then the places where runs begin, are taken once, as what a function is given
    every = F.transform(F.array(inside), lambda own: F.transform(F.array(begins(own)), lambda at: F.transform(F.filter(runs(own, at), close), found)))
    return F.get(F.flatten(F.flatten(every)), F.lit(0))


def like_box(words: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """All places, in a document, of the phrase that stands in a box there. Pages come to their document's phrase; see `like_run` where a document is one row."""
    pages = entities.paged(words)
    runs = pages.select("doc_id", "page", first_run("words", x0, y0, x1, y1).alias("run")).filter("run is not null")
    return like_run(pages.join(runs.groupBy("doc_id").agg(F.min_by("run", F.struct("page")).alias("run")), "doc_id"))


def like_run(pages: DataFrame) -> DataFrame:
    """Boxes (doc_id, page, x0, y0, x1, y1) of all places of a phrase in its document's pages (doc_id, page, words, run), each with the run of `first_run`; nothing is shuffled."""
    own = pages.select("doc_id", "page", "words", F.col("run.phrase").alias("_p"), F.col("run.n").alias("_n"))
    single = own.filter("_n = 1").select("doc_id", "page", F.inline(F.filter("words", lambda x: bare(x["w"]) == bare("_p")))).select("doc_id", "page", *_BOX)
    return single.unionByName(_places(own.filter("_n > 1"), F.col("_p")))
