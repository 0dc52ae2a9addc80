"""A model's answers, kept by content: each distinct text is asked once, whatever run or document it comes from."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators.models import LEAST, MOST, groups

Model = Callable[[list[str]], list[list[tuple[int, int, str, float]]]]
ANSWER = "array<struct<entity_type:string,start:int,end:int,score:double,original_text:string>>"
KEPT = f"key string, run string, attempts int, error string, answer {ANSWER}"


def key(text: Column, version: str) -> Column:
    """What an answer is kept under: the text and `version`, which names the model with all its settings."""
    return F.sha2(F.concat(F.sha2(F.lit(version), 256), text), 256)


def ask(texts: DataFrame, model: Model, run: str, attempts: int, pause: float, least: float, most: int) -> DataFrame:
    """Rows of `KEPT` for texts (key, text): a call for each text, tried `attempts` times with pauses that double. The last failure stays as `error`."""

    def one(text: str) -> tuple[int, str | None, list[dict]]:
        own = groups(text, most)
        for n in range(1, attempts + 1):
            try:
                found = model([p for _, p in own]) if own else []
                return n, None, [{"entity_type": kind, "start": at + a, "end": at + b, "score": score, "original_text": piece[a:b]} for (at, piece), spans in zip(own, found) for a, b, kind, score in spans if score >= least]
            except Exception as e:  # whatever the model raises is the text's error
                error = f"{type(e).__name__}: {e}"
                if n < attempts:
                    time.sleep(pause * 2 ** (n - 1))
        return attempts, error, []

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, run, *one(text)) for k, text in zip(pdf["key"], pdf["text"])]
            yield pd.DataFrame(rows, columns=["key", "run", "attempts", "error", "answer"])

    return texts.select("key", "text").mapInPandas(answered, KEPT)


def kept(spark: SparkSession, at: str) -> DataFrame:
    """The table of answers in the folder `at`, as it is now; an empty one is made where there is none."""
    spark.createDataFrame([], KEPT).write.mode("ignore").parquet(at)
    return spark.read.schema(KEPT).parquet(at)


def memoised(docs: DataFrame, model: Model, at: str, version: str, attempts: int = 3, pause: float = 0.1, least: float = LEAST, most: int = MOST) -> DataFrame:
    """Rows (doc_id, page, kept, error, answer), one for each row (doc_id, page, text): the model's entities, and whether they had been kept before.

    Texts without an answer in the folder `at` are asked, each distinct one once (those of a lost task again), and appended there when all have been; an
    answer stands by itself, so a run that is lost leaves nothing wrong behind. A text whose call fails has an `error` and an empty
    answer now, and is asked again by the next run. Null and empty texts aren't asked and have empty answers. Texts are shuffled
    once, by key; only keys are joined back to the documents."""
    spark, run = docs.sparkSession, uuid.uuid4().hex
    keyed = docs.select("doc_id", "page", "text", key(F.col("text"), version).alias("key"))
    have = kept(spark, at).filter("error is null").select("key")
    missing = keyed.filter("text <> ''").groupBy("key").agg(F.any_value("text").alias("text")).join(have, "key", "left_anti")
    ask(missing, model, run, attempts, pause, least, most).write.mode("append").parquet(at)
    # two runs at once may both have asked: the answer of one of them counts, the older one's if it isn't this run's
    known = kept(spark, at).filter((F.col("error").isNull()) | (F.col("run") == run))
    known = known.groupBy("key").agg(F.min_by(F.struct((F.col("run") != run).alias("kept"), "error", "answer"), F.struct(F.col("error").isNotNull(), F.col("run") == run, "run")).alias("a"))
    out = keyed.select("doc_id", "page", F.when(F.col("text") != "", F.col("key")).alias("key")).join(known, "key", "left")
    return out.select("doc_id", "page", F.coalesce("a.kept", F.lit(False)).alias("kept"), "a.error", F.coalesce("a.answer", F.array().cast(ANSWER)).alias("answer"))


def entities(answers: DataFrame) -> DataFrame:
    """The entities of answers as rows (doc_id, page, entity_type, start, end, score, original_text)."""
    return answers.select("doc_id", "page", F.inline("answer"))
