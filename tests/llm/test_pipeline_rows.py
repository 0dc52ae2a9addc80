"""Repeated rows and null ids through the stages that drop rows or passages."""

import corpus_pipeline
from pyspark.sql import functions as F

from test_operators import prose


def stage(f, spark, rows, sf_dir=""):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    return sorted(((r["doc_id"], " ".join((r["text"] or "").split())) for r in f(spark, df, sf_dir).collect()), key=str)


def test_rows_are_told_apart(spark, tmp_path):
    p, q = prose(1, 70), prose(2, 70)
    own = [prose(10 + i, 40) for i in range(5)]
    rows = [(1, own[0] + "\n" + p), (1, own[1] + "\n" + p), (1, q), (1, q), (None, own[2] + "\n" + p), (None, q + "\n" + own[3])]
    got = stage(corpus_pipeline.substring_dedup, spark, rows)
    words = " ".join(t for _, t in got)
    assert words.count(p) == 1 and words.count(q) == 1 and all(words.count(o) == 1 for o in own[:4])
    assert (None, own[2]) in got and (None, own[3]) in got
    spark.createDataFrame([(1, p)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, own[0] + " " + p), (1, own[1]), (None, own[2] + " " + p), (None, own[3])]
    assert stage(corpus_pipeline.decontaminate, spark, rows, str(tmp_path)) == sorted([(1, own[1]), (None, own[3])], key=str)
