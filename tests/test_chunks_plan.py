"""Chunks that end at boundaries are made without Python, which held whole batches of texts."""

from pyspark.sql import functions as F

from inkveil.functions import chunking
from inkveil.plans.catalogue import QUERIES


def test_chunks_need_no_python(spark):
    assert "Python" not in QUERIES["boundary_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    rows = [(None, None), ("", [""]), ("a" * 5, ["a" * 5]), ("😀" * 6, ["😀" * 5, "😀"]), ("a\n\nb c d", ["a\n\n", "b c d"]), (" . b. \nx", [" . ", "b. \nx"]), ("ab\\Ecdef", ["ab\\Ec", "def"])]
    got = spark.createDataFrame(rows, "t string, want array<string>").select(chunking.boundary_chunks("t", 5).alias("got"), F.col("want")).collect()
    assert all(r.got == r.want for r in got)
