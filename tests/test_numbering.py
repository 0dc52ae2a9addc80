from pyspark.sql import functions as F

from inkveil.operators.numbering import numbered


def test_numbers(spark):
    keys = [None, 5, 5, 5, -3, 10**12, *range(100, 400, 3)]
    got = numbered(spark.createDataFrame([(k, "x") for k in keys], "k long, total2 string"), "k", ranges=7).orderBy("rn").collect()
    assert [r["rn"] for r in got] == list(range(1, len(keys) + 1))
    assert [r["k"] for r in got] == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert {r["total"] for r in got} == {len(keys)}


def test_empty_and_null(spark):
    df = spark.range(3).select(F.lit(None).cast("long").alias("k"))
    assert sorted(r["rn"] for r in numbered(df, "k").collect()) == [1, 2, 3]
    assert numbered(df.limit(0), "k").count() == 0
