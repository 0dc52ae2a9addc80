"""Near boxes at the edges of strips against DuckDB, and how often a box is shuffled."""

import random

import duckdb

from inkveil.plans.catalogue import QUERIES, SQL


def test_a_box_is_shuffled_for_its_strip_and_the_one_above(spark, tmp_path):
    rng = random.Random(4)
    ys = [0.0, 30.0, 30.000001, 39.999999, 40.0, 49.999999, 50.0, -0.0, -0.000001, -10.0, -9.999999, 79.9, 85.3, 89.9, 1e300, -1e300, 9e15, 9e15 + 8, 9e15 + 10, float("inf"), float("-inf"), float("nan"), None]
    rows = [(i, rng.choice([1, 2, None]) if i % 9 == 0 else 1, rng.choice(ys)) for i in range(120)] + [(i, rng.randrange(1, 4), round(rng.uniform(-200, 200), 1)) for i in range(120, 700)] + [(5, 1, 30.0), (None, 1, 30.0)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    out = QUERIES["near_equal_boxes"](spark, str(tmp_path))
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(con.execute(SQL["near_equal_boxes"]).fetchall()) and len(got) > 2000
    leaves = out._jdf.queryExecution().executedPlan().executedPlan().plan().collectLeaves()
    written = [x.plan().metrics().apply("shuffleRecordsWritten").value() for x in (leaves.apply(i) for i in range(leaves.size())) if x.plan().nodeName() == "Exchange"]
    assert len(written) == 1 and len(rows) - 100 < written[0] < 1.6 * len(rows)
