"""The stream operators against plain loops over the same events."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkveil.streaming import limits

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def stream(spark, tmp_path):
    """The events as a stream of four files, in the order of time, a tenth of the seconds apart."""
    e = spark.read.parquet(EVENTS).select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), F.timestamp_seconds((F.unix_timestamp(F.col("ts").cast("timestamp")) / 1000).cast("long")).alias("ts"))
    e.repartitionByRange(4, "ts", "request_id").write.parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), str(tmp_path / "state")


def ran(df, name, at, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_fixed_windows(stream):
    events, source, at = stream
    got = {(r["client"], r["start"].timestamp()): (r["n"], r["limited"]) for r in ran(limits.fixed_windows(source, 2), "windows", at, "complete")}
    want = Counter((r["client"], r["ts"].timestamp() // 60 * 60) for r in events.collect())
    assert got == {k: (n, n > 2) for k, n in want.items()}


def test_token_bucket(stream):
    events, source, at = stream
    got = {r["request_id"]: r["admitted"] for r in ran(limits.token_bucket(source, 0.01, 2), "buckets", at, "append")}
    want, state = {}, {}
    for r in sorted(events.collect(), key=lambda r: (r["ts"], r["request_id"])):
        t = r["ts"].timestamp()
        tokens, last = state.get(r["client"], (2.0, t))
        tokens = min(2.0, tokens + (t - last) * 0.01)
        want[r["request_id"]] = tokens >= 1
        state[r["client"]] = (tokens - (tokens >= 1), t)
    assert len(got) == events.count() and set(got) == set(want)
    assert set(got.values()) == {True, False}
    assert got == want


def test_queue_labels_each_file_once(spark, tmp_path):
    """Files that come later, a restart, and a batch that broke off half way."""
    import os
    import time

    from inkveil.streaming import queue

    seen = []

    def add(n, at):
        spark.range(10 * n, 10 * n + 10).coalesce(1).write.parquet(f"{tmp_path}/made{n}")
        name = next(f for f in os.listdir(f"{tmp_path}/made{n}") if f.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{tmp_path}/made{n}/{name}", f"{tmp_path}/in/{n}.parquet")
        os.utime(f"{tmp_path}/in/{n}.parquet", (at, at))

    def label(batch):
        seen.append(batch.agg(F.min("id")).first()[0])
        if fail and seen[-1] == fail[0]:
            raise ValueError("broken off")
        return batch.withColumn("label", F.col("id") * 2)

    now, fail = time.time() - 1000, []
    run = lambda: queue.label_files(spark, f"{tmp_path}/in", spark.range(1).schema, label, f"{tmp_path}/out", f"{tmp_path}/state")
    add(0, now + 20), add(1, now), add(2, now + 10)
    assert run().count() == 30 and seen == [10, 20, 0]  # oldest first
    assert run().count() == 30 and len(seen) == 3
    add(3, now + 30)
    fail.append(30)
    with pytest.raises(Exception, match="broken off"):
        run()
    fail.clear()
    rows = run()
    assert rows.count() == 40 and rows.select("id").distinct().count() == 40 and seen == [10, 20, 0, 30, 30]


def test_idle_bucket_is_dropped(spark, tmp_path):
    """A client that comes back after the idle time finds a full bucket; times are seconds of the event clock."""
    rows = [[(1, "a", 0), (2, "a", 1), (3, None, 1)], [(4, "b", 10_000)], [(5, "a", 10_001), (6, "a", 10_001)], [(7, "a", None)]]
    schema = "request_id long, client string, s long"
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).selectExpr("request_id", "client", "timestamp_seconds(1000000 + s) AS ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{n}")
    source = spark.readStream.schema("request_id long, client string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    got = {r["request_id"]: r["admitted"] for r in ran(limits.token_bucket(source, 1e-9, 1, idle_ms=1000), "idle", f"{tmp_path}/state", "append")}
    assert got[1] and not got[2] and got[3] and got[4] and 7 not in got
    assert got[5] and not got[6]
