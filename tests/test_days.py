"""Records by day: retention, erasure, and plans of log files."""

import datetime as dt
import os

from pyspark.sql import functions as F

from inkveil.sources import days, logs


def files_of(at):
    return {os.path.relpath(os.path.join(d, f), at): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(at) for f in fs if f.endswith(".parquet")}


def test_retention_and_erasure(spark, tmp_path):
    at = str(tmp_path / "records")
    today = dt.date(2024, 6, 1)
    sinks = ["standard", "personal", "sensitive", "other"]
    rows = [(i, sinks[i % 4], dt.datetime(2024, 6, 1, 12) - dt.timedelta(days=i // 4), f"u{i % 9}" if i % 7 else None) for i in range(480)] + [(1000, "personal", None, "u1")]
    days.append(spark.createDataFrame(rows, "n int, sink string, ts timestamp, who string"), at, "ts")
    kept = {(s, r[0]) for r in rows for s in [r[1]] if r[2] is None or r[2].date() >= today - dt.timedelta(days=logs.DAYS.get(s, 90))}
    gone = days.purge(spark, at, today, logs.DAYS)
    assert gone and len(gone) == len({(r[1], r[2].date()) for r in rows if (r[1], r[0]) not in kept})
    assert {(r.sink, r.n) for r in days.read(spark, at).collect()} == kept
    assert days.purge(spark, at, today, logs.DAYS) == []
    before = files_of(at)
    days.erase(spark, at, (F.col("who") == "u1") & (F.col("sink") == "personal"), {"who": F.lit(logs.REDACTED)})
    after = {(r.n, r.who) for r in days.read(spark, at).collect()}
    assert after == {(n, logs.REDACTED if who == "u1" and s == "personal" else who) for n, s, _, who in rows if (s, n) in kept}
    same = {k for k, v in files_of(at).items() if before.get(k) == v}
    assert all(k in same for k in before if not k.startswith("sink=personal"))
    days.erase(spark, at, F.col("who") == "nobody", {"who": F.lit("x")})
    assert {(r.n, r.who) for r in days.read(spark, at).collect()} == after


def test_no_records(spark, tmp_path):
    at = str(tmp_path / "none")
    none = spark.createDataFrame([], "n int, sink string, ts timestamp, who string")
    days.append(none, at, "ts")
    assert days.purge(spark, at, dt.date(2024, 6, 1), logs.DAYS, none.schema) == []
    days.erase(spark, at, F.col("who") == "u1", {"who": F.lit("x")}, none.schema)
    assert days.read(spark, at, none.schema).count() == 0


def test_files(spark, tmp_path):
    now = dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc)
    for name, age in [("standard/standard.log", 91), ("standard/standard.2024.log", 91), ("standard/s2.log", 89), ("personal/personal.log", 29), ("personal/old.log", 31), ("sensitive/sensitive.log", 16), ("sensitive/x.log.1", 15), ("else.log", 89)]:
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("{}")
        when = now.timestamp() - age * 86400
        os.utime(p, (when, when))
    plan = days.files(spark, str(tmp_path), F.lit("2024-06-01 00:00:00").cast("timestamp"), logs.DAYS)
    got = {r.file.split(str(tmp_path) + "/")[1]: (r.sink, r.action, r.bytes) for r in plan.collect()}
    assert got == {
        "standard/standard.log": ("standard", "rotate", 2), "standard/standard.2024.log": ("standard", "drop", 2), "standard/s2.log": ("standard", "keep", 2), "personal/personal.log": ("personal", "keep", 2),
        "personal/old.log": ("personal", "drop", 2), "sensitive/sensitive.log": ("sensitive", "rotate", 2), "sensitive/x.log.1": ("sensitive", "keep", 2), "else.log": ("standard", "keep", 2),
    }
