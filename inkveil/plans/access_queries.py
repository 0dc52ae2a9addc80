"""Queries on quotas of calls, on persons in masked logs and on records by day, with DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators import quota
from inkveil.sources import days, logs, subjects
from inkveil.sources.shared import scratch

MOST, AT_ONCE, GAP, SECONDS = 200, 4, 30, 20


def call_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events a daily quota with a cap of concurrent calls and a gap admits as calls, and when they start; a call runs 20 seconds for each unit of value."""
    calls = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("call_id"), "ts", (F.col("value") * SECONDS).alias("seconds"))
    return quota.admitted(calls, MOST, AT_ONCE, GAP)


def _dated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders' days, every other one masked but for its ends, as entries; ship dates of lines as identifiers."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    hidden = F.concat(F.substring(day, 1, 1), F.lit("["), F.substring(day, 5, 4), F.lit("]"), F.substring(day, -1, 1))
    entries = orders.select(F.col("o_orderkey").alias("entry_id"), F.when(F.col("o_orderkey") % 2 == 0, day).otherwise(hidden).alias("value"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    who = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("subject_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("identifier"))
    return entries, who


def masked_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each line's ship date, as an identifier, how many orders' dates equal it, and how many masked ones may be it."""
    return subjects.counts(*_dated(spark, sf_dir))


def retained_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by sink and day after they were written to folders, old folders were deleted and the entries of users 7, 14, 21 and so on erased."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sinks = [F.lit(s) for s in logs.DAYS]
    at = scratch(spark, "days")
    records = events.withColumn("sink", F.coalesce(F.element_at(F.array(*sinks), (F.length("event_type") % 3 + 1).cast("int")), sinks[0])).withColumn("who", F.col("user_id").cast("string"))
    kind = records.schema
    days.append(records, at, "ts")
    today = days.read(spark, at, kind).agg(F.max("date")).first()[0]
    if today is not None:
        days.purge(spark, at, today, logs.DAYS, kind)
    days.erase(spark, at, F.col("user_id") % 7 == 0, {"who": F.lit(logs.REDACTED)}, kind)
    rows = days.read(spark, at, kind).groupBy("sink", "date").agg(F.count("*").alias("n"), F.count_if(F.col("who") == logs.REDACTED).alias("erased"))
    return rows.select("sink", F.date_format("date", "yyyy-MM-dd").alias("day"), "n", "erased")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"call_quota": call_quota, "masked_subjects": masked_subjects, "retained_days": retained_days}
SQL: dict[str, str] = {
    "call_quota": f"""WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) AS a, CAST(ts AS DATE) AS d, greatest(round(value * {SECONDS} * 1e6), 0)::BIGINT AS us, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events WHERE ts IS NOT NULL),
r AS (SELECT NULL::BIGINT AS event_id, d, 0::BIGINT AS k, NULL::BIGINT AS last, []::BIGINT[] AS ends, 0 AS used, NULL::VARCHAR AS reason FROM e WHERE k = 1
UNION ALL SELECT event_id, d, k, CASE WHEN reason IS NULL THEN s ELSE last END, CASE WHEN reason IS NULL THEN list_append(running, s + us) ELSE running END, used + CASE WHEN reason IS NULL THEN 1 ELSE 0 END, reason
FROM (SELECT *, CASE WHEN used >= {MOST} THEN 'quota' WHEN len(running) >= {AT_ONCE} THEN 'busy' END AS reason
FROM (SELECT e.event_id, e.d, e.k, e.us, r.last, r.used, list_filter(r.ends, lambda x: x > greatest(e.a, r.last)) AS running, greatest(e.a, r.last + {GAP * 1_000_000}) AS s FROM r JOIN e ON e.d = r.d AND e.k = r.k + 1) a) b)
SELECT event_id AS call_id, reason IS NULL AS admitted, reason, CASE WHEN reason IS NULL THEN last END AS start_us FROM r WHERE k > 0""",
    "masked_subjects": """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey FROM orders),
v AS (SELECT value, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN day ELSE substr(day, 1, 1) || '[' || substr(day, 5, 4) || ']' || substr(day, -1) END AS value FROM o) t WHERE value IS NOT NULL GROUP BY 1),
l AS (SELECT l_orderkey || '-' || l_linenumber AS subject_id, strftime(l_shipdate, '%Y-%m-%d') AS identifier FROM lineitem WHERE l_shipdate IS NOT NULL),
i AS (SELECT DISTINCT identifier FROM l),
c AS (SELECT i.identifier, coalesce(sum(n) FILTER (WHERE value = identifier), 0)::BIGINT AS exact, coalesce(sum(n) FILTER (WHERE value <> identifier AND contains(value, '[') AND contains(value, ']') AND (contains(value, identifier[1:2]) OR contains(value, identifier[-2:]) OR (value[1] = identifier[1] AND value[-1] = identifier[-1]))), 0)::BIGINT AS masked FROM i, v GROUP BY 1)
SELECT subject_id, identifier, exact, masked FROM l JOIN c USING (identifier)""",
    "retained_days": """WITH e AS (SELECT ['standard', 'personal', 'sensitive'][coalesce(length(event_type), 0) % 3 + 1] AS sink, [90, 30, 15][coalesce(length(event_type), 0) % 3 + 1] AS kept, CAST(ts AS DATE) AS d, user_id FROM events)
SELECT sink, strftime(d, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE user_id % 7 = 0) AS erased FROM e WHERE d IS NULL OR d >= (SELECT max(d) FROM e) - kept::INT GROUP BY sink, d""",
}
