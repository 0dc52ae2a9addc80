"""Queries that run streams over the given tables until all that is there has been read, with DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators import patterns
from inkveil.sources.shared import scratch
from inkveil.streaming import limits, queue

RATE, BURST = 1 / 4096, 2.0


def token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events a token bucket for each user admits."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # as a pattern, for a stream's path can't name a single file
    requests = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    at = scratch(spark, "buckets")
    out = limits.token_bucket(requests, RATE, BURST, idle_ms=int(1000 * BURST / RATE))
    out.writeStream.format("parquet").outputMode("append").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows")


def auto_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by type of each document, labelled from a queue of files."""
    at = scratch(spark, "queue")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.repartitionByRange(8, "doc_id").write.parquet(f"{at}/in")
    label = lambda batch: patterns.detect(batch).groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"))
    return queue.label_files(spark, f"{at}/in", docs.schema, label, f"{at}/out", f"{at}/state", 4).select("doc_id", "entity_type", "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"token_buckets": token_buckets, "auto_labels": auto_labels}
SQL: dict[str, str] = {
    "token_buckets": f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE ts IS NOT NULL),
b AS (SELECT event_id, user_id, t, k, {BURST}::DOUBLE AS held FROM e WHERE k = 1
UNION ALL SELECT e.event_id, e.user_id, e.t, e.k, least({BURST}::DOUBLE, b.held - CASE WHEN b.held >= 1 THEN 1 ELSE 0 END + (e.t - b.t) * (1 / 4096.0)::DOUBLE) FROM b JOIN e ON e.user_id IS NOT DISTINCT FROM b.user_id AND e.k = b.k + 1)
SELECT event_id AS request_id, user_id AS client, held >= 1 AS admitted FROM b""",
    "auto_labels": f"SELECT doc_id, entity_type, count(*) AS n FROM ({patterns.DETECT_SQL}) d GROUP BY doc_id, entity_type",
}
