"""Records kept in a folder for each sink and day: appending, retention by whole days, and erasure that rewrites only the days it touches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.sources.shared import removed, scratch


def append(rows: DataFrame, path: str, time_col: str) -> None:
    """Append rows (sink, ...) as Parquet under sink=/date=, the date of `time_col`; a big day is dealt out to several tasks and files."""
    rows.withColumn("date", F.to_date(time_col)).hint("rebalance", "sink", "date").write.mode("append").partitionBy("sink", "date").parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All records; filters on sink and date choose folders. A folder that may hold no record needs the `schema` of the records, here and below."""
    reader = spark.read if schema is None else spark.read.schema(T.StructType([f for f in schema if f.name != "date"]).add("date", "date"))
    return reader.parquet(path).withColumn("sink", F.col("sink").cast("string")).withColumn("date", F.col("date").cast("date"))


def expired(spark: SparkSession, path: str, today: dt.date, days: dict[str, int], schema: T.StructType | None = None) -> DataFrame:
    """Rows (sink, date) of the folders that are older than their sink's days; other sinks are kept as long as the first one, records without a time for good."""
    limit = F.lit(next(iter(days.values())))
    for sink, n in days.items():
        limit = F.when(F.col("sink") == sink, n).otherwise(limit)
    return read(spark, path, schema).select("sink", "date").distinct().filter(F.col("date") < F.date_sub(F.lit(today), limit))


def purge(spark: SparkSession, path: str, today: dt.date, days: dict[str, int], schema: T.StructType | None = None) -> list[tuple[str, dt.date]]:
    """Delete the expired folders and say which; the driver gets a row for each folder, never records.

    A folder goes as a whole, so no record is read or written, and to do it again does nothing."""
    old = sorted((r.sink, r.date) for r in expired(spark, path, today, days, schema).collect())
    removed(spark, [f"{path}/sink={sink}/date={date}" for sink, date in old])
    return old


def erase(spark: SparkSession, path: str, match: Column, new: dict[str, Column], schema: T.StructType | None = None) -> None:
    """Put the values of `new` into the records that `match`, and rewrite the folders that hold such records and no others.

    A null match counts as none. The folders' rows are written apart first and then replace the folders, so an erasure that was cut short can
    be done again. Nothing is rewritten where nothing matches."""
    rows = read(spark, path, schema)
    hit = F.coalesce(match, F.lit(False))
    touched = rows.filter(hit).select(F.col("sink").alias("_s"), F.col("date").alias("_d")).distinct()
    whole = rows.join(touched, F.col("sink").eqNullSafe(F.col("_s")) & F.col("date").eqNullSafe(F.col("_d")), "left_semi")
    staged = scratch(spark, "erasure")
    whole.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}).write.partitionBy("sink", "date").parquet(staged)
    again = spark.read.schema(rows.schema).parquet(staged)
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sink", "date").parquet(path)
    removed(spark, [staged])


def files(spark: SparkSession, path: str, now: Column, days: dict[str, int]) -> DataFrame:
    """Rows (file, sink, modified, bytes, action) of a folder's log files, by their names and times alone: keep, rotate or drop.

    The sink is the folder or the start of the name. A file older than its sink's days is dropped, or rotated if it is the one being
    written (`<sink>.log`). Other sinks are kept as long as the first one. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.log*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    sink = F.coalesce(F.nullif(F.regexp_extract("path", rf"[/=]({'|'.join(days)})[^/]*(?:/[^/]*)?$", 1), F.lit("")), F.lit(next(iter(days))))
    limit = F.lit(next(iter(days.values())))
    for s, n in days.items():
        limit = F.when(F.col("sink") == s, n).otherwise(limit)
    rows = found.select(F.col("path").alias("file"), sink.alias("sink"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), name.isin([f"{s}.log" for s in days]).alias("_active"))
    old = F.col("modified") < now - F.make_dt_interval(limit)
    return rows.withColumn("action", F.when(~old, "keep").when(F.col("_active"), "rotate").otherwise("drop")).drop("_active")
