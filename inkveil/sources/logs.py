"""Log files: reading them as they were written, entries of a person, erasure, retention, and writing by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import masking

ENTRY = "timestamp string, level string, message string, user_id string, username string, email string, ip string, remote_addr string, fields map<string,string>"
REDACTED = "[REDACTED-GDPR]"
#: Days that entries of a category are kept.
DAYS = {"standard": 90, "personal": 30, "sensitive": 15}


def scan(spark: SparkSession, path: str, modified_after: str | None = None) -> DataFrame:
    """Raw lines (value, file) of the .log files under a folder; files not modified since `modified_after` are left out."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.log")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def parsed(lines: DataFrame) -> DataFrame:
    """Typed entries of raw JSON lines, with the line; lines that are no JSON objects go."""
    # given out by a generator, below which no filter is pushed, so that a line is parsed once
    out = lines.filter("trim(value) like '{%'").select("*", F.explode(F.array(F.from_json("value", ENTRY))).alias("e")).filter("e is not null")
    return out.select("*", "e.*").drop("e").withColumn("ts", F.try_to_timestamp("timestamp")).withColumn("ip", F.coalesce("ip", "remote_addr")).drop("remote_addr")


def of_subject(lines: DataFrame, user_id: str | None = None, username: str | None = None, email: str | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Entries of a person: lines are looked through for one of the names first, then parsed and matched by field; times are inclusive."""
    wanted = {"user_id": user_id, "username": username, "email": email}
    wanted = {k: v for k, v in wanted.items() if v}
    if not wanted:
        raise ValueError("a user id, name or e-mail address is needed")
    near = F.lit(False)
    match = F.lit(False)
    for k, v in wanted.items():
        near = near | F.contains(F.lower("value"), F.lit(v.lower()))
        match = match | F.coalesce(F.lower(F.col(k)) == v.lower(), F.lit(False)) | F.coalesce(F.lower(F.col("fields")[k]) == v.lower(), F.lit(False))
    out = parsed(lines.filter(near)).filter(match)
    if since is not None:
        out = out.filter(F.col("ts") >= since)
    return out.filter(F.col("ts") <= until) if until is not None else out


def erased(entries: DataFrame) -> DataFrame:
    """Entries with what names a person redacted, in fields too."""
    out = entries.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(REDACTED)) for c in ("user_id", "username", "email", "ip")})
    return out.withColumn("fields", F.transform_values("fields", lambda k, v: F.when(masking.personal_field(k, v), F.lit(REDACTED)).otherwise(v)))


def categorised(entries: DataFrame, level: str = "medium") -> DataFrame:
    """Entries by the sinks they go to: (sink, message, fields). Personal and sensitive ones go whole to their own sink and sanitised to the standard one."""
    category = masking.log_category("fields")
    copy = "_copy"
    while copy in (c.lower() for c in entries.columns):
        copy += "_"
    # an entry is read, parsed and put into its category once, then doubled
    both = entries.withColumn("sink", category).withColumn(copy, F.explode(F.array(F.lit(False), F.lit(True)))).filter(~F.col(copy) | (F.col("sink") != "standard"))
    sanitised = F.when(F.col(copy), masking.sanitise_fields("fields", level, F.col("sink") == "sensitive")).otherwise(F.col("fields"))
    return both.withColumns({"fields": sanitised, "sink": F.when(F.col(copy), "standard").otherwise(F.col("sink"))}).drop(copy)


def kept(entries: DataFrame, now: Column, days: dict[str, int] = DAYS, category: str = "category", time_col: str = "ts") -> DataFrame:
    """Entries within the retention of their category; other categories are kept as long as the first one."""
    first = next(iter(days.values()))
    limit = F.lit(first)
    for k, v in days.items():
        limit = F.when(F.col(category) == k, F.lit(v)).otherwise(limit)
    return entries.filter(F.col(time_col) >= now - F.make_dt_interval(limit))


def export(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").json(path)


def write(entries: DataFrame, path: str, level: str = "medium") -> None:
    """Append entries to the folders of their sinks as JSON lines."""
    categorised(entries, level).write.mode("append").partitionBy("sink").json(path)
