"""Admission of calls under a quota for each day, a cap of concurrent calls and a least gap between starts."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.sources.shared import scratch

#: Seconds of a day that are numbered by one task; a day has at most 86,400 of them.
SLOT = 10
ORDER = ("at", "call_id", "us")


def _before(df: DataFrame, value: Column, how: str) -> DataFrame:
    """`df` with _b: the max or sum of `value` over the day's earlier calls (null if none is).

    Each slot's calls are taken apart; slots are then added up, one row each, so a day never stands in one task."""
    up = F.max if how == "max" else F.sum
    rows = df.withColumn("_v", value)
    past = (Window.unboundedPreceding, -1)
    slots = rows.groupBy("day", "slot").agg(up("_v").alias("_c"))
    slots = slots.select("day", "slot", up("_c").over(Window.partitionBy("day").orderBy("slot").rowsBetween(*past)).alias("_c"))
    rows = rows.withColumn("_l", up("_v").over(Window.partitionBy("day", "slot").orderBy(*ORDER).rowsBetween(*past)))
    both = F.greatest("_l", "_c") if how == "max" else F.coalesce(F.col("_l") + F.col("_c"), "_l", "_c")
    return rows.join(slots, ["day", "slot"]).withColumn("_b", both).drop("_v", "_l", "_c")


def _written(df: DataFrame) -> DataFrame:
    at = scratch(df.sparkSession, "quota")
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def _scheduled(calls: DataFrame, gap: int, slot: int) -> DataFrame:
    """Calls with k (number in the day), start (if every call of the day were admitted) and session (k of its first call).

    A start is the later of the arrival and the start before plus `gap`, which is a running maximum of at - k * gap. A session
    begins where all calls before have ended and their gap is over, whichever of them are admitted: to leave calls out
    only makes the others earlier."""
    rows = _before(calls.withColumn("slot", F.floor(F.col("at") / (slot * 1_000_000))), F.lit(1), "sum")
    rows = rows.withColumn("k", F.coalesce("_b", F.lit(0)) + 1)
    rows = _before(rows, F.col("at") - F.col("k") * gap, "max").withColumn("start", F.greatest("at", F.col("_b") + F.col("k") * gap))
    rows = _written(rows.drop("_b"))
    rows = _before(rows, F.col("start") + F.greatest("us", F.lit(gap)), "max").withColumn("_first", F.when(F.col("_b").isNull() | (F.col("at") >= F.col("_b")), F.col("k")))
    return _before(rows, F.col("_first"), "max").withColumn("session", F.coalesce("_first", "_b")).drop("_first", "_b")


def _folded(rows: DataFrame, at_once: int, gap: int) -> DataFrame:
    """Crowded sessions call by call, with the ends of at most `at_once` calls as state; rows of a session come sorted, in batches."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ends, last = None, [], None
        for pdf in batches:
            ok, starts = [], []
            for day, session, at, us in zip(pdf["day"], pdf["session"], pdf["at"], pdf["us"]):
                if (day, session) != now:
                    now, ends, last = (day, session), [], None
                seen = at if last is None else max(at, last)
                while ends and ends[0] <= seen:
                    heapq.heappop(ends)
                ok.append(len(ends) < at_once)
                if ok[-1]:
                    last = seen if last is None else max(seen, last + gap)
                    heapq.heappush(ends, last + us)
                starts.append(last if last is not None else at)
            yield pdf.assign(ok=ok, start=starts)[[*kind.names[:-1], "ok"]]

    # written first: if the rows came from a join on the same keys, the shuffle would be left out and adaptive execution might divide a large session between tasks
    rows = _written(rows.select("call_id", "day", "slot", "at", "us", "k", "session", "start"))
    kind = rows.withColumn("ok", F.lit(True)).schema
    return rows.repartition("day", "session").sortWithinPartitions("day", "session", "k").mapInPandas(fold, kind)


def admitted(calls: DataFrame, most: int, at_once: int, gap: float, slot: int = SLOT) -> DataFrame:
    """Rows (call_id, admitted, reason, start_us) of calls (call_id, ts, seconds): who is let through, and when.

    Calls are taken in the order of ts, call_id and seconds. One is refused for `quota` if `most` calls of its day are
    admitted before it, else for `busy` if `at_once` admitted ones still run when it is looked at: at its arrival, or when the
    call before it has started. Otherwise it starts `gap` seconds after the last start or at once. Each UTC day stands by
    itself. Null or negative seconds count as 0, equal rows are calls of their own, a null ts is refused as `no time`. start_us
    is microseconds since 1970, null where refused.

    Sessions of at most `at_once` calls admit all, by running maxima over slots of time; longer ones are folded call by call,
    each by one task as a stream of sorted rows, because every decision depends on the one before."""
    if most < 0 or at_once < 1 or gap < 0:
        raise ValueError("most must be 0 or more, at_once 1 or more, gap 0 or more")
    pause = round(gap * 1_000_000)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    us = F.greatest(F.coalesce(F.round(F.col("seconds").cast("double") * 1_000_000), F.lit(0.0)), F.lit(0.0)).cast("long")
    rows = calls.select("call_id", at.alias("at"), us.alias("us"))
    timed = rows.filter("at is not null").withColumn("day", F.floor(F.col("at") / 86_400_000_000))
    timed = _written(_scheduled(timed, pause, slot))
    sizes = timed.groupBy("day", "session").agg((F.count("*") > at_once).alias("_crowded"))
    split = timed.join(sizes, ["day", "session"])
    calm = split.filter("not _crowded").drop("_crowded").withColumn("ok", F.lit(True))
    tried = _written(calm.unionByName(_folded(split.filter("_crowded"), at_once, pause)))
    used = F.coalesce("_b", F.lit(0))
    out = _before(tried, F.col("ok").cast("long"), "sum").withColumn("reason", F.when(used >= most, "quota").when(~F.col("ok"), "busy"))
    out = out.select("call_id", F.col("reason").isNull().alias("admitted"), "reason", F.when(F.col("reason").isNull(), F.col("start")).alias("start_us"))
    return out.unionByName(rows.filter("at is null").select("call_id", F.lit(False).alias("admitted"), F.lit("no time").alias("reason"), F.lit(None).cast("long").alias("start_us")))
