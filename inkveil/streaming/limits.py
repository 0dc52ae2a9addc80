"""Rate limits over streams of requests (client, ts)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def fixed_windows(requests: DataFrame, most: int, width: str = "60 seconds", late: str = "120 seconds") -> DataFrame:
    """Rows (client, start, n, limited): requests of each epoch-aligned window, limited where n is over `most`.

    Null clients form one group; rows with a null ts are left out. Windows older than `late` are closed and dropped from the state."""
    w = requests.filter("ts is not null").withWatermark("ts", late).groupBy("client", F.window("ts", width).alias("w"))
    return w.agg(F.count("*").alias("n")).select("client", F.col("w.start").alias("start"), "n", (F.col("n") > most).alias("limited"))


class Bucket(StatefulProcessor):
    """A client's bucket: its tokens and the newest time seen; a timer drops it when it has been idle."""

    def __init__(self, rate: float, burst: float, idle_ms: int) -> None:
        self.rate, self.burst, self.idle_ms = rate, burst, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, last double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        tokens, last = self.bucket.get() if self.bucket.exists() else (self.burst, None)
        if last is not None and int(last * 1000) + self.idle_ms <= timerValues.getCurrentWatermarkInMs():
            tokens, last = self.burst, None  # its timer is due too, but timers come behind a batch's rows
        pdf = pd.concat(list(rows)).sort_values(["at", "request_id"])
        out = []
        for at in pdf["at"]:
            if last is not None:
                tokens = min(self.burst, tokens + max(0.0, at - last) * self.rate)
            last = at if last is None else max(last, at)
            out.append(tokens >= 1)
            tokens -= out[-1]
        self.bucket.update((float(tokens), float(last)))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(int(last * 1000) + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"request_id": pdf["request_id"].to_numpy(), "client": key[0], "admitted": out})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        return iter(())

    def close(self) -> None:
        pass


def token_bucket(requests: DataFrame, rate: float, burst: float, idle_ms: int = 3_600_000, late: str = "120 seconds") -> DataFrame:
    """Rows (request_id, client, admitted): a request is admitted where the client's bucket holds a token, which it takes.

    A bucket starts full, gains `rate` tokens a second and holds at most `burst`. Requests of a micro-batch are taken in the
    order of ts, then request_id; a clock that goes back adds nothing. State is two numbers a client; a timer drops it when the
    watermark, `late` behind the newest request, is `idle_ms` past the client's last one, which changes nothing if a bucket is full
    again by then (burst / rate seconds). Requests older than the watermark and rows with a null ts are left out. State is held by RocksDB, so
    it needn't fit in memory."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = requests.schema["client"].dataType.simpleString()
    rows = requests.filter("ts is not null").withWatermark("ts", late).select("request_id", "client", "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    return rows.groupBy("client").transformWithStateInPandas(Bucket(rate, burst, idle_ms), f"request_id long, client {kind}, admitted boolean", "Append", "EventTime")
