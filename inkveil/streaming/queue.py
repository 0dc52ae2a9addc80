"""A queue of files that are labelled once each, oldest first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def label_files(spark: SparkSession, source: str, schema: StructType, label: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_at_once: int = 1) -> DataFrame:
    """All labels of the Parquet files in the folder `source`: those that earlier runs wrote to `out` and those of files that came since.

    A run takes the files that are there, by modification time, `files_at_once` in a batch, and ends. Which files a batch has is
    in `checkpoint` before it is labelled, and a batch writes to a folder with its number, overwriting what a run that broke off left there. So a
    file is labelled once, also if a run is stopped at any place and started again. `label` makes rows from those of a batch."""

    def write(batch: DataFrame, number: int) -> None:
        label(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("latestFirst", "false").parquet(source)
    files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
