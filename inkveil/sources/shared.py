"""Folders that all executors reach, for tables that a stream writes and reads again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, in a folder of this machine if the master is a local one, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        at = "file://" + os.path.join(tempfile.gettempdir(), "inkveil-shared")
    return f"{at.rstrip('/')}/inkveil-{kind}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders, in whatever store they are."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
