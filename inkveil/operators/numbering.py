"""Row numbers over whole tables without a window over one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the keys are divided into; also the rows that are summed in one partition.
RANGES = 64


def numbered(df: DataFrame, key: str, ranges: int = RANGES) -> DataFrame:
    """`df` with rn, its row number from 1 in the order of the numeric column `key` (nulls first), and total, the count of rows.

    Approximate quantiles divide the keys into at most `ranges` ranges; rows are numbered inside each and the counts of the
    ranges before are added, so the numbers are exact however well the quantiles fit. Rows with equal keys share a range
    and are numbered in any order. An empty table gives no rows.
    """
    bounds = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)])).first()[0] or []
    at = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < F.col(key))) if bounds else F.lit(0)
    ranged = df.withColumn("_range", at)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    everything = Window.partitionBy(F.lit(0))
    counts = counts.select(
        "_range", (F.sum("_n").over(everything.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(everything).alias("total")
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(key).asc_nulls_first()))
    return ranged.join(F.broadcast(counts), "_range").withColumn("rn", F.col("_before") + inside).drop("_range", "_before")
