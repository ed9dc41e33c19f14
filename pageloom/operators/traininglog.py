"""Questions to a training log: the best epoch and the longest wait for a better one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pageloom.operators import slices


def best_and_patience(df: DataFrame, series: list[str], order: str, metric: str) -> DataFrame:
    """Per series: the best value, its earliest place, and the longest run of rows without a strictly better value.

    Rows that are better than all before them are found range by range (slices.in_slices): first against the rows of their
    range, and those few then against the best of the earlier ranges. order is unique within a series."""
    by, own = [F.col(order)], [*series, slices.SLICE]
    sliced = slices.in_slices(df.select(*series, order, metric), series, by)
    best = F.max(metric).over(Window.partitionBy(*own).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    local = sliced.withColumn("__place", F.row_number().over(Window.partitionBy(*own).orderBy(*by))).withColumn("__better", best.isNull() | (F.col(metric) > best))
    before = slices.carried(sliced, series, {"n_before": F.count(F.lit(1)), "__best": F.max(metric)})
    better = slices.joined(local.filter("__better"), before, series).filter(F.col("__best").isNull() | (F.col(metric) > F.col("__best")))
    # a wait lies between two better rows, or after the last one; first within a range, then across ranges
    placed = better.withColumn("__at", F.col("__place") + F.coalesce("n_before", F.lit(0)))
    waits = placed.withColumn("__wait", F.col("__at") - F.lag("__at").over(Window.partitionBy(*own).orderBy("__at")) - 1)
    ends = sliced.groupBy(*series).agg((F.count(F.lit(1)) + 1).alias("__n"), F.max(F.struct(F.col(metric).alias("v"), (-F.col(order)).alias("o"))).alias("__top"))
    ranges = waits.groupBy(*own).agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"), F.max("__wait").alias("__inside"))
    last = ends.select(*series, F.lit((1 << 31) - 1).alias(slices.SLICE), F.col("__n").alias("__first"), F.col("__n").alias("__last"), F.lit(0).cast("long").alias("__inside"))
    between = F.col("__first") - F.lag("__last").over(Window.partitionBy(*series).orderBy(slices.SLICE)) - 1
    longest = ranges.unionByName(last).withColumn("__between", between).groupBy(*series).agg(F.greatest(F.max("__inside"), F.max("__between")).alias("longest_wait"))
    top: Column = F.col("__top")
    return slices.joined(ends, longest, series).select(*series, top["v"].alias("best"), (-top["o"]).alias("best_at"), "longest_wait")
