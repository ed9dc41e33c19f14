"""Running numbers over long ordered groups, in as many tasks as there are ranges.

A window over a whole group runs in one task, however long the group is. Here rows are dealt by ranges of (key, order), windows
run within a range, and what came before a range follows from one row per key and range. Rows that are equal in key and order
lie in one range. Null orders come first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pageloom.sources.shared import materialize

SLICE = "__slice"


def in_slices(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """df with __slice, the number of its range; written, so that ranges are the same for all that reads them."""
    dealt = df.repartitionByRange(*[F.col(k) for k in key], *order)
    return materialize(dealt.withColumn(SLICE, F.spark_partition_id()))


def within(key: list[str], order: list[Column]):
    """The window over a key's rows of one range, up to the current row."""
    return Window.partitionBy(*key, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def carried(sliced: DataFrame, key: list[str], sums: dict[str, Column], backwards: bool = False) -> DataFrame:
    """key, __slice and, for each of sums (name to aggregate), its total over the key's earlier ranges (or later ones); null in
    the first. Aggregates over ranges are summed if their name begins with n_, else the greatest counts."""
    small = sliced.groupBy(*key, SLICE).agg(*[c.alias(n) for n, c in sums.items()])
    at = F.col(SLICE).desc() if backwards else F.col(SLICE)
    before = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return small.select(*key, SLICE, *[(F.sum(n) if n.startswith("n_") else F.max(n)).over(before).alias(n) for n in sums])


def joined(local: DataFrame, small: DataFrame, key: list[str]) -> DataFrame:
    """local with the columns of small (key, perhaps __slice, others); null keys match null keys."""
    on = [k for k in (*key, SLICE) if k in small.columns]
    other = small.withColumnsRenamed({k: f"__of_{k}" for k in on})
    return local.join(other, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in on]).drop(*[f"__of_{k}" for k in on])


def numbered(df: DataFrame, key: list[str], order: list[Column], name: str) -> DataFrame:
    """df with the row number of each row by order within key."""
    sliced = in_slices(df, key, order)
    local = sliced.withColumn(name, F.row_number().over(Window.partitionBy(*key, SLICE).orderBy(*order)))
    whole = joined(local, carried(sliced, key, {"n_before": F.count(F.lit(1))}), key)
    return whole.withColumn(name, (F.col(name) + F.coalesce("n_before", F.lit(0))).cast("int")).select(*df.columns, name)
