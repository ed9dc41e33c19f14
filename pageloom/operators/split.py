"""Train and validation splits."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def validation_size(n: int, share: float) -> int:
    """At least one; halves go to the even neighbour."""
    return max(1, round(n * share)) if n else 0


def seeded_shuffle_split(names: list[str], share: float = 0.2, seed: int = 42) -> tuple[list[str], list[str]]:
    """(train, validation) of a driver-side list: a seeded shuffle whose head is the validation part."""
    order = list(names)
    random.Random(seed).shuffle(order)
    n = validation_size(len(order), share)
    return order[n:], order[:n]


def rank_digest(key: str | Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def hash_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with ``split``: the validation rows are those whose seeded digests rank first, exactly validation_size of them.

    No global sort: counts of 65,536 digest ranges find the range in which the validation part ends, and only that range's
    rows are ranked. key must be unique."""
    ranked = df.withColumn("_d", rank_digest(key, seed)).withColumn("_b", F.conv(F.substring("_d", 1, 4), 16, 10).cast("int"))
    sizes = sorted((r["_b"], r["n"]) for r in ranked.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect())
    left, edge = validation_size(sum(n for _, n in sizes), share), -1
    for b, n in sizes:
        if n > left:
            edge = b
            break
        left -= n
    else:
        edge = 1 << 16
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_d", key))
    inside = ranked.filter(F.col("_b") == edge).withColumn("split", F.when(place <= left, F.lit("val")).otherwise(F.lit("train")))
    others = ranked.filter(F.col("_b") != edge).withColumn("split", F.when(F.col("_b") < edge, F.lit("val")).otherwise(F.lit("train")))
    return inside.unionByName(others).drop("_d", "_b")


def leakage(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys that train in one run and validate in the other."""
    train = first.filter("split = 'train'").select(key)
    return train.intersect(second.filter("split = 'val'").select(key))


def overlap(labels: DataFrame, key: str = "stem") -> DataFrame:
    """Keys that one run has on both sides."""
    return labels.filter("split = 'train'").select(key).intersect(labels.filter("split = 'val'").select(key))
