"""Matching annotations with images, and names with classes and roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pageloom.functions.text import norm_name


def last_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, and how many rows it replaced (collisions)."""
    place = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    count = Window.partitionBy(key)
    return df.withColumn("_place", F.row_number().over(place)).withColumn("collisions", F.count(F.lit(1)).over(count) - 1).filter("_place = 1").drop("_place")


def matched(annotations: DataFrame, images: DataFrame, left: str = "filename", right: str = "name") -> DataFrame:
    """Annotations with the image of the same normalised name. Spark broadcasts the images where they are small."""
    return annotations.withColumn("norm", norm_name(left)).join(images.withColumn("norm", norm_name(right)), "norm")


def missing(annotations: DataFrame, images: DataFrame, left: str = "filename", right: str = "name") -> DataFrame:
    """Annotations that have no image."""
    return annotations.withColumn("norm", norm_name(left)).join(images.select(norm_name(right).alias("norm")), "norm", "left_anti").drop("norm")


def require_pairs(pairs: DataFrame) -> DataFrame:
    if not pairs.limit(1).count():
        raise ValueError("no annotation has an image")
    return pairs


def with_role(df: DataFrame, aliases: dict[str, list[str]], column: str = "cls") -> DataFrame:
    """The role whose ordered alias list names a class; rows of classes in no list are dropped, the first role wins."""
    role = None
    for name, classes in aliases.items():
        hit = F.col(column).isin(list(classes))
        role = F.when(hit, F.lit(name)) if role is None else role.when(hit, F.lit(name))
    return df.withColumn("role", role if role is not None else F.lit(None).cast("string")).filter("role IS NOT NULL")


def counts_by_class(boxes: DataFrame, classes: list[str] | tuple[str, ...], column: str = "label") -> DataFrame:
    """Boxes per class; classes without any appear with 0."""
    known = boxes.sparkSession.createDataFrame([(i, c) for i, c in enumerate(classes)], f"class_id int, {column} string")
    n = boxes.groupBy(column).agg(F.count(F.lit(1)).alias("boxes"))
    return F.broadcast(known).join(n, column, "left").select(column, "class_id", F.coalesce("boxes", F.lit(0)).alias("boxes"))
