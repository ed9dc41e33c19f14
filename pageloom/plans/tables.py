"""The driver's tables as the registered queries read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corner_boxes(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_returnflag") == "R", "chemical_structure").when(F.col("l_returnflag") == "A", "reaction_scheme").otherwise("arrow")
    return line.select(*LINE, label.alias("label"), (F.col("l_discount") * 10).alias("x0"), (F.col("l_tax") * 12).alias("y0"), (F.col("l_quantity") / 50).alias("x1"), (F.col("l_quantity") / 50).alias("y1"), *more)


BOXES_SQL = """
raw AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE l_returnflag WHEN 'R' THEN 'chemical_structure' WHEN 'A' THEN 'reaction_scheme' ELSE 'arrow' END AS label,
         l_discount * 10 AS x0, l_tax * 12 AS y0, l_quantity / 50 AS x1, l_quantity / 50 AS y1
  FROM lineitem
), clamped AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, label,
         least(greatest(least(x0, x1), 0.0), 1.0) AS x0, least(greatest(greatest(x0, x1), 0.0), 1.0) AS x1,
         least(greatest(least(y0, y1), 0.0), 1.0) AS y0, least(greatest(greatest(y0, y1), 0.0), 1.0) AS y1
  FROM raw WHERE label <> 'arrow'
), boxes AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, label, CASE label WHEN 'chemical_structure' THEN 0 ELSE 1 END AS cls,
         (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x1 - x0 AS w, y1 - y0 AS h
  FROM clamped WHERE x1 - x0 > 0 AND y1 - y0 > 0
)"""
