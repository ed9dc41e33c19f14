"""Readers: page images, crops, annotations, label files, training logs, command lines."""

from __future__ import annotations

import argparse
import ast
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from pageloom import schemas
from pageloom.functions.text import extension, norm_name
from pageloom.operators.match import last_per_key
from pageloom.operators.slices import numbered


def images(spark: SparkSession, path: str, extensions: tuple[str, ...] = schemas.PAGE_EXTENSIONS, content: bool = True) -> DataFrame:
    """Image files below a path: page_id, path, name, modificationTime, length and, if asked for, content."""
    files = spark.read.format("binaryFile").load(path).filter(extension("path").isin(list(extensions)))
    named = files.withColumn("name", F.url_decode(F.element_at(F.split("path", "/"), -1))).withColumn("page_id", F.xxhash64("path"))
    return named.select("page_id", "path", "name", "modificationTime", "length", *(["content"] if content else []))


def images_by_name(spark: SparkSession, path: str) -> DataFrame:
    """One image per normalised name: of several the one whose path comes last; collisions are counted."""
    return last_per_key(images(spark, path, content=False).withColumn("norm", norm_name("name")), "norm", ["path"])


def crops(spark: SparkSession, folders: list[str], content: bool = True) -> DataFrame:
    """Crop images of folders in the given order, by path within each: adds dir_ord, cls (the folder's name) and ord."""
    found = None
    for i, folder in enumerate(folders):
        part = images(spark, folder, schemas.CROP_EXTENSIONS, content).withColumn("dir_ord", F.lit(i))
        found = part if found is None else found.unionByName(part)
    return ordered_crops(found.withColumn("cls", class_of("path")))


def class_of(path: str):
    """The name of the folder a file is in."""
    return F.element_at(F.split(path, "/"), -2)


def ordered_crops(df: DataFrame, key: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """ord: the place by (dir_ord, path), within a key if one is given; paths compare as text, missing ones come last. Files are listed once each; where
    paths occur twice, tie names columns that tell them apart."""
    return numbered(df, key or ["dir_ord"], [F.col("dir_ord"), F.col("path").asc_nulls_last(), *map(F.col, tie or [])], "ord")


def literal_annotations(text: str, name: str = "ANN") -> dict[str, list[tuple]]:
    """The dictionary literal assigned to a name in Python source. Nothing is executed."""
    for node in ast.parse(text).body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) and node.value else []
        if any(isinstance(t, ast.Name) and t.id == name for t in targets):
            return _merge_assigned(text, name, ast.literal_eval(node.value))
    raise ValueError(f"{name} is not assigned a literal")


def _merge_assigned(text: str, name: str, start: dict) -> dict:
    """Later ``name[key] = literal`` statements replace or add entries."""
    for node in ast.parse(text).body:
        if isinstance(node, ast.Assign) and isinstance(t := node.targets[0], ast.Subscript) and isinstance(t.value, ast.Name) and t.value.id == name:
            start[ast.literal_eval(t.slice)] = ast.literal_eval(node.value)
    return start


def annotations(spark: SparkSession, entries: dict[str, list[tuple]]) -> DataFrame:
    """A long table of boxes in the order of the dictionary and of each list."""
    rows = [(name, i, j, label, *map(float, box)) for i, (name, boxes) in enumerate(entries.items()) for j, (label, *box) in enumerate(boxes)]
    return spark.createDataFrame(rows, schemas.ANNOTATION)


def annotation_file(spark: SparkSession, path: str) -> DataFrame:
    """Annotations from .py (a literal), .json (name to list of [label, x0, y0, x1, y1]), .csv or .parquet (long table)."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.schema(schemas.ANNOTATION).parquet(path)
    if kind == "csv":
        return spark.read.schema(schemas.ANNOTATION).csv(path, header=True)
    text = spark.read.text(path, wholetext=True).first()[0]
    return annotations(spark, literal_annotations(text) if kind == "py" else json.loads(text))


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """Box label text: one line a box, split and stem from the path (…/<split>/<stem>.txt)."""
    return label_lines(spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.url_decode("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def label_lines(texts: DataFrame) -> DataFrame:
    """The boxes of label texts (path, text): blank lines are skipped, but for that lines are numbered from 1."""
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    one = texts.select(class_of("path").alias("split"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("stem"), F.posexplode(lines).alias("at", "line"))
    parts = F.split("line", r"\s+")
    numbers = [F.get(parts, i).cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)]
    return one.select("split", "stem", (F.col("at") + 1).alias("line_no"), F.get(parts, 0).cast("int").alias("cls"), *numbers)


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """A CSV training log with its declared schema; padded headers and values are trimmed."""
    return spark.read.csv(path, header=True, schema=schemas.TRAINING_LOG, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)


def page_arguments(argv: list[str] | None = None) -> argparse.Namespace:
    """Command line of the page pipeline: an image, a folder or a pattern. Structure recognition is off unless asked for (the
    library's default is on)."""
    p = argparse.ArgumentParser(prog="pageloom-pages")
    p.add_argument("page")
    p.add_argument("--weights", default=None)
    p.add_argument("--ocsr", action="store_true")
    p.add_argument("--run-dir", default=None)
    return p.parse_args(argv)


def dataset_arguments(argv: list[str] | None = None) -> argparse.Namespace:
    """Command line of the detector dataset plan."""
    p = argparse.ArgumentParser(prog="pageloom-dataset")
    p.add_argument("--images", required=True)
    p.add_argument("--ann", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--val-frac", type=float, default=0.2)
    p.add_argument("--seed", type=int, default=42)
    return p.parse_args(argv)
