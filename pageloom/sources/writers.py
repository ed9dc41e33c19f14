"""Writers: stage outputs, label files, dataset description, reports."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.functions.text import safe_stem


def stage_output(df: DataFrame, root: str, stage: str, run_id: str = "run", fmt: str = "parquet") -> str:
    """One dataset per stage and run, keyed by page, replaced as a whole; JSON keeps nulls. Returns its path."""
    path = f"{root}/run_id={run_id}/{stage}"
    writer = df.write.mode("overwrite")
    if fmt == "json":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.format(fmt).save(path)
    return path


@F.pandas_udf(schemas.STR)
def box_line(cls: pd.Series, cx: pd.Series, cy: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    """A label line; numbers with six digits, halves of the binary value to even (Spark's format_string rounds otherwise)."""
    return pd.Series([f"{int(c)} {a:.6f} {b:.6f} {x:.6f} {y:.6f}" for c, a, b, x, y in zip(cls, cx, cy, w, h, strict=True)], dtype="object")


def label_texts(images: DataFrame, boxes: DataFrame, key: str = "name", order: str = "ord") -> DataFrame:
    """split, stem and text of every image's label file: a line per box in order, an empty text where no box is left.

    images: key and split; boxes: key, order, cls, cx, cy, w, h. n_collisions counts images of one split and stem."""
    lines = boxes.select(key, order, box_line("cls", "cx", "cy", "w", "h").alias("line"))
    texts = lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("text"))
    whole = images.select(key, "split", safe_stem(key).alias("stem")).join(texts, key, "left")
    text: Column = F.when(F.col("text").isNotNull(), F.concat("text", F.lit("\n"))).otherwise(F.lit(""))
    return whole.withColumn("text", text).groupBy("split", "stem").agg(F.max_by("text", key).alias("text"), (F.count(F.lit(1)) - 1).alias("n_collisions"))


def write_label_files(texts: DataFrame, folder: str) -> None:
    """labels/<split>/<stem>.txt on a file system that all executors mount; files of earlier runs in the split are removed."""
    for split in ("train", "val"):
        os.makedirs(f"{folder}/labels/{split}", exist_ok=True)
        for old in os.listdir(f"{folder}/labels/{split}"):
            if old.endswith(".txt"):
                os.remove(f"{folder}/labels/{split}/{old}")

    def run(rows) -> None:
        for r in rows:
            with open(f"{folder}/labels/{r['split']}/{r['stem']}.txt", "w", encoding="utf-8") as f:
                f.write(r["text"])

    texts.select("split", "stem", "text").foreachPartition(run)


def copy_images(images: DataFrame, folder: str) -> None:
    """images/<split>/<stem><lower-case extension> from binary content; images: name, split, content."""
    for split in ("train", "val"):
        os.makedirs(f"{folder}/images/{split}", exist_ok=True)

    def run(rows) -> None:
        for r in rows:
            with open(f"{folder}/images/{r['split']}/{r['file']}", "wb") as f:
                f.write(r["content"])

    ext = F.lower(F.regexp_extract("name", r"(\.[^.]*)\z", 1))
    images.select("split", F.concat(safe_stem("name"), ext).alias("file"), "content").foreachPartition(run)


def dataset_yaml(folder: str, classes: list[str] | tuple[str, ...]) -> str:
    return f"path: {folder}\ntrain: images/train\nval: images/val\nnc: {len(classes)}\nnames: {list(classes)!r}\n"


def write_dataset_yaml(folder: str, classes: list[str] | tuple[str, ...]) -> None:
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/data.yaml", "w", encoding="utf-8") as f:
        f.write(dataset_yaml(folder, classes))


def material_line(m: Column) -> Column:
    """amount / concentration / smiles without the empty ones."""
    parts = F.filter(F.array(m["amount"], m["concentration"], m["smiles"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.concat(m["name"], F.lit(" ("), m["role"], F.lit(")"), F.when(F.size(parts) > 0, F.concat(F.lit(": "), F.array_join(parts, " / "))).otherwise(F.lit("")))


def report(summary: str | Column) -> Column:
    """A readable report of a summary column (schemas.SUMMARY); empty sections are left out."""
    s = F.col(summary) if isinstance(summary, str) else summary
    shown = lambda c: F.coalesce(c, F.lit("")) != ""

    def section(title: str, lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(lines, "\n")))

    def alone(title: str, c: Column, empty: str = "") -> Column:
        return F.when(shown(c) & (c != empty), F.concat(F.lit(f"{title}:\n  "), c))

    bullets = lambda c: F.transform(c, lambda x: F.concat(F.lit("  - "), x))
    head = F.concat(F.coalesce(F.nullif(s["title"], F.lit("")), F.lit("Untitled")), F.when(shown(s["run_id"]), F.concat(F.lit(" ["), s["run_id"], F.lit("]"))).otherwise(F.lit("")))
    confidence = F.coalesce(F.nanvl(s["confidence"], F.lit(0.0)), F.lit(0.0))
    parts = [
        head,
        F.concat(F.lit("Goal: "), F.coalesce(s["goal"], F.lit(""))),
        section("Materials", F.transform(s["materials"], lambda m: F.concat(F.lit("  - "), material_line(m)))),
        alone("Conditions", s["conditions"], "{}"),
        section("Procedure", F.transform(s["procedure"], lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x))),
        section("Results", bullets(s["results"])),
        alone("Conclusions", s["conclusions"]),
        section("Uncertainties", bullets(s["uncertainties"])),
        F.concat(F.lit("Confidence: "), F.format_number(confidence, 2)),
    ]
    return F.concat_ws("\n", *parts)


def dataset_counts(split_images: DataFrame, boxes_per_class: DataFrame, missing: DataFrame) -> DataFrame:
    """What a dataset run reports: images per split, boxes per class, annotated files without an image."""
    a = split_images.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(F.lit("images").alias("what"), F.col("split").alias("name"), "n")
    b = boxes_per_class.select(F.lit("boxes").alias("what"), F.col("label").alias("name"), F.col("boxes").alias("n"))
    c = missing.select("filename").distinct().select(F.lit("missing").alias("what"), F.col("filename").alias("name"), F.lit(1).cast("long").alias("n"))
    return a.unionByName(b).unionByName(c)
