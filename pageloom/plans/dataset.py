"""The detector dataset plan: annotations and images to splits, label texts and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.functions import boxes
from pageloom.operators import match, split
from pageloom.sources import readers, writers

EXACT_FILES = 20_000  # names that the driver shuffles and sends to the tasks at most, unless asked to


@dataclass
class Dataset:
    images: DataFrame  # filename, path, name, split
    boxes: DataFrame  # filename, name, ord, label, cls, cx, cy, w, h
    labels: DataFrame  # split, stem, text, n_collisions
    missing: DataFrame  # filename
    counts: DataFrame  # what, name, n


def build(annotations: DataFrame, images: DataFrame, share: float = 0.2, seed: int = 42, classes: tuple[str, ...] = schemas.BOX_CLASSES, exact_shuffle: bool | None = None) -> Dataset:
    """images: name, path. With exact_shuffle the split is a seeded driver-side shuffle of the matched file names in
    annotation order; else it is the digest split, which has no driver-side list. Unless told, lists of up to EXACT_FILES
    files are shuffled."""
    files = annotations.groupBy("filename").agg(F.min("file_ord").alias("file_ord"))
    pairs = match.require_pairs(match.matched(files, images).select("filename", "file_ord", "name", "path"))
    absent = match.missing(files, images).select("filename")
    if exact_shuffle is None:
        exact_shuffle = pairs.select("filename").limit(EXACT_FILES + 1).count() <= EXACT_FILES
    if exact_shuffle:
        names = [r["filename"] for r in pairs.select("filename", "file_ord").orderBy("file_ord").collect()]
        train, val = split.seeded_shuffle_split(names, share, seed)
        sides = pairs.sparkSession.createDataFrame([(n, "train") for n in train] + [(n, "val") for n in val], "filename string, split string")
        placed = pairs.join(F.broadcast(sides), "filename")
    else:
        placed = split.hash_split(pairs, "filename", share, seed)
    made = boxes.normalize(annotations.join(placed.select("filename", "name"), "filename"), classes)
    texts = writers.label_texts(placed, made)
    counts = writers.dataset_counts(placed, match.counts_by_class(made, classes), absent)
    return Dataset(placed, made, texts, absent, counts)


def write(dataset: Dataset, folder: str, classes: tuple[str, ...] = schemas.BOX_CLASSES) -> None:
    """Label files and data.yaml below folder; earlier label files of both splits are removed first."""
    writers.write_label_files(dataset.labels, folder)
    writers.write_dataset_yaml(folder, classes)


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    args = readers.dataset_arguments(argv)
    spark = SparkSession.builder.getOrCreate()
    made = build(readers.annotation_file(spark, args.ann), readers.images_by_name(spark, args.images), args.val_frac, args.seed)
    write(made, args.out)
    made.counts.show(truncate=False)


if __name__ == "__main__":
    main()
