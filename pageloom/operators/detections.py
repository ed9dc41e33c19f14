"""Detections: filtering, non-maximum suppression, containment, and average precision."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pageloom.functions import boxes
from pageloom.operators import slices
from pageloom.sources.shared import materialize


def project(df: DataFrame, names: dict[int, str]) -> DataFrame:
    """Class ids to names, coordinates to one digit; columns cls_id, conf, xyxy become cls, conf, xyxy."""
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.withColumns({"cls": lookup[F.col("cls_id")], "conf": F.col("conf").cast("double"), "xyxy": boxes.rounded("xyxy")}).drop("cls_id")


def confident(df: DataFrame, least: float = 0.25, most: int | None = None, key: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """Detections of at least a confidence; with most, the best of each key, ties by the given unique columns."""
    kept = df.filter(F.col("conf") >= least)
    if most is None:
        return kept
    order = Window.partitionBy(*(key or [])).orderBy(F.col("conf").desc(), *(tie or []))
    return kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def contained(df: DataFrame, image: list[str], inner: str, outer: str, least: float = 0.5) -> DataFrame:
    """Pairs of an inner-class and an outer-class box of one image, with the share of the inner box inside (at least least).

    The image key makes it an equi-join; overlap conditions are its residual. df: image, label, box_id, x0, y0, x1, y1."""
    cols = ("box_id", "x0", "y0", "x1", "y1")
    a = df.filter(F.col("label") == inner).select(*image, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = df.filter(F.col("label") == outer).select(*image, *[F.col(c).alias(f"b_{c}") for c in cols])
    pairs = a.join(b, image).filter("a_x0 < b_x1 AND b_x0 < a_x1 AND a_y0 < b_y1 AND b_y0 < a_y1")
    own = boxes.area(F.col("a_x0"), F.col("a_y0"), F.col("a_x1"), F.col("a_y1"))
    return pairs.withColumn("share", F.try_divide(boxes.overlap("a", "b"), own)).filter(F.col("share") >= least)


def _ious(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    w = np.minimum(one[2], many[:, 2]) - np.maximum(one[0], many[:, 0])
    h = np.minimum(one[3], many[:, 3]) - np.maximum(one[1], many[:, 1])
    shared = np.clip(w, 0, None) * np.clip(h, 0, None)
    size = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    return shared / np.maximum(size(one) + size(many) - shared, 1e-12)


def _in_groups(df: DataFrame, key: list[str], order: list[Column], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema) -> DataFrame:
    """run over many whole groups at once: rows by key and order, and where each group begins. Partitions are sorted and read in
    batches; a group that goes on in the next batch waits for it."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            begins = np.zeros(len(rows), bool)
            begins[0] = True
            for k in key:
                before = rows[k].shift()
                begins |= ((rows[k] != before) & ~(rows[k].isna() & before.isna())).to_numpy()
            starts = np.flatnonzero(begins)
            held = rows[starts[-1] :].reset_index(drop=True)
            if len(starts) > 1:
                yield run(rows[: starts[-1]], starts)
        if held is not None:
            yield run(held, np.array([0, len(held)]))

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(each, schema)


CORNERS = ["x0", "y0", "x1", "y1"]


def suppress(df: DataFrame, image: str = "image", iou: float = 0.7, most: int = 300) -> DataFrame:
    """Greedy non-maximum suppression within an image and class; df: image, box_id, cls, conf, x0, y0, x1, y1."""

    def run(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        corners, kept = rows[CORNERS].to_numpy(), []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            own = [a][:most]
            for i in range(a + 1, b):
                if len(own) < most and not (_ious(corners[i], corners[own]) > iou).any():
                    own.append(i)
            kept += own
        return rows.iloc[kept]

    return _in_groups(df, [image, "cls"], [F.col("conf").desc(), F.col("box_id")], run, df.schema)


def average_precision(truth: DataFrame, found: DataFrame, image: str = "image", iou: float = 0.5) -> DataFrame:
    """Precision, recall and average precision by class: greedy matching per image, then cumulative
    counts over ranges of confidence (slices.in_slices).

    truth: image, cls, x0..y1. found: the same with conf and box_id. Area under the precision
    envelope over recall. Boxes of equal overlap are taken by their corners."""
    return _by_class(truth, found, image, (iou,)).select("cls", "truth", *[F.col(f"{c}_0").alias(c) for c in ("precision", "recall", "ap")])


def mean_average_precision(truth: DataFrame, found: DataFrame, image: str = "image", ious: tuple[float, ...] = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))) -> DataFrame:
    """Per class: truth, precision and recall at the first threshold, the average precision there (ap50) and its mean over all
    thresholds (ap50_95)."""
    mean = functools.reduce(Column.__add__, [F.col(f"ap_{i}") for i in range(len(ious))]) / len(ious)
    return _by_class(truth, found, image, ious).select("cls", "truth", F.col("precision_0").alias("precision"), F.col("recall_0").alias("recall"), F.col("ap_0").alias("ap50"), mean.alias("ap50_95"))


def _by_class(truth: DataFrame, found: DataFrame, image: str, ious: tuple[float, ...]) -> DataFrame:
    """cls, truth and, for each threshold i, precision_i, recall_i and ap_i; boxes are matched in one pass for all thresholds."""
    kind = dict(found.dtypes)
    none = [F.lit(None).cast("double").alias("conf"), F.lit(None).cast(kind["box_id"]).alias("box_id"), F.lit(False).alias("found")]
    truth = truth.select(F.col(image).cast(kind[image]).alias("image"), F.col("cls").cast(kind["cls"]).alias("cls"), *CORNERS)
    mine = found.select(F.col(image).alias("image"), "cls", *CORNERS, F.col("conf").cast("double").alias("conf"), "box_id", F.lit(True).alias("found"))
    each = range(len(ious))

    def match(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        corners, is_found, hit = rows[CORNERS].to_numpy(), rows["found"].to_numpy(bool), np.zeros((len(ious), len(rows)), np.int32)
        begins, sizes = starts[:-1], np.diff(starts)
        n_true = sizes - np.add.reduceat(is_found, begins, dtype=np.int64)
        both = np.flatnonzero((n_true > 0) & (n_true < sizes))  # without true boxes, or without found ones, nothing is hit
        for a, b, n in zip(begins[both].tolist(), starts[1:][both].tolist(), n_true[both].tolist(), strict=True):
            there, free = corners[a : a + n], np.ones((len(ious), n), bool)  # true boxes come first
            for i in range(a + n, b):
                overlaps = _ious(corners[i], there)
                for t, least in enumerate(ious):
                    score = np.where(free[t], overlaps, 0)
                    best = int(score.argmax())
                    if score[best] >= least:
                        free[t, best], hit[t, i] = False, 1
        return rows.assign(**{f"hit_{t}": hit[t] for t in each}).loc[is_found, ["cls", "conf", "box_id", "image", *[f"hit_{t}" for t in each]]]

    schema = f"cls {kind['cls']}, conf double, box_id {kind['box_id']}, image {kind[image]}, " + ", ".join(f"hit_{t} int" for t in each)
    order = [F.col("found"), F.col("conf").desc(), F.col("box_id"), *map(F.col, CORNERS)]
    hits = _in_groups(truth.select("*", *none).unionByName(mine), ["image", "cls"], order, match, schema)
    total = truth.groupBy("cls").agg(F.count(F.lit(1)).alias("truth"))
    order = [F.col("conf").desc(), F.col("image"), F.col("box_id")]
    sliced = slices.in_slices(materialize(hits), ["cls"], order)  # dealing by ranges reads its rows twice
    run = slices.within(["cls"], order)
    local = sliced.withColumns({"n": F.count(F.lit(1)).over(run)} | {f"tp_{t}": F.sum(f"hit_{t}").over(run) for t in each})
    before = slices.carried(sliced, ["cls"], {"n_rows": F.count(F.lit(1))} | {f"n_tp_{t}": F.sum(f"hit_{t}") for t in each})
    earlier = {"n": "n_rows"} | {f"tp_{t}": f"n_tp_{t}" for t in each}
    curve = slices.joined(local, before, ["cls"]).withColumns({c: F.col(c) + F.coalesce(b, F.lit(0)) for c, b in earlier.items()}).drop(*earlier.values())
    curve = curve.withColumns({f"precision_{t}": F.col(f"tp_{t}") / F.col("n") for t in each})
    # the envelope: the best precision from a row on, first within its range, then of the ranges after it; rows are read from the
    # last one, as Spark computes a frame that ends at the last row anew for every row
    ahead = Window.partitionBy("cls", slices.SLICE).orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    after = slices.carried(curve, ["cls"], {f"later_{t}": F.max(f"precision_{t}") for t in each}, backwards=True)
    envelope = slices.joined(curve.withColumns({f"best_{t}": F.max(f"precision_{t}").over(ahead) for t in each}), after, ["cls"])
    made = [(F.sum(F.col(f"hit_{t}") * F.greatest(f"best_{t}", f"later_{t}")).alias(f"area_{t}"), F.max_by(f"precision_{t}", "n").alias(f"last_{t}"), F.max(f"tp_{t}").alias(f"tp_{t}")) for t in each]
    whole = total.join(envelope.groupBy("cls").agg(*[c for some in made for c in some]), "cls", "left")
    share = lambda c: F.coalesce(F.col(c) / F.col("truth"), F.lit(0.0))
    rates = [(F.coalesce(f"last_{t}", F.lit(0.0)).alias(f"precision_{t}"), share(f"tp_{t}").alias(f"recall_{t}"), share(f"area_{t}").alias(f"ap_{t}")) for t in each]
    return whole.select("cls", "truth", *[c for some in rates for c in some])
