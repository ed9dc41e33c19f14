import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom import schemas
from pageloom.functions import boxes
from pageloom.operators import detections, match
from pageloom.sources import writers

CASES = [
    ("reaction_scheme", 0.125, 0.25, 0.875, 0.5, "1 0.500000 0.375000 0.750000 0.250000"),
    ("chemical_structure", 0.1, 0.3, 0.3, 0.45, "0 0.200000 0.375000 0.200000 0.150000"),
    ("chemical_structure", 0.875, 0.5, 0.125, 0.25, "0 0.500000 0.375000 0.750000 0.250000"),
    ("chemical_structure", -0.5, 0.2, 0.6, 1.75, "0 0.300000 0.600000 0.600000 0.800000"),
    ("chemical_structure", 0.25, 0.3, 0.25, 0.7, None),
    ("chemical_structure", 1.2, 0.3, 1.6, 0.7, None),
    ("arrow", 0.1, 0.1, 0.2, 0.2, None),
    ("chemical_structure", math.nan, 0.1, 0.2, 0.2, None),
    ("chemical_structure", None, 0.1, 0.2, 0.2, None),
    (None, 0.1, 0.1, 0.2, 0.2, None),
]


def test_lines(spark):
    df = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(CASES)], "i int, label string, x0 double, y0 double, x1 double, y1 double")
    made = boxes.normalize(df, schemas.BOX_CLASSES)
    got = {r.i: r.line for r in made.select("i", writers.box_line("cls", "cx", "cy", "w", "h").alias("line")).collect()}
    assert got == {i: c[5] for i, c in enumerate(CASES) if c[5]}


numbers = st.floats(-0.5, 1.5)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(numbers, numbers, numbers, numbers), min_size=20, max_size=40))
def test_boxes_stay_inside(spark, found):
    df = spark.createDataFrame([("reaction_scheme", *b) for b in found], "label string, x0 double, y0 double, x1 double, y1 double")
    for r in boxes.normalize(df, schemas.BOX_CLASSES).collect():
        assert r.w > 0 and r.h > 0
        assert -1e-9 <= r.cx - r.w / 2 and r.cx + r.w / 2 <= 1 + 1e-9 and -1e-9 <= r.cy - r.h / 2 and r.cy + r.h / 2 <= 1 + 1e-9


def test_counts_show_zero(spark):
    df = spark.createDataFrame([("a",), ("a",)], "label string")
    assert {r.label: r.boxes for r in match.counts_by_class(df, ["a", "b"]).collect()} == {"a": 2, "b": 0}


def test_roles_first_list_wins(spark):
    df = spark.createDataFrame([("x",), ("y",), ("z",)], "cls string")
    got = {r.cls: r.role for r in match.with_role(df, {"scheme": ["x"], "structure": ["x", "y"]}).collect()}
    assert got == {"x": "scheme", "y": "structure"}


def test_rounding_half_even(spark):
    df = spark.createDataFrame([([0.25, 0.75, 12.34],)], "xyxy array<double>").select(boxes.rounded("xyxy").alias("r"))
    assert df.first().r == [0.2, 0.8, 12.3]


def test_suppression(spark):
    rows = [("i", 1, "c", 0.9, 0.0, 0.0, 10.0, 10.0), ("i", 2, "c", 0.8, 0.0, 0.0, 10.0, 9.0), ("i", 3, "c", 0.7, 20.0, 20.0, 30.0, 30.0), ("i", 4, "d", 0.6, 0.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "image string, box_id int, cls string, conf double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.box_id for r in detections.suppress(df).collect()) == [1, 3, 4]


def test_average_precision(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    truth = spark.createDataFrame([("i", "c", 0.0, 0.0, 10.0, 10.0), ("i", "c", 20.0, 20.0, 30.0, 30.0), ("j", "d", 0.0, 0.0, 1.0, 1.0)], f"image string, cls string, {box}")
    found = spark.createDataFrame([("i", "c", 0.9, 1, 0.0, 0.0, 10.0, 10.0), ("i", "c", 0.8, 2, 50.0, 50.0, 60.0, 60.0), ("i", "c", 0.7, 3, 20.0, 20.0, 30.0, 29.0)], f"image string, cls string, conf double, box_id int, {box}")
    got = {r.cls: r for r in detections.average_precision(truth, found).collect()}
    assert math.isclose(got["c"].ap, 0.5 * 1 + 0.5 * 2 / 3) and got["c"].recall == 1 and math.isclose(got["c"].precision, 2 / 3)
    assert got["d"].ap == 0 and got["d"].truth == 1


@pytest.mark.parametrize("parts", [1, 7])
def test_average_precision_is_linear_in_a_class(spark, parts):
    """Against a plain loop over classes in several ranges; no frame is computed anew for every row."""
    rng = random.Random(3)
    box = lambda: (a := rng.randrange(4), b := rng.randrange(4), a + 2.0, b + 2.0)
    truth = [(i, rng.choice("cd"), *map(float, box())) for i in range(60) for _ in range(3)]
    found = [(i, rng.choice("cde"), rng.randrange(5) / 5, n, *map(float, box())) for i in range(90) for n in range(4)]
    corners = "x0 double, y0 double, x1 double, y1 double"
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = detections.average_precision(spark.createDataFrame(truth, f"image int, cls string, {corners}"), spark.createDataFrame(found, f"image int, cls string, conf double, box_id int, {corners}"), iou=0.3)
        got = {r.cls: r for r in made.collect()}
        assert "unboundedfollowing" not in made._jdf.queryExecution().executedPlan().toString().lower()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for cls in "cd":
        free, hits = [t for t in sorted(truth) if t[1] == cls], []
        n = len(free)
        for f in sorted((f for f in found if f[1] == cls), key=lambda f: (-f[2], f[0], f[3])):
            shared = lambda t: max(min(f[6], t[4]) - max(f[4], t[2]), 0) * max(min(f[7], t[5]) - max(f[5], t[3]), 0)  # noqa: B023, E731
            best = max((t for t in free if t[0] == f[0]), key=lambda t: shared(t), default=None)
            hits.append(best is not None and shared(best) / (8 - shared(best)) >= 0.3)
            if hits[-1]:
                free.remove(best)
        precision = [sum(hits[: i + 1]) / (i + 1) for i in range(len(hits))]
        assert math.isclose(got[cls].ap, sum(max(precision[i:]) for i, h in enumerate(hits) if h) / n)
        assert math.isclose(got[cls].recall, sum(hits) / n) and math.isclose(got[cls].precision, precision[-1]) and got[cls].truth == n


def test_mean_average_precision_matches_once(spark, monkeypatch):
    """All thresholds in one pass over the boxes, with what each threshold gives on its own."""
    box, rng = "x0 double, y0 double, x1 double, y1 double", random.Random(5)
    some = lambda: (rng.randrange(3) / 2, rng.randrange(3) / 2, 2.0, 2.0)
    truth = spark.createDataFrame([(i % 9, rng.choice("cd"), *some()) for i in range(40)], f"image int, cls string, {box}")
    found = spark.createDataFrame([(i % 11, rng.choice("ce"), rng.random(), i, *some()) for i in range(60)], f"image int, cls string, conf double, box_id int, {box}")
    ious = (0.2, 0.5, 0.9)
    alone = [{r.cls: r for r in detections.average_precision(truth, found, iou=t).collect()} for t in ious]
    passes, group = [], detections._in_groups
    monkeypatch.setattr(detections, "_in_groups", lambda *a: passes.append(a) or group(*a))
    got = {r.cls: r for r in detections.mean_average_precision(truth, found, ious=ious).collect()}
    assert len(passes) == 1 and set(got) == {"c", "d"}
    for cls, r in got.items():
        assert (r.truth, r.precision, r.recall, r.ap50) == tuple(alone[0][cls])[1:]
        assert math.isclose(r.ap50_95, sum(a[cls].ap for a in alone) / 3)


def test_containment(spark):
    rows = [("i", "s", 1, 0.0, 0.0, 10.0, 10.0), ("i", "r", 2, 5.0, 0.0, 20.0, 10.0), ("i", "r", 3, 8.0, 0.0, 20.0, 10.0), ("j", "r", 4, 0.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "image string, label string, box_id int, x0 double, y0 double, x1 double, y1 double")
    got = detections.contained(df, ["image"], "s", "r").collect()
    assert [(r.a_box_id, r.b_box_id, r.share) for r in got] == [(1, 2, 0.5)]
