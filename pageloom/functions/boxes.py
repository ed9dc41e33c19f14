"""Box geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize(df: DataFrame, classes: list[str] | tuple[str, ...]) -> DataFrame:
    """Corner boxes (label, x0, y0, x1, y1 as shares of the image) to class id, centre and size.

    Corners are ordered, then clamped to [0, 1]; unknown labels, null or NaN corners and boxes without area are dropped."""
    corners = ("x0", "y0", "x1", "y1")
    ids = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    sane = df.filter(F.col("label").isin(list(classes)))
    for c in corners:
        sane = sane.filter(F.col(c).isNotNull() & ~F.isnan(c))
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    for lo, hi in (("x0", "x1"), ("y0", "y1")):
        sane = sane.withColumns({lo: clamp(F.least(lo, hi)), hi: clamp(F.greatest(lo, hi))})
    made = sane.withColumns({"cls": ids[F.col("label")], "cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2, "w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})
    return made.filter("w > 0 AND h > 0").drop(*corners)


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def overlap(a: str, b: str) -> Column:
    """Area shared by the boxes in columns a_x0.. and b_x0..."""
    c = lambda p, n: F.col(f"{p}_{n}")
    return area(F.greatest(c(a, "x0"), c(b, "x0")), F.greatest(c(a, "y0"), c(b, "y0")), F.least(c(a, "x1"), c(b, "x1")), F.least(c(a, "y1"), c(b, "y1")))


def rounded(xyxy: str | Column, digits: int = 1) -> Column:
    """Coordinates rounded half to even."""
    return F.transform(F.col(xyxy) if isinstance(xyxy, str) else xyxy, lambda x: F.bround(x, digits))
