"""Boxes as four columns (x0, y0, x1, y1), named by a prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def side(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def width(p: str = "") -> Column:
    return side(p, "x1") - side(p, "x0")


def height(p: str = "") -> Column:
    return side(p, "y1") - side(p, "y0")


def area(p: str = "") -> Column:
    return F.greatest(width(p), F.lit(0.0)) * F.greatest(height(p), F.lit(0.0))


def shared(a: str, b: str) -> Column:
    """Area of the intersection."""
    x = F.least(side(a, "x1"), side(b, "x1")) - F.greatest(side(a, "x0"), side(b, "x0"))
    y = F.least(side(a, "y1"), side(b, "y1")) - F.greatest(side(a, "y0"), side(b, "y0"))
    return F.greatest(x, F.lit(0.0)) * F.greatest(y, F.lit(0.0))


def overlap_fraction(a: str, b: str) -> Column:
    """The share of a that b covers; not symmetric."""
    return F.when(area(a) > 0, shared(a, b) / area(a)).otherwise(F.lit(0.0))


def iou(a: str, b: str) -> Column:
    whole = area(a) + area(b) - shared(a, b)
    return F.when(whole > 0, shared(a, b) / whole).otherwise(F.lit(0.0))


def contains_point(p: str, x: Column, y: Column) -> Column:
    return (x >= side(p, "x0")) & (x <= side(p, "x1")) & (y >= side(p, "y0")) & (y <= side(p, "y1"))


def union(a: str, b: str) -> list[Column]:
    """x0, y0, x1, y1 of the box around both."""
    return [F.least(side(a, n), side(b, n)).alias(n) for n in ("x0", "y0")] + [F.greatest(side(a, n), side(b, n)).alias(n) for n in ("x1", "y1")]


def union_all(p: str = "") -> list[Column]:
    """Aggregates: the box around all."""
    return [F.min(side(p, n)).alias(n) for n in ("x0", "y0")] + [F.max(side(p, n)).alias(n) for n in ("x1", "y1")]


def intersection(a: str, b: str) -> Column:
    """The common box as a struct, or null."""
    x0, y0 = F.greatest(side(a, "x0"), side(b, "x0")), F.greatest(side(a, "y0"), side(b, "y0"))
    x1, y1 = F.least(side(a, "x1"), side(b, "x1")), F.least(side(a, "y1"), side(b, "y1"))
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def x_overlap(a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(side(a, "x1"), side(b, "x1")) - F.greatest(side(a, "x0"), side(b, "x0")))


def y_overlap(a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(side(a, "y1"), side(b, "y1")) - F.greatest(side(a, "y0"), side(b, "y0")))


def expand(p: str, dx: float, dy: float | None = None) -> list[Column]:
    dy = dx if dy is None else dy
    return [(side(p, "x0") - dx).alias("x0"), (side(p, "y0") - dy).alias("y0"), (side(p, "x1") + dx).alias("x1"), (side(p, "y1") + dy).alias("y1")]


def centre_x(p: str = "") -> Column:
    return (side(p, "x0") + side(p, "x1")) / 2


def centre_y(p: str = "") -> Column:
    return (side(p, "y0") + side(p, "y1")) / 2


def f32(c: Column) -> Column:
    """The value rounded as a single-precision float holds it."""
    return c.cast("float").cast("double")


def transformed(x: Column, y: Column, m: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """A point through the affine matrix (a, b, c, d, e, f), rounded to single precision after each step."""
    a, b, c, d, e, f = (F.lit(float(v)).cast("float") for v in m)
    x, y = x.cast("float"), y.cast("float")
    step = lambda p, q, r: f32((f32((x * p).cast("float")) + f32((y * q).cast("float"))).cast("float") + r)
    return step(a, c, e), step(b, d, f)


def inverse(m: tuple[float, float, float, float, float, float]) -> tuple[float, ...] | None:
    """The inverse matrix, or None where there is none."""
    a, b, c, d, e, f = m
    det = a * d - b * c
    if not det:
        return None
    p, q, r, s = d / det, -b / det, -c / det, a / det
    return p, q, r, s, -(e * p + f * r), -(e * q + f * s)


def normalized(p: str = "") -> list[Column]:
    """A box whose corners may be swapped, the right way round."""
    x0, y0, x1, y1 = (side(p, n) for n in ("x0", "y0", "x1", "y1"))
    return [F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1")]


def empty(p: str = "") -> Column:
    """A box of no area, which holds no point and joins nothing."""
    return (width(p) <= 0) | (height(p) <= 0)


def crop_in_media(crop: str, media: str) -> list[Column]:
    """The crop box kept within the media box; the media box where they do not meet."""
    both = intersection(crop, media)
    return [F.coalesce(both[n], side(media, n)).alias(n) for n in ("x0", "y0", "x1", "y1")]


def band_boxes(df: DataFrame, count: int = 2, overlap: float = 0.18) -> DataFrame:
    """df (width, height) exploded to `count` bands down the page, each sharing `overlap` of its height with the next."""
    if count < 2:
        return df.select("*", F.lit(0).alias("band"), F.lit(0.0).alias("y0"), F.col("height").alias("y1"))
    high = F.col("height") / (count - (count - 1) * overlap)
    each = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("band"))
    last = F.col("band") == count - 1
    top = F.when(last, F.col("height") - high).otherwise(F.col("band") * high * (1 - overlap))
    out = each.withColumn("y0", F.greatest(F.lit(0.0), top))
    return out.withColumn("y1", F.when(last, F.col("height")).otherwise(F.least(F.col("height"), F.col("y0") + high)))
