"""Rectangles in native pixels: clamping, clipping, moving and scaling."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonespark.schemas import ZONE


def zone_key(prefix: str = "") -> Column:
    """Zone identity. The note is part of it; a missing note counts as an empty one."""
    cols = [F.col(prefix + name) for name in ZONE[:-1]]
    return F.struct(*cols, F.coalesce(F.col(prefix + "note"), F.lit("")).alias("note"))


def clamp(value: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), value))


def js_round(value: Column) -> Column:
    """Nearest integer with halves going up, also for negatives: -2.5 becomes -2."""
    whole = F.floor(value)
    return F.when(value - whole >= 0.5, whole + 1).otherwise(whole).cast("int")


def rect_between(ax: Column, ay: Column, bx: Column, by: Column, width: Column, height: Column) -> Column:
    """The rectangle spanned by two corner points, rounded to pixels and clamped to a raster."""
    x1, x2 = (clamp(js_round(edge(ax, bx)), 0, width) for edge in (F.least, F.greatest))
    y1, y2 = (clamp(js_round(edge(ay, by)), 0, height) for edge in (F.least, F.greatest))
    return F.struct(
        x1.alias("x"), y1.alias("y"), (x2 - x1).alias("width"), (y2 - y1).alias("height")
    )


def clipped(width: Column, height: Column) -> Column:
    """An integer zone (columns x, y, width, height) cut to a raster; may have zero area."""
    x, y = F.col("x"), F.col("y")
    right, bottom = x + F.col("width"), y + F.col("height")
    x1, x2 = clamp(F.least(x, right), 0, width), clamp(F.greatest(x, right), 0, width)
    y1, y2 = clamp(F.least(y, bottom), 0, height), clamp(F.greatest(y, bottom), 0, height)
    return F.struct(
        x1.alias("x"), y1.alias("y"), (x2 - x1).alias("width"), (y2 - y1).alias("height"),
        F.coalesce(F.col("note"), F.lit("")).alias("note"),
    )


def has_area(rect: Column) -> Column:
    return (rect["width"] > 0) & (rect["height"] > 0)


def inside(width: Column, height: Column, zone: Column | None = None) -> Column:
    """A zone with area that needs no clipping at all: that of the row, or one given as a struct."""
    x, y, w, h = (F.col(c) if zone is None else zone[c] for c in ("x", "y", "width", "height"))
    return (w > 0) & (h > 0) & (x >= 0) & (y >= 0) & (x + w <= width) & (y + h <= height)
