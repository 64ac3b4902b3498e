"""Zones on images, and the layout each device combination and raster size ends up with."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonespark.functions.geometry import clamp, clipped, has_area
from zonespark.functions.text import is_digits
from zonespark.plans.ordering import with_rank_within
from zonespark.schemas import FRAME, LAYOUT_KEY, ZONE


def _with_raster(zones: DataFrame, images: DataFrame, *extra: str) -> DataFrame:
    raster = images.select(
        "image_id", F.col("width").alias("ref_width"), F.col("height").alias("ref_height"), *extra
    )
    return zones.join(raster, "image_id")


def _replace_zone(df: DataFrame, zone: Column) -> DataFrame:
    """Swap the five zone columns for the fields of a struct, dropping zones left without area."""
    cut = df.withColumn("_zone", zone).filter(has_area(F.col("_zone")))
    others = [c for c in df.columns if c not in ZONE]
    return cut.select(*others, *[F.col("_zone")[name].alias(name) for name in ZONE])


def clip_zones(zones: DataFrame, images: DataFrame) -> DataFrame:
    """Cut every zone to its raster; zones that lose all their area are dropped."""
    placed = _with_raster(zones, images)
    return _replace_zone(placed, clipped(F.col("ref_width"), F.col("ref_height"))).select(*FRAME, "ord", *ZONE)


def shift_zones(zones: DataFrame, images: DataFrame, dx: int, dy: int) -> DataFrame:
    """Slide every zone; it stops at the raster's edge and never changes size."""
    moved = _with_raster(zones, images).select(
        *FRAME, "ord",
        clamp(F.col("x") + dx, 0, F.col("ref_width") - F.col("width")).alias("x"),
        clamp(F.col("y") + dy, 0, F.col("ref_height") - F.col("height")).alias("y"),
        "width", "height", "note",
    )
    return moved


def scale_zones(zones: DataFrame, images: DataFrame, view_width: int, view_height: int) -> DataFrame:
    """Zones in the coordinates of a view of the given size. For display: never a source of zones."""
    sx, sy = F.lit(view_width) / F.col("ref_width"), F.lit(view_height) / F.col("ref_height")
    return _with_raster(zones, images).select(
        *FRAME, "ord",
        (F.col("x") * sx).alias("x"), (F.col("y") * sy).alias("y"),
        F.greatest(F.lit(1.0), F.col("width") * sx).alias("width"),
        F.greatest(F.lit(1.0), F.col("height") * sy).alias("height"),
    )


def clear_notes(zones: DataFrame) -> DataFrame:
    """Blank every note of zones, layout zones or template zones; geometry is untouched."""
    return zones.withColumn("note", F.lit(""))


def count_notes(*tables: DataFrame) -> DataFrame:
    """How many notes are not empty over any number of zone tables."""
    counts = None
    for table in tables:
        part = table.agg(F.count_if(F.coalesce("note", F.lit("")) != "").alias("notes"))
        counts = part if counts is None else counts.unionByName(part)
    return counts.agg(F.sum("notes").alias("notes"))


def zone_facts(images: DataFrame, zones: DataFrame, *extra: str) -> DataFrame:
    """Clipped zones with their image's combo and raster, and `first`: where in the library they stand."""
    placed = _with_raster(zones, images, "import_idx", "combo", *extra)
    cut = _replace_zone(placed, clipped(F.col("ref_width"), F.col("ref_height")))
    return cut.withColumn(
        "first",
        F.struct(
            F.lit(0).alias("origin"), F.col("import_idx"),
            F.col("frame_index").cast("int").alias("frame_index"), F.col("ord").cast("bigint").alias("ord"),
        ),
    ).drop("import_idx", "frame_index", "ord")


def layout_facts(layouts: DataFrame, layout_zones: DataFrame) -> DataFrame:
    """Clipped zones of promoted layouts; they come after every image."""
    kept = layouts.filter("promoted").select(*LAYOUT_KEY, "layout_idx")
    placed = layout_zones.join(kept, LAYOUT_KEY)
    cut = _replace_zone(placed, clipped(F.col("ref_width"), F.col("ref_height")))
    return cut.withColumn(
        "first",
        F.struct(
            F.lit(1).alias("origin"), F.col("layout_idx").alias("import_idx"),
            F.lit(0).alias("frame_index"), F.col("ord").cast("bigint").alias("ord"),
        ),
    ).select(*LAYOUT_KEY, *ZONE, "first")


def layout_union(
    images: DataFrame,
    zones: DataFrame,
    layouts: DataFrame | None = None,
    layout_zones: DataFrame | None = None,
    with_position: bool = False,
) -> DataFrame:
    """The distinct zones each (combo, raster) gets from every frame of every image and promoted layout.

    `first` orders zones as they were first seen; with_position=True turns it into a dense `position`.
    Only digit combos form layouts; export_blockers lists the annotated images that have none.
    """
    labelled = images.filter(is_digits(F.col("combo")))
    facts = zone_facts(labelled, zones).select(*LAYOUT_KEY, *ZONE, "first")
    if layouts is not None:
        facts = facts.unionByName(layout_facts(layouts, layout_zones))
    union = facts.groupBy(*LAYOUT_KEY, *ZONE).agg(F.min("first").alias("first"))
    if not with_position:
        return union
    return with_rank_within(union, LAYOUT_KEY, ["first", *ZONE], "position").drop("first")


def layout_for(union: DataFrame, combo: str, width: int, height: int) -> DataFrame | None:
    """One layout of layout_union, or None when the combo cannot key a layout.

    The key is part of the union's grouping, so this filter reaches the scans.
    """
    if not (combo.isascii() and combo.isdigit()):
        return None
    return union.filter(
        (F.col("combo") == combo) & (F.col("ref_width") == width) & (F.col("ref_height") == height)
    )


def zone_summary(
    images: DataFrame, zones: DataFrame, layouts: DataFrame, layout_zones: DataFrame
) -> DataFrame:
    """Raw zones per (combo, raster) from annotated images and promoted layouts."""
    per_image = zones.groupBy("image_id").agg(F.count("*").alias("zones"))
    own = images.join(per_image, "image_id").select(
        F.col("combo"), F.col("width").alias("ref_width"), F.col("height").alias("ref_height"), "zones"
    )
    kept = layouts.filter("promoted").select(*LAYOUT_KEY)
    imported = layout_zones.join(kept, LAYOUT_KEY).select(*LAYOUT_KEY, F.lit(1).cast("bigint").alias("zones"))
    return own.unionByName(imported).groupBy(*LAYOUT_KEY).agg(F.sum("zones").alias("zones"))


def summary_totals(summary: DataFrame) -> DataFrame:
    """All zones, those without a combo, and whether they block the combo-keyed export."""
    unassigned = F.coalesce(F.sum(F.when(F.col("combo") == "", F.col("zones"))), F.lit(0))
    return summary.agg(
        F.coalesce(F.sum("zones"), F.lit(0)).alias("total"),
        unassigned.alias("unassigned"),
        (unassigned > 0).alias("v1_blocked"),
    )
