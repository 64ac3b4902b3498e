"""Imported layouts: reviewing, promoting, merging and previewing them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonespark.functions.geometry import clipped, has_area, zone_key
from zonespark.functions.text import is_digits
from zonespark.plans.ordering import lookup
from zonespark.schemas import LAYOUT_KEY, ZONE


def promoted(layouts: DataFrame) -> DataFrame:
    return layouts.filter("promoted")


def set_promotion(layouts: DataFrame, keys: DataFrame, on: bool) -> DataFrame:
    """layouts with the flag of the listed keys set."""
    marked = keys.select(*LAYOUT_KEY).distinct().withColumn("_listed", F.lit(True))
    flag = F.when(F.col("_listed"), F.lit(on)).otherwise(F.col("promoted"))
    return layouts.join(marked, LAYOUT_KEY, "left").withColumn("promoted", flag).drop("_listed")


def discard_layouts(layouts: DataFrame, layout_zones: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = keys.select(*LAYOUT_KEY).distinct()
    return layouts.join(gone, LAYOUT_KEY, "left_anti"), layout_zones.join(gone, LAYOUT_KEY, "left_anti")


def remove_layout_zones(
    layouts: DataFrame, layout_zones: DataFrame, removed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Take zones (key and ord) out. A layout that lost one is held back again; an empty one is gone."""
    spots = removed.select(*LAYOUT_KEY, "ord").distinct()
    kept = layout_zones.join(spots, [*LAYOUT_KEY, "ord"], "left_anti")
    hit = layout_zones.join(spots, [*LAYOUT_KEY, "ord"], "left_semi").select(*LAYOUT_KEY).distinct()
    left = kept.select(*LAYOUT_KEY).distinct()
    changed = set_promotion(layouts, hit, False)
    emptied = hit.join(left, LAYOUT_KEY, "left_anti")
    return changed.join(emptied, LAYOUT_KEY, "left_anti"), kept


def merge_layouts(
    layouts: DataFrame, layout_zones: DataFrame, incoming: DataFrame, incoming_zones: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bring layouts in: (layouts, layout_zones, outcome per incoming layout).

    A new key is added as it came. To a known key only zones it does not have are appended, each once, and
    any such zone sends a promoted layout back for review.
    """
    known = layouts.select(*LAYOUT_KEY)
    new_layouts = incoming.join(known, LAYOUT_KEY, "left_anti")
    new_zones = incoming_zones.join(known, LAYOUT_KEY, "left_anti")
    identity = [*LAYOUT_KEY, *ZONE]
    fresh = (
        incoming_zones.join(known, LAYOUT_KEY, "left_semi")
        .withColumn("note", zone_key()["note"])
        .groupBy(*identity).agg(F.min("ord").alias("ord"))
        .join(layout_zones.withColumn("note", zone_key()["note"]).select(*identity), identity, "left_anti")
    )
    fresh_counts = fresh.groupBy(*LAYOUT_KEY).agg(F.count("*").alias("fresh"))
    last = layout_zones.groupBy(*LAYOUT_KEY).agg(F.max("ord").alias("_last"))
    appended = lookup(fresh, last, LAYOUT_KEY, ZONE, "left").withColumn(
        "ord", (F.coalesce(F.col("_last"), F.lit(-1)) + 1 + F.col("ord")).cast("bigint")
    )
    # New layouts stand behind the known ones in library order.
    after = layouts.agg(F.coalesce(F.max("layout_idx") + 1, F.lit(0)).alias("after"))
    placed = new_layouts.withColumn("layout_idx", F.col("layout_idx") + after.scalar())
    columns = [*LAYOUT_KEY, "promoted", "layout_idx"]
    held = F.col("promoted") & F.col("fresh").isNull()
    merged_layouts = (
        layouts.join(fresh_counts, LAYOUT_KEY, "left").withColumn("promoted", held).select(*columns)
        .unionByName(placed.withColumn("promoted", F.lit(False)).select(*columns))
    )
    zone_columns = [*LAYOUT_KEY, "ord", *ZONE]
    merged_zones = (
        layout_zones.select(*zone_columns)
        .unionByName(appended.select(*zone_columns))
        .unionByName(new_zones.select(*zone_columns))
    )
    outcome = (
        incoming.select(*LAYOUT_KEY)
        .join(known.withColumn("_known", F.lit(True)), LAYOUT_KEY, "left")
        .join(fresh_counts, LAYOUT_KEY, "left")
        .select(
            *LAYOUT_KEY,
            F.when(F.col("_known").isNull(), "added").when(F.col("fresh") > 0, "merged")
            .otherwise("unchanged").alias("outcome"),
            F.coalesce("fresh", F.lit(0)).alias("fresh_zones"),
        )
    )
    return merged_layouts, merged_zones, outcome


def matching_layouts(images: DataFrame, layouts: DataFrame) -> DataFrame:
    """Every image beside the layout of its combo and raster, where there is one."""
    placed = images.select(
        "image_id", "import_idx", F.coalesce("combo", F.lit("")).alias("combo"),
        F.col("width").alias("ref_width"), F.col("height").alias("ref_height"),
    )
    return lookup(placed, layouts, LAYOUT_KEY, ["image_id"])


def _open_frame_zones(images: DataFrame, zones: DataFrame) -> DataFrame:
    """Usable zones of each image's open frame, in their raw coordinates."""
    opened = images.select(
        "image_id", F.col("open_frame").alias("frame_index"), F.coalesce("combo", F.lit("")).alias("combo"),
        F.col("width").alias("ref_width"), F.col("height").alias("ref_height"),
    )
    note = F.coalesce("note", F.lit(""))
    return (
        zones.join(opened, ["image_id", "frame_index"])
        .filter(has_area(clipped(F.col("ref_width"), F.col("ref_height"))))
        .withColumn("note", note)
    )


def preview_counts(images: DataFrame, zones: DataFrame, union: DataFrame) -> DataFrame:
    """Per image: how many zones its preview shows and how many come from other frames or files.

    `union` is layout_union. An image without a digit combo previews its own open frame. The union itself is
    never repeated per image: `extra` is its size less the image's own zones found in it.
    """
    own = _open_frame_zones(images, zones)
    sizes = union.groupBy(*LAYOUT_KEY).agg(F.count("*").alias("_union"))
    identity = [*LAYOUT_KEY, *ZONE]
    distinct_own = own.groupBy("image_id", *identity).agg(F.count("*").alias("_n"))
    # Own and shared zones are counted in one pass. A whole zone is no hot key, so the union is not repeated.
    counts = (
        distinct_own.join(union.select(*identity, F.lit(True).alias("_in")), identity, "left")
        .groupBy("image_id").agg(F.sum("_n").alias("_own"), F.count("_in").alias("_shared"))
    )
    placed = images.select(
        "image_id", F.coalesce("combo", F.lit("")).alias("combo"),
        F.col("width").alias("ref_width"), F.col("height").alias("ref_height"),
    )
    joined = (
        lookup(placed, sizes, LAYOUT_KEY, ["image_id"], "left")
        .join(counts, "image_id", "left")
        .fillna(0, ["_union", "_own", "_shared"])
    )
    grouped = is_digits(F.col("combo"))
    return joined.select(
        "image_id",
        F.when(grouped, "union").otherwise("frame").alias("scope"),
        F.when(grouped, F.col("_union")).otherwise(F.col("_own")).alias("zones"),
        F.when(grouped, F.col("_union") - F.col("_shared")).otherwise(0).alias("extra"),
    )


def preview_layout(image: DataFrame, zones: DataFrame, union: DataFrame) -> DataFrame:
    """The zones one open image previews (`image` has its row), `extra` marking those not on its frame."""
    own = _open_frame_zones(image, zones)
    identity = [*LAYOUT_KEY, *ZONE]
    placed = image.select(
        "image_id", F.coalesce("combo", F.lit("")).alias("combo"),
        F.col("width").alias("ref_width"), F.col("height").alias("ref_height"),
    )
    shown = union.join(F.broadcast(placed.filter(is_digits(F.col("combo"))).limit(1)), LAYOUT_KEY)
    mine = own.select(*identity).distinct().withColumn("_mine", F.lit(True))
    from_union = shown.join(mine, identity, "left").select(
        "image_id", *ZONE, F.col("_mine").isNull().alias("extra")
    )
    alone = own.filter(~is_digits(F.col("combo"))).select("image_id", *ZONE, F.lit(False).alias("extra"))
    return from_union.unionByName(alone)
