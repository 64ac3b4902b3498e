"""Templates: named zones for one raster size, applied through the same plan copies use."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonespark.functions.text import collapse, is_digits
from zonespark.operators.reuse import all_frames, plan_copy
from zonespark.operators.zones import clip_zones
from zonespark.plans.ordering import lookup
from zonespark.schemas import FRAME, ZONE

MAX_NAME = 80
APPLY_SCOPES = ["frame", "file", "combo"]


def template_name(name: Column) -> Column:
    return F.substring(collapse(F.coalesce(name, F.lit(""))), 1, MAX_NAME)


def derived_id(*parts: Column) -> Column:
    """An id made from what identifies the row, so a task that runs again makes the same one."""
    return F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, 32)


def make_templates(
    zones: DataFrame, images: DataFrame, frames: DataFrame, created_at: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One template per chosen frame (image_id, frame_index, name): (templates, template_zones, rejects).

    Zones are clipped. A frame left without zones, or given no name, is rejected with the reason. A combo
    that is not digits is not recorded.
    """
    kept = clip_zones(zones, images).join(frames.select(*FRAME).distinct(), FRAME, "left_semi")
    counts = kept.groupBy(*FRAME).agg(F.count("*").alias("_zones"))
    facts = images.select("image_id", "combo", "width", "height")
    named = (
        frames.select(*FRAME, template_name(F.col("name")).alias("name"))
        .join(facts, "image_id").join(counts, FRAME, "left")
    )
    reason = (
        F.when(F.col("name") == "", "Give the template a name.")
        .when((F.col("width") <= 0) | (F.col("height") <= 0), "Unknown raster size.")
        .when(F.col("_zones").isNull(), "This frame has no zones to save.")
    )
    judged = named.withColumn("reason", reason).withColumn(
        "template_id", derived_id(F.col("image_id"), F.col("frame_index").cast("string"), F.col("name"))
    )
    good = judged.filter(F.col("reason").isNull())
    templates = good.select(
        "template_id", "name", F.when(is_digits(F.col("combo")), F.col("combo")).otherwise("").alias("combo"),
        "width", "height", F.lit(created_at).alias("created_at"),
    )
    template_zones = kept.join(good.select(*FRAME, "template_id"), FRAME).select("template_id", "ord", *ZONE)
    rejects = judged.filter(F.col("reason").isNotNull()).select(*FRAME, "name", "reason")
    return templates, template_zones, rejects


def template_order() -> list[Column]:
    """By combo number with unassigned last, then raster, then name."""
    return [
        (F.col("combo") == ""), F.col("combo").try_cast("double"), F.col("width"), F.col("height"), F.col("name"),
    ]


def sort_templates(templates: DataFrame, locale: bool = False) -> DataFrame:
    """locale=True orders names as people do (a A b B) rather than by code point."""
    order = template_order()
    if locale:
        order[-1] = F.collate(F.col("name"), "UNICODE")
    return templates.orderBy(*order)


def template_targets(
    images: DataFrame, templates: DataFrame, choices: DataFrame, scope: str = "frame"
) -> tuple[DataFrame, DataFrame]:
    """(targets, refusals) of choices (template_id, image_id): the open image each template is applied at.

    Scope "frame" is that image's open frame, "file" all its frames, "combo" all frames of every image with
    its combo and raster. A template built for another raster is refused, never rescaled; the refusal says
    how many images would fit.
    """
    if scope not in APPLY_SCOPES:
        raise ValueError(f"scope must be one of: {', '.join(APPLY_SCOPES)}.")
    raster = templates.select("template_id", F.col("width").alias("_tw"), F.col("height").alias("_th"))
    facts = images.select(
        "image_id", "width", "height", "frame_count", "open_frame", F.coalesce("combo", F.lit("")).alias("combo")
    )
    judged = lookup(choices.select("template_id", "image_id"), raster, ["template_id"], ["image_id"]).join(
        facts, "image_id"
    )
    fits = (F.col("width") == F.col("_tw")) & (F.col("height") == F.col("_th"))
    fitting = judged.filter(fits)
    key = F.col("template_id").alias("source_key")
    if scope == "frame":
        targets = fitting.select(key, "image_id", F.col("open_frame").cast("int").alias("frame_index"))
    elif scope == "file":
        targets = fitting.withColumn("frame_index", all_frames()).select(key, "image_id", "frame_index")
    else:
        layout = ["width", "height", "combo"]
        anchors = fitting.select("template_id", *layout).distinct()
        targets = (
            lookup(facts, anchors, layout, ["image_id"]).withColumn("frame_index", all_frames())
            .select(key, "image_id", "frame_index")
        )
    sizes = facts.groupBy(F.col("width").alias("_tw"), F.col("height").alias("_th")).agg(
        F.count("*").alias("fitting_images")
    )
    refusals = (
        lookup(judged.filter(~fits), sizes, ["_tw", "_th"], ["image_id"], "left")
        .select(
            "template_id", "image_id", F.col("_tw").alias("template_width"), F.col("_th").alias("template_height"),
            "width", "height", F.coalesce("fitting_images", F.lit(0)).alias("fitting_images"),
        )
    )
    return targets, refusals


def plan_template(
    template_zones: DataFrame, targets: DataFrame, zones: DataFrame, mode: str = "merge"
) -> DataFrame:
    """The copy plan that applies templates to their targets."""
    return plan_copy(template_zones.withColumnRenamed("template_id", "source_key"), targets, zones, mode)
