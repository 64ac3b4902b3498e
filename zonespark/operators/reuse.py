"""Copying zones between frames and files of exactly the same raster: targets, a priced plan, the write."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonespark.functions.geometry import clipped, has_area
from zonespark.plans.ordering import beside_each_other, join_large, lookup, materialise, with_rank_within
from zonespark.schemas import FRAME, ZONE

SCOPES = ["frames", "files", "files-all-frames"]


def source_zones(zones: DataFrame, images: DataFrame) -> DataFrame:
    """Zones fit to be copied: some of their area is on the raster. Coordinates stay as they are."""
    raster = images.select("image_id", F.col("width").alias("_rw"), F.col("height").alias("_rh"))
    usable = join_large(zones, raster, ["image_id"]).filter(has_area(clipped(F.col("_rw"), F.col("_rh"))))
    return usable.withColumn("note", F.coalesce("note", F.lit(""))).select(*FRAME, "ord", *ZONE)


def all_frames() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("frame_count") - 1))


def reuse_targets(images: DataFrame, sources: DataFrame, scope: str = "files", same_combo: bool = False) -> DataFrame:
    """Frames each source frame may be copied to: (source_id, source_frame, image_id, frame_index).

    `sources` lists chosen frames (image_id, frame_index). Scope "frames" takes the other frames of the same
    file, "files" the open frame of every other file of identical raster, "files-all-frames" all of theirs.
    same_combo also asks for an equal combo, where no combo equals no combo. The result has a row per
    source and target, so choose sources, say one per layout, rather than passing every frame there is.
    """
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of: {', '.join(SCOPES)}.")
    chosen = sources.select(
        F.col("image_id").alias("source_id"), F.col("frame_index").cast("int").alias("source_frame")
    )
    facts = images.select(
        "image_id", "width", "height", "frame_count", "open_frame", F.coalesce("combo", F.lit("")).alias("combo")
    )
    if scope == "frames":
        own = chosen.join(facts, F.col("source_id") == F.col("image_id"))
        return (
            own.withColumn("frame_index", all_frames())
            .filter(F.col("frame_index") != F.col("source_frame"))
            .select("source_id", "source_frame", "image_id", "frame_index")
        )
    keys = ["width", "height", "combo"] if same_combo else ["width", "height"]
    placed = chosen.join(facts.withColumnRenamed("image_id", "source_id"), "source_id").select(
        "source_id", "source_frame", *keys
    )
    pairs = lookup(facts, placed, keys, ["image_id"]).filter(F.col("image_id") != F.col("source_id"))
    frame = all_frames() if scope == "files-all-frames" else F.col("open_frame").cast("int")
    return pairs.withColumn("frame_index", frame).select("source_id", "source_frame", "image_id", "frame_index")


def plan_copy(
    source: DataFrame, targets: DataFrame, zones: DataFrame, mode: str = "merge", copies: int = 16
) -> DataFrame:
    """The zones every changed frame would get, one row per zone: a plan, nothing is written.

    `source` holds zones under a key (source_key, ord, zone columns), `targets` the frames each key goes to
    (source_key, image_id, frame_index). Columns: image_id, frame_index, source_key, ord, zone columns,
    is_new. Merge keeps what a frame has and adds zones it lacks; replace swaps its contents. A frame that would not
    change is not in the plan. One source per target frame is expected, as one action copies one source.
    A source that goes to very many frames is divided over `copies` tasks; 1 suits one target per source.
    """
    _check_mode(mode)
    once = source.groupBy("source_key", *ZONE).agg(F.min("ord").alias("ord"))
    existing = zones.withColumn("note", F.coalesce("note", F.lit("")))
    if mode == "merge":
        return _merged(once, targets.select("source_key", *FRAME).distinct(), existing, copies)
    once, targets = materialise(once), materialise(targets.select("source_key", *FRAME))
    changed = materialise(_replaced_frames(once, targets, existing, copies))
    # Not one zone more than the plan has is written or shuffled: changed frames meet their source's zones at the end.
    fresh = _offered(once, changed, copies)
    # A frame emptied by the swap still has to be in the plan: it appears with no zone.
    emptied = lookup(changed, once.select("source_key").distinct(), ["source_key"], FRAME, "left_anti", copies)
    nothing = [F.lit(None).cast("string" if c == "note" else "int").alias(c) for c in ZONE]
    blank = emptied.select(*FRAME, "source_key", F.lit(None).cast("bigint").alias("ord"), *nothing)
    return _plan_rows(fresh, True).unionByName(_plan_rows(blank, False))


def _check_mode(mode: str) -> None:
    if mode not in ("merge", "replace"):
        raise ValueError("mode must be merge or replace.")


def _plan_rows(rows: DataFrame, is_new: bool) -> DataFrame:
    return rows.select(
        *FRAME, "source_key", F.col("ord").cast("bigint").alias("ord"), *ZONE, F.lit(is_new).alias("is_new")
    )


def _offered(once: DataFrame, targets: DataFrame, copies: int) -> DataFrame:
    """Each target frame, with whatever it carries, beside the distinct zones of its source."""
    return lookup(targets, once, ["source_key"], FRAME, "inner", copies)


def _merged(once: DataFrame, targets: DataFrame, existing: DataFrame, copies: int) -> DataFrame:
    """The plan of a merge. What a source offers is not compared with every frame's zones: the zones that frames hold look for their
    equals among those offered, so what is shuffled and written grows with frames and zones, not with their product."""
    frame = ["source_key", *FRAME]
    standing = join_large(existing.select(*FRAME, *ZONE), targets, FRAME)
    held = materialise(lookup(standing, once.drop("ord"), ["source_key", *ZONE], FRAME, "inner", copies).distinct())
    met = held.groupBy(*frame).agg(F.count("*").alias("_met"))
    last = existing.groupBy(*FRAME).agg(F.max("ord").alias("_last"))
    sizes = once.groupBy("source_key").agg(F.count("*").alias("_n"))
    judged = lookup(targets.join(met, frame, "left"), sizes, ["source_key"], FRAME, "inner", copies)
    lacking = judged.filter(F.coalesce("_met", F.lit(0)) < F.col("_n")).join(last, FRAME, "left")
    changed = materialise(lacking.select(*frame, F.col("_met").isNotNull().alias("_some"), "_last"))
    # Only frames that hold some of the zones are compared zone by zone.
    offered = _offered(once, changed, copies)
    some = join_large(offered.filter("_some"), held, [*frame, *ZONE], "left_anti")
    added = offered.filter("NOT _some").unionByName(some).withColumn(
        "ord", F.coalesce(F.col("_last"), F.lit(-1)) + 1 + F.col("ord")
    )
    return _plan_rows(join_large(existing, changed.select(*frame), FRAME), False).unionByName(_plan_rows(added, True))


def _fingerprints(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Per key how many zones it lists (n) and two hashes of which zone stands where: equal lists have equal ones."""
    hashes = [F.bit_xor(F.xxhash64(F.lit(seed), "place", *ZONE)).alias(f"h{seed}") for seed in (1, 2)]
    return placed.groupBy(*keys).agg(F.count("*").alias("n"), *hashes)


def _replaced_frames(once: DataFrame, targets: DataFrame, existing: DataFrame, copies: int) -> DataFrame:
    """Target frames whose zones differ from their source's in content or order.

    A list of zones is told by one fingerprint, added up from its zones in any order, so a target meets two rows: that of its
    source and that of its frame. Only lists with equal fingerprints are compared zone by zone. No frame's zones are gathered in a task.
    """
    placed = with_rank_within(once, ["source_key"], ["ord", *ZONE], "place").drop("ord")
    aimed_at = join_large(existing, targets.select(*FRAME), FRAME, "left_semi").select(*FRAME, "ord", *ZONE)
    standing = with_rank_within(aimed_at, FRAME, ["ord", *ZONE], "place").drop("ord")
    names = ("n", "h1", "h2")
    wanted = _fingerprints(placed, ["source_key"])
    held = _fingerprints(standing, FRAME).withColumnsRenamed({c: f"{c}_held" for c in names})
    beside = lookup(targets.select("source_key", *FRAME), wanted, ["source_key"], FRAME, "left", copies)
    beside = join_large(beside, held, FRAME, "left")
    alike = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_held")) for c in names])
    judged = materialise(beside.select("source_key", *FRAME, "n", alike.alias("alike")))
    # Hashes only tell where it is worth looking.
    equal = judged.filter(F.col("alike") & F.col("n").isNotNull())
    both = join_large(_offered(placed, equal, copies), standing, [*FRAME, "place", *ZONE])
    met = both.groupBy("source_key", *FRAME).agg(F.count("*").alias("met"))
    same = join_large(equal, met, ["source_key", *FRAME]).filter("met = n").select("source_key", *FRAME)
    nothing = judged.filter(F.col("alike") & F.col("n").isNull()).select("source_key", *FRAME)
    kept = join_large(judged.select("source_key", *FRAME), same.unionByName(nothing), ["source_key", *FRAME], "left_anti")
    return kept.select(*FRAME, "source_key")


def apply_plan(zones: DataFrame, plan: DataFrame) -> DataFrame:
    """zones with every planned frame's contents swapped for the plan's."""
    columns = [*FRAME, "ord", *ZONE]
    untouched = zones.join(plan.select(*FRAME).distinct(), FRAME, "left_anti").select(*columns)
    return untouched.unionByName(plan.filter(F.col("x").isNotNull()).select(*columns))


def price_plan(
    source: DataFrame, targets: DataFrame, zones: DataFrame, plan: DataFrame, mode: str = "merge", copies: int = 16
) -> DataFrame:
    """One row: zones added, frames and files changed, zones replaced, duplicates skipped, zones offered.

    Every source zone offered to a target is either new there or a duplicate, also on frames left unchanged.
    """
    _check_mode(mode)
    # Two steps, so that a source with many zones is counted by zone first.
    sizes = (
        source.groupBy("source_key", *ZONE).agg(F.count("*").alias("_times"))
        .groupBy("source_key").agg(F.sum("_times").alias("_all"), F.count("*").alias("_once"))
    )
    offers = lookup(
        targets.select("source_key", *FRAME), sizes, ["source_key"], FRAME, "left", copies
    ).fillna(0, ["_all", "_once"])
    totals = offers.agg(
        F.coalesce(F.sum("_all"), F.lit(0)).alias("offered"),
        F.coalesce(F.sum(F.col("_all") - F.col("_once")), F.lit(0)).alias("repeated"),
    )
    per_frame = plan.groupBy(*FRAME).agg(F.count_if("is_new").alias("added"))
    per_file = per_frame.groupBy("image_id").agg(F.sum("added").alias("added"), F.count("*").alias("frames"))
    written = per_file.agg(
        F.coalesce(F.sum("added"), F.lit(0)).alias("added"),
        F.coalesce(F.sum("frames"), F.lit(0)).alias("frames"),
        F.count("*").alias("files"),
    )
    if mode == "replace":
        swapped = zones.join(plan.select(*FRAME).distinct(), FRAME, "left_semi")
        lost = swapped.agg(F.count("*").alias("replaced"))
        price = beside_each_other(totals, written, lost)
        duplicates = F.col("repeated")
    else:
        price = beside_each_other(totals, written).withColumn("replaced", F.lit(0).cast("bigint"))
        duplicates = F.col("offered") - F.col("added")
    return price.select("added", "frames", "files", "replaced", duplicates.alias("duplicates"), "offered")


def describe_plan(price: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """The price as a sentence. With the source's zones given, a source without any is named as the reason."""

    def boxes(c: str) -> Column:
        return F.concat(F.col(c).cast("string"), F.when(F.col(c) == 1, " box").otherwise(" boxes"))

    def plural(c: str, word: str) -> Column:
        return F.concat(F.col(c).cast("string"), F.when(F.col(c) == 1, f" {word}").otherwise(f" {word}s"))

    parts = F.array(
        F.concat(boxes("added"), F.lit(" into "), plural("frames", "frame"), F.lit(" across "), plural("files", "file")),
        F.when(F.col("replaced") > 0, F.concat(boxes("replaced"), F.lit(" replaced"))),
        F.when(F.col("duplicates") > 0, F.concat(plural("duplicates", "duplicate"), F.lit(" skipped"))),
    )
    nothing = F.when(F.col("duplicates") > 0, "Every eligible frame already has these boxes.").otherwise(
        "No eligible destination frames."
    )
    held = price.withColumn("_held", F.lit(1))
    if source is not None:
        held = beside_each_other(price, source.agg(F.count("*").alias("_held")))
    return held.select(
        F.when(F.col("_held") == 0, "This frame has no boxes to copy.").when(F.col("frames") == 0, nothing)
        .otherwise(F.array_join(F.array_compact(parts), " · ")).alias("text")
    )


def copy_previous_frame(zones: DataFrame, images: DataFrame) -> DataFrame:
    """The plan that merges every frame's zones into the frame after it."""
    source = source_zones(zones, images).withColumn("source_key", F.struct(*FRAME))
    frames = images.select("image_id", "frame_count")
    targets = (
        source.select(*FRAME).distinct().join(frames, "image_id")
        .filter(F.col("frame_index") + 1 < F.col("frame_count"))
        .select(
            F.struct("image_id", "frame_index").alias("source_key"), "image_id",
            (F.col("frame_index") + 1).alias("frame_index"),
        )
    )
    return plan_copy(source, targets, zones, "merge", copies=1)
