"""From OCR output to boxes: levels, padding, floors, joining, coverage.

Recognised text lives only in the `text` column of regions and detections. Nothing here copies it to a
note, and no sink accepts a table that has it.
"""

from dataclasses import asdict, dataclass, fields
from functools import reduce
from math import floor, isfinite

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonespark.functions.geometry import clamp, js_round
from zonespark.functions.merge import join_boxes
from zonespark.functions.text import clean_text, readable
from zonespark.plans.ordering import materialise
from zonespark.schemas import FRAME, RECOGNISED, RECT
from zonespark.shipping import ship_package

# Levels of the OCR hierarchy, limits of the settings, the note of an accepted box.
GRANULARITIES = ["word", "line", "paragraph", "block"]
LIMITS = {
    "padding": (0, 40), "confidence": (0, 100), "min_width": (0, 400), "min_height": (0, 400),
    "min_chars": (1, 20), "merge_gap": (0, 200), "scale": (1, 4),
}
ACCEPTED_NOTE = "detected text"
MAX_PROFILES = 24
MAX_PROFILE_NAME = 40


@dataclass(frozen=True)
class Settings:
    """How OCR output becomes boxes. The defaults."""

    granularity: str = "line"
    padding: int = 4
    confidence: int = 60
    min_width: int = 6
    min_height: int = 6
    min_chars: int = 2
    merge_gap: int = 0
    scale: int = 1


def validate_settings(given: dict | Settings | None = None) -> Settings:
    """Known settings rounded and clamped into range; anything else falls back to its default."""
    given = asdict(given) if isinstance(given, Settings) else dict(given or {})
    kept = {}
    if given.get("granularity") in GRANULARITIES:
        kept["granularity"] = given["granularity"]
    for name, (low, high) in LIMITS.items():
        value = given.get(name)
        if isinstance(value, (int, float)) and not isinstance(value, bool) and isfinite(value):
            kept[name] = max(low, min(high, floor(value + 0.5)))
    return Settings(**kept)


def with_valid_settings(table: DataFrame) -> DataFrame:
    """validate_settings per row: columns named like settings become one `settings` column, as sweeps read it."""
    fallback = asdict(Settings())

    def valid(name: str) -> Column:
        if name not in table.columns:
            return F.lit(fallback[name])
        if name == "granularity":
            return F.when(F.col(name).isin(GRANULARITIES), F.col(name)).otherwise(fallback[name])
        value, (low, high) = F.col(name).cast("double"), LIMITS[name]
        known = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
        return F.when(known, clamp(js_round(value), low, high)).otherwise(fallback[name]).cast("int")

    others = [c for c in table.columns if c not in fallback]
    return table.select(*others, F.struct(*[valid(name).alias(name) for name in fallback]).alias("settings"))


def same_settings(a, b) -> bool:
    return validate_settings(a) == validate_settings(b)


def validate_profiles(given) -> list[tuple[str, Settings]]:
    """Up to 24 named settings; names are trimmed to 40 characters and unique whatever their case."""
    profiles: dict[str, tuple[str, Settings]] = {}
    for entry in given[:MAX_PROFILES] if isinstance(given, list) else []:
        entry = entry if isinstance(entry, dict) else {}
        name = str(entry.get("name") or "").strip()[:MAX_PROFILE_NAME]
        if name:
            profiles.setdefault(name.lower(), (name, validate_settings(entry.get("settings"))))
    return list(profiles.values())


def _config(settings: Settings | None) -> dict[str, Column]:
    """Settings as columns: literals, or the fields of a `settings` column when none are given."""
    if settings is None:
        return {f.name: F.col("settings")[f.name] for f in fields(Settings)}
    return {name: F.lit(value) for name, value in asdict(validate_settings(settings)).items()}


def recognised(text: Column, name: str = "text") -> Column:
    """A column of recognised text. Its mark follows it through renaming and joins, and no writer takes it."""
    return text.alias(name, metadata={RECOGNISED: True})


_BOX_FIELDS = ("bbox", "text", "confidence")


def _level(array: Column) -> Column:
    return F.transform(array, lambda region: F.struct(*[region[f].alias(f) for f in _BOX_FIELDS]))


def _children(array: Column, field: str) -> Column:
    return F.flatten(F.transform(array, lambda parent: F.coalesce(parent[field], F.array())))


def regions_at(granularity: Column) -> Column:
    """The array of regions one OCR result (columns blocks, lines) has at a level."""
    blocks = F.coalesce("blocks", F.array())
    paragraphs = _children(blocks, "paragraphs")
    nested = _children(paragraphs, "lines")
    flat = F.coalesce("lines", F.array())
    lines = F.when(F.size(nested) > 0, nested).otherwise(flat)
    return (
        F.when(granularity == "block", _level(blocks))
        .when(granularity == "paragraph", _level(paragraphs))
        .when(granularity == "word", _level(_children(nested, "words")))
        .otherwise(_level(lines))
    )


def extract_regions(ocr_raw: DataFrame, granularity: str | None = "line") -> DataFrame:
    """One row per region at a level, in reading order; other columns of ocr_raw are carried along.

    granularity=None reads the level from a `settings` column.
    """
    level = F.col("settings.granularity") if granularity is None else F.lit(granularity)
    others = [c for c in ocr_raw.columns if c not in ("blocks", "lines")]
    return ocr_raw.select(*others, F.posexplode(regions_at(level)).alias("region_ord", "region")).select(
        *others, "region_ord",
        *[F.col(f"region.bbox.{edge}").alias(edge) for edge in ("x0", "y0", "x1", "y1")],
        recognised(F.col("region.text")), "region.confidence",
    )


def detections(
    regions: DataFrame, images: DataFrame, settings: Settings | None = Settings(), order: list[str] | None = None
) -> DataFrame:
    """Regions with enough readable text as padded boxes on the raster, one per rectangle and frame.

    Edges are divided by the scale the raster was enlarged by before recognition (column `scale` of the
    regions, 1 where absent). Of equal rectangles the first in `order` stays. settings=None reads them
    from a `settings` column, as profile_sweep does.
    """
    cfg = _config(settings)
    found = _distinct_boxes(regions, images, settings, order, {"": readable(F.col("text"), cfg["min_chars"])})
    return found.select(
        *[c for c in found.columns if c not in (*RECT, "first_")], F.col("first_._0").alias("ord"), *RECT,
        recognised(F.col("first_.text")), "first_.confidence",
    )


def _distinct_boxes(
    regions: DataFrame, images: DataFrame, settings: Settings | None, order: list[str] | None, passing: dict[str, Column]
) -> DataFrame:
    """Distinct boxes per frame, and for each condition that regions may pass the first of the box that does (first_ and its name).

    A box is there if any of its regions passes any condition.
    """
    cfg = _config(settings)
    order = order or ["region_ord"]
    keys = [*FRAME, "profile"] if settings is None else list(FRAME)
    scale = F.coalesce(F.col("scale"), F.lit(1.0)) if "scale" in regions.columns else F.lit(1.0)
    factor = F.when(scale > 0, scale).otherwise(1.0)
    raster = images.select(
        "image_id", F.col("width").alias("ref_width"), F.col("height").alias("ref_height")
    )

    def edge(name: str, outward: int, limit: str) -> Column:
        return clamp(js_round(F.col(name) / factor) + outward * cfg["padding"], 0, F.col(limit))

    has_box = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    x, y = edge("x0", -1, "ref_width"), edge("y0", -1, "ref_height")
    right, bottom = edge("x1", 1, "ref_width"), edge("y1", 1, "ref_height")
    boxes = (
        regions.filter(has_box & reduce(lambda a, b: a | b, passing.values()))
        .join(raster, "image_id")
        .withColumns({"_x": x, "_y": y, "_w": right - x, "_h": bottom - y})
        .filter((F.col("_w") >= F.greatest(F.lit(1), cfg["min_width"])))
        .filter((F.col("_h") >= F.greatest(F.lit(1), cfg["min_height"])))
    )
    confidence = js_round(F.coalesce(F.nanvl(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(0.0)))
    carried = ["settings"] if settings is None else []
    # The smallest place in the order wins, by partial aggregation: copies never travel.
    first = F.struct(
        *[F.col(c).cast("bigint").alias(f"_{i}") for i, c in enumerate(order)],
        clean_text(F.col("text")).alias("text"), confidence.alias("confidence"),
    )
    return boxes.groupBy(
        *keys, *carried, F.col("_x").alias("x"), F.col("_y").alias("y"),
        F.col("_w").alias("width"), F.col("_h").alias("height"),
    ).agg(*[F.min(F.when(condition, first)).alias(f"first_{name}") for name, condition in passing.items()])


def above_confidence(boxes: DataFrame, threshold) -> DataFrame:
    return boxes.filter(F.col("confidence") >= threshold)


_MERGED = "array<struct<ord: bigint, x: int, y: int, width: int, height: int, text: string, confidence: int>>"


def _join_islands(*columns: pd.Series) -> pd.Series:
    # An island of one box has nothing to join; its columns are NULL and it passes by.
    return pd.Series([None if island[0] is None else join_boxes(*island) for island in zip(*columns)])


def _cut_along(boxes: DataFrame, keys: list[str], start: str, length: str, gap: Column, name: str) -> DataFrame:
    """Number the islands of boxes along one axis: runs with no clear strip wider than the gap.

    Boxes of different islands can never come near each other, however far either side grows. The window
    runs over the distinct starts of a frame, so over no more rows than the raster has pixels on that axis.
    """
    ends = boxes.groupBy(*keys, start).agg(
        F.max(F.col(start) + F.col(length)).alias("_end"), F.max(gap).alias("_gap")
    )
    along = Window.partitionBy(*keys).orderBy(start)
    reach = F.max("_end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = ends.withColumn("_reach", reach).withColumn(
        "_new", F.when(F.col("_reach").isNull() | (F.col(start) - F.col("_gap") > F.col("_reach")), F.col(start))
    )
    islands = marked.select(*keys, start, F.max("_new").over(along).alias(name))
    return boxes.join(islands, [*keys, start])


_PARTS = ("ord", *RECT, "text", "confidence")


def merge_boxes(boxes: DataFrame, gap=None) -> DataFrame:
    """Join boxes of a frame whose distance is within `gap` on both axes, until none are left to join.

    gap=None reads it from settings.merge_gap; a gap of 0 joins nothing.

    Frames are cut into islands along y and then x. Boxes of different islands never come near each other, so every
    island is joined on its own, one box after the other, with the same result as the whole frame in one go. An island
    lies in one frame of distinct rectangles: it does not grow with the library.
    """
    if gap is not None and not gap > 0:
        return boxes
    ship_package(boxes.sparkSession)
    width = F.lit(gap) if gap is not None else F.col("settings.merge_gap")
    columns = boxes.columns
    extra = [c for c in columns if c == "settings"]
    frame = [c for c in columns if c not in (*_PARTS, *extra)]
    cut = _cut_along(materialise(boxes), frame, "y", "height", width, "_a")
    cut = _cut_along(cut, [*frame, "_a"], "x", "width", width, "_b")
    gathered = cut.groupBy(*frame, "_a", "_b", *extra).agg(F.array_sort(F.collect_list(F.struct(*_PARTS))).alias("_boxes"))
    several = F.when(F.size("_boxes") > 1, F.col("_boxes"))
    islands = [several[c] for c in _PARTS]
    joined = F.coalesce(F.pandas_udf(_join_islands, _MERGED)(*islands, width), F.col("_boxes"))
    parts = gathered.select(*frame, *extra, F.explode(joined).alias("_box"))
    return parts.select(*[
        recognised(F.col("_box")[c]) if c == "text" else F.col("_box")[c].alias(c) if c in _PARTS else F.col(c) for c in columns
    ])


def visible_detections(boxes: DataFrame, settings: Settings | None = Settings()) -> DataFrame:
    """The confidence floor first, so noise cannot stretch a box, then the joining."""
    cfg = validate_settings(settings) if settings is not None else None
    floor_value = F.col("settings.confidence") if cfg is None else cfg.confidence
    return merge_boxes(above_confidence(boxes, floor_value), None if cfg is None else cfg.merge_gap)


def drop_resolved(boxes: DataFrame, dropped: DataFrame) -> DataFrame:
    """Boxes whose rectangle was neither accepted nor dismissed before on the same frame."""
    return boxes.join(dropped.select(*FRAME, *RECT).distinct(), [*FRAME, *RECT], "left_anti")


def to_zones(boxes: DataFrame) -> DataFrame:
    """Boxes as zones. The note is a constant; the recognised text stays behind."""
    return boxes.select(*FRAME, "ord", *RECT, F.lit(ACCEPTED_NOTE).alias("note"))


def accept_detections(boxes: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(zones with the boxes appended to their frames, the rectangles now resolved)."""
    last = zones.groupBy(*FRAME).agg(F.max("ord").alias("_last"))
    placed = to_zones(boxes).join(last, FRAME, "left")
    after = F.coalesce(F.col("_last"), F.lit(-1)) + 1 + F.col("ord")
    added = placed.withColumn("ord", after.cast("bigint")).drop("_last")
    columns = [*FRAME, "ord", *RECT, "note"]
    return zones.select(*columns).unionByName(added.select(*columns)), boxes.select(*FRAME, *RECT).distinct()


#: Sizes of the cells a zone may lie in, as powers of two; beyond the last there is one cell for everything.
_CELLS = (5, 7, 9, 11, 13)
_EVERYWHERE = 31
#: Added to coordinates before they are cut into cells, so that a raster's edge lies on no cell's.
_SHIFT = (1 << 30) + 4096


def _shifted(edge: Column, bits: Column) -> Column:
    return F.call_function("shiftright", edge.cast("bigint") + _SHIFT, bits)


def _smallest_cell(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The smallest of the cell sizes at which a rectangle lies in a single cell."""

    def fits(c: int) -> Column:
        return (_shifted(x0, F.lit(c)) == _shifted(x1, F.lit(c))) & (_shifted(y0, F.lit(c)) == _shifted(y1, F.lit(c)))

    return reduce(lambda rest, c: F.when(fits(c), c).otherwise(rest), reversed(_CELLS), F.lit(_EVERYWHERE))


def _cell(edge: Column, size: Column) -> Column:
    return F.when(size == _EVERYWHERE, 0).otherwise(_shifted(edge, size))


def uncovered(boxes: DataFrame, zones: DataFrame, scope: str = "frame") -> DataFrame:
    """Boxes that do not lie wholly inside a single zone of their frame (or, scope="file", of their file).

    Every zone lies in one cell, the smallest of a few sizes that holds it whole; a zone around a box lies in a cell around the box, so
    a distinct box looks into the one cell of each size that holds it. No zone is repeated, and one image with a large share of all boxes
    is divided by its cells. Of zones with the same corner and width only the tallest can matter, which drops repeated zones before they travel.
    Zones of images without a box are left out first: where boxes lie on few images, the others' zones are neither grouped nor sorted.
    """
    keys = FRAME if scope == "frame" else ["image_id"]
    right, bottom = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    boxed = boxes.select("image_id").distinct()
    tallest = zones.join(boxed, "image_id", "left_semi").groupBy(*keys, F.col("x").alias("zx0"), F.col("y").alias("zy0"), right.alias("zx1")).agg(F.max(bottom).alias("zy1"))
    edges = [F.col(c) for c in ("zx0", "zy0", "zx1", "zy1")]
    placed = (
        tallest.filter((F.col("zx1") >= F.col("zx0")) & (F.col("zy1") >= F.col("zy0")))
        .withColumn("_size", _smallest_cell(*edges))
        .withColumns({"_across": _cell(F.col("zx0"), F.col("_size")), "_down": _cell(F.col("zy0"), F.col("_size"))})
    )
    own = _smallest_cell(F.col("x"), F.col("y"), right, bottom)
    sizes = F.array(*[F.lit(s) for s in (*_CELLS, _EVERYWHERE)])
    asking = (
        boxes.select(*keys, *RECT).distinct().withColumn("_own", own)
        .withColumn("_size", F.explode(F.filter(sizes, lambda s: s >= F.col("_own"))))
        .withColumns({"_across": _cell(F.col("x"), F.col("_size")), "_down": _cell(F.col("y"), F.col("_size"))})
    )
    b, z = asking.alias("b"), placed.alias("z")
    condition = (
        (F.col("b.x") >= F.col("z.zx0"))
        & (F.col("b.y") >= F.col("z.zy0"))
        & (F.col("b.x") + F.col("b.width") <= F.col("z.zx1"))
        & (F.col("b.y") + F.col("b.height") <= F.col("z.zy1"))
    )
    for key in [*keys, "_size", "_across", "_down"]:
        condition = condition & (F.col(f"b.{key}") == F.col(f"z.{key}"))
    covered = b.join(z, condition, "left_semi").select(*keys, *RECT).distinct()
    return boxes.join(covered, [*keys, *RECT], "left_anti").select(*boxes.columns)


def coverage_report(boxes: DataFrame, zones: DataFrame, confidence: int = 0) -> DataFrame:
    """Per frame: boxes shown, boxes not covered by a zone, and boxes hidden below the floor.

    It says what was found. No text found is not the same as no text present.
    """
    shown = F.col("confidence") >= confidence
    zero = F.lit(0)
    tally = boxes.select(
        *FRAME, shown.cast("int").alias("detected"), zero.alias("uncovered"), (~shown).cast("int").alias("below_floor")
    ).unionByName(
        uncovered(above_confidence(boxes, confidence), zones).select(
            *FRAME, zero.alias("detected"), F.lit(1).alias("uncovered"), zero.alias("below_floor")
        )
    )
    return tally.groupBy(*FRAME).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("detected", "uncovered", "below_floor")]
    )


def with_profiles(table: DataFrame, profiles: list[tuple[str, Settings]]) -> DataFrame:
    """Each row once per profile, with its name and settings: an array of at most 24 literals, exploded."""
    options = F.array(
        *[
            F.struct(
                F.lit(name).alias("profile"),
                F.struct(*[F.lit(v).alias(k) for k, v in asdict(settings).items()]).alias("settings"),
            )
            for name, settings in profiles
        ]
    )
    return table.withColumn("_option", F.explode(options)).select(
        *table.columns, "_option.profile", "_option.settings"
    )


def _placements(profiles: list[tuple[str, Settings]]) -> dict[tuple[str, int], list[tuple[str, Settings]]]:
    """Profiles by what decides where their boxes lie: the level and the padding."""
    placed: dict[tuple[str, int], list[tuple[str, Settings]]] = {}
    for name, settings in profiles:
        placed.setdefault((settings.granularity, settings.padding), []).append((name, settings))
    return placed


def _placed_boxes(ocr_raw: DataFrame, images: DataFrame, profiles: list[tuple[str, Settings]], order: list[str] | None) -> DataFrame:
    """Every distinct box once per level and padding (column profile names the placement), whatever the other settings.

    `winners` has, per least number of characters that some profile asks for, the first region of the box with as many.
    """
    wide = [
        (str(i), Settings(granularity=level, padding=padding, confidence=0, min_width=0, min_height=0, min_chars=1))
        for i, (level, padding) in enumerate(_placements(profiles))
    ]
    least = sorted({s.min_chars for _, s in profiles})
    regions = extract_regions(with_profiles(ocr_raw, wide), None)
    return _distinct_boxes(regions, images, None, order, {str(n): readable(F.col("text"), n) for n in least}).withColumn(
        "winners", F.array(*[F.struct(F.lit(n).alias("min_chars"), F.col(f"first_{n}").alias("first")) for n in least])
    ).drop(*[f"first_{n}" for n in least])


def profile_sweep(
    ocr_raw: DataFrame, images: DataFrame, zones: DataFrame, profiles, order: list[str] | None = None
) -> DataFrame:
    """What each named settings profile would show on the same recognition run: counts per profile.

    Regions are read and placed once per level and padding. All profiles of a placement are then counted in one
    pass over its boxes; only profiles that join boxes get rows of their own, once for those that join alike.
    """
    chosen = validate_profiles(profiles)
    if not chosen:
        raise ValueError("A sweep needs at least one profile with a name.")
    boxes = materialise(_placed_boxes(ocr_raw, images, chosen, order))
    keys = [*FRAME, "profile", *RECT]
    bare = uncovered(boxes.select(*keys), zones).withColumn("_bare", F.lit(True))
    marked = boxes.join(bare, keys, "left")
    numbers = {place: str(i) for i, place in enumerate(_placements(chosen))}

    def wanted(s: Settings) -> Column:
        """The confidence of the box as a profile sees it, NULL if it does not."""
        first = F.filter("winners", lambda w: w["min_chars"] == s.min_chars)[0]["first"]
        fits = (
            (F.col("profile") == numbers[s.granularity, s.padding])
            & (F.col("width") >= max(1, s.min_width)) & (F.col("height") >= max(1, s.min_height))
        )
        return F.when(fits, first["confidence"])

    counts = []
    for i, (_, s) in enumerate(chosen):
        seen = wanted(s)
        shown = seen >= s.confidence
        counts += [
            F.count_if(shown).alias(f"detected_{i}"), F.count_if(shown & F.coalesce("_bare", F.lit(False))).alias(f"uncovered_{i}"),
            F.count_if(seen < s.confidence).alias(f"below_floor_{i}"),
        ]
    tally = marked.agg(*counts).select(
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("profile"), *[F.col(f"{c}_{i}").alias(c) for c in ("detected", "uncovered", "below_floor")])
            for i, (name, _) in enumerate(chosen)
        ])).alias("t")
    ).select("t.*")
    joining = {s: [] for _, s in chosen if s.merge_gap > 0}
    for name, s in chosen:
        if s.merge_gap > 0:
            joining[s].append(name)
    if not joining:
        return tally
    # Settings that differ in nothing are joined once.
    settings = F.array(*[
        F.when(wanted(s) >= s.confidence, F.struct(F.lit(str(i)).alias("number"), F.lit(s.min_chars).alias("min_chars"), F.struct(*[F.lit(v).alias(k) for k, v in asdict(s).items()]).alias("settings")))
        for i, s in enumerate(joining)
    ])
    shown = boxes.withColumn("_one", F.explode(F.array_compact(settings))).withColumn(
        "_first", F.filter("winners", lambda w: w["min_chars"] == F.col("_one.min_chars"))[0]["first"]
    ).select(
        *FRAME, F.col("_one.number").alias("profile"), "_one.settings", F.col("_first._0").alias("ord"), *RECT,
        recognised(F.col("_first.text")), "_first.confidence",
    )
    joined = materialise(merge_boxes(shown, None))
    left = uncovered(joined, zones)
    zero = F.lit(0)
    again = joined.select("profile", F.lit(1).alias("detected"), zero.alias("uncovered")).unionByName(
        left.select("profile", zero.alias("detected"), F.lit(1).alias("uncovered"))
    ).groupBy("profile").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("detected", "uncovered")])
    told = again.select(F.explode(F.element_at(_names_of(joining), F.col("profile"))).alias("profile"), "detected", "uncovered")
    joins = [name for names in joining.values() for name in names]
    apart = tally.filter(~F.col("profile").isin(joins))
    floors = tally.filter(F.col("profile").isin(joins)).select("profile", "below_floor").join(told, "profile", "left")
    return apart.unionByName(floors.select(
        "profile", F.coalesce("detected", F.lit(0)).alias("detected"), F.coalesce("uncovered", F.lit(0)).alias("uncovered"), "below_floor"
    ))


def _names_of(joining: dict[Settings, list[str]]) -> Column:
    """The names of the profiles that join alike, by their number."""
    entries = [(F.lit(str(i)), F.array(*[F.lit(n) for n in names])) for i, names in enumerate(joining.values())]
    return F.create_map(*[c for entry in entries for c in entry])
