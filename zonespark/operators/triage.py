"""Which files still need work: counts, filters, search, groups and the order they are reviewed in."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonespark.functions.device import device_attributes, device_signature
from zonespark.functions.text import is_digits
from zonespark.plans.ordering import SLICE, across_slices, range_slices, slice_summary
from zonespark.plans.paged import PagedTable
from zonespark.schemas import DEVICE, IMAGE_RECORD

STATES = ["all", "unannotated", "annotated", "needs-combo", "source-needed"]
REVIEW_SCOPES = ["combo", "size", "all"]


def image_record(images: DataFrame) -> DataFrame:
    """The columns an image keeps when it is persisted."""
    return images.select(*[c for c in IMAGE_RECORD if c in images.columns])


def box_counts(images: DataFrame, zones: DataFrame) -> DataFrame:
    """images with `boxes`: zones over all frames, 0 where there are none."""
    counts = zones.groupBy("image_id").agg(F.count("*").alias("boxes"))
    return images.join(counts, "image_id", "left").fillna(0, ["boxes"])


def in_state(state: str) -> Column:
    """One triage state, as a predicate over a table with `boxes`, `combo` and `has_source`."""
    annotated = F.col("boxes") > 0
    if state == "unannotated":
        return ~annotated
    if state == "annotated":
        return annotated
    if state == "needs-combo":
        return annotated & ~is_digits(F.col("combo"))
    if state == "source-needed":
        return ~F.coalesce(F.col("has_source"), F.lit(False))
    return F.lit(True)


def triage_filter(images: DataFrame, zones: DataFrame, state: str = "all") -> DataFrame:
    """Images in one state. Any name that is not a state means all."""
    return box_counts(images, zones).filter(in_state(state))


def export_blockers(images: DataFrame, zones: DataFrame) -> DataFrame:
    """Annotated images whose combo cannot key a layout."""
    return triage_filter(images, zones, "needs-combo")


def filter_counts(images: DataFrame, zones: DataFrame) -> DataFrame:
    """One row with the number of images in every state, from a single pass."""
    counted = box_counts(images.select("image_id", "combo", "has_source"), zones)
    return counted.agg(*[F.count_if(in_state(s)).alias(s.replace("-", "_")) for s in STATES])


def search_images(images: DataFrame, query: str) -> DataFrame:
    """Images whose name, path or combo contains the query, whatever the case. No wildcards."""
    needle = query.strip().lower()
    if not needle:
        return images
    return images.filter(image_text().contains(needle))


def image_text() -> Column:
    """What an image is searched in, in lower case."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("name", "path", "combo")]))


def review_scope(images: DataFrame, anchor: dict | None, scope: str) -> DataFrame:
    """Images to review beside an anchor image: same combo, same combo and raster, or all of them."""
    if anchor is None or scope == "all":
        return images
    kept = images.filter(F.coalesce("combo", F.lit("")) == (anchor.get("combo") or ""))
    if scope != "size":
        return kept
    return kept.filter((F.col("width") == anchor["width"]) & (F.col("height") == anchor["height"]))


def review_flags(images: DataFrame, zones: DataFrame, uncovered: DataFrame | None = None) -> DataFrame:
    """images with `flags`: the reasons each deserves a second look. No flag is no verdict.

    `uncovered` has one row per uncovered detection, with its image_id.
    """
    counted = box_counts(images, zones)
    if uncovered is None:
        counted = counted.withColumn("uncovered", F.lit(0).cast("bigint"))
    else:
        per_image = uncovered.groupBy("image_id").agg(F.count("*").alias("uncovered"))
        counted = counted.join(per_image, "image_id", "left").fillna(0, ["uncovered"])
    flags = F.array(
        F.when(in_state("source-needed"), "no source").when(F.col("boxes") == 0, "no zones"),
        F.when(~is_digits(F.col("combo")), "no combo"),
        F.when(F.col("uncovered") > 0, F.concat(F.col("uncovered").cast("string"), F.lit(" uncovered"))),
    )
    return counted.withColumn("flags", F.array_compact(flags))


def group_library(images: DataFrame, zones: DataFrame) -> DataFrame:
    """One row per combo ('' is the unassigned group) with its progress and the devices it mixes."""
    # First down to one row per (combo, raster, device), so a hot combo is spread by what it holds.
    parts = (
        box_counts(images, zones)
        .groupBy(
            F.coalesce("combo", F.lit("")).alias("combo"),
            F.struct("width", "height").alias("raster"),
            device_signature().alias("signature"),
        )
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("boxes") > 0).alias("annotated"),
            F.min("import_idx").alias("first"),
        )
    )
    known = F.when(F.col("signature").isNotNull(), F.struct("first", "signature"))
    grouped = parts.groupBy("combo").agg(
        F.sum("total").alias("total"),
        F.sum("annotated").alias("annotated"),
        F.count_distinct("raster").alias("size_count"),
        F.count_distinct("signature").alias("device_count"),
        F.min(known).alias("known"),
    )
    return grouped.select(
        "combo",
        (F.col("combo") == "").alias("needs_combo"),
        "total", "annotated", "size_count", "device_count",
        (F.col("device_count") > 1).alias("mixed_devices"),
        *[F.col(f"known.signature.{c}").alias(c) for c in DEVICE],
    )


def group_sizes(images: DataFrame) -> DataFrame:
    """Files per raster within each combo."""
    return images.groupBy(F.coalesce("combo", F.lit("")).alias("combo"), "width", "height").agg(
        F.count("*").alias("files")
    )


def library_order() -> list[Column]:
    """Order of combos in the library: unassigned first, then by number, then by text."""
    return [
        (F.col("combo") != "").alias("assigned"),
        F.col("combo").try_cast("double").alias("combo_number"),
        F.col("combo").alias("combo_text"),
    ]


LIBRARY_ORDER = ["assigned", "combo_number", "combo_text"]


def sort_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy(*library_order())


def library_rollup(images: DataFrame, collapsed: DataFrame | None = None) -> DataFrame:
    """The library as an outline: a row per combo, per raster where a combo has several, and per file.

    `collapsed` lists combos shown as their header only. Sort by OUTLINE_ORDER to read it top to bottom.
    """
    files = images.select(
        F.coalesce("combo", F.lit("")).alias("combo"), "width", "height", "image_id", "import_idx"
    )
    totals = (
        files.rollup("combo", F.struct("width", "height").alias("raster"))
        .agg(F.count("*").alias("files"), F.grouping_id().alias("level"))
        .filter(F.col("level") < 3)
    )
    headers = totals.filter(F.col("level") == 1).select("combo", "files")
    sizes = totals.filter(F.col("level") == 0).select("combo", "raster.width", "raster.height", "files")
    per_combo = sizes.groupBy("combo").agg(F.count("*").alias("rasters"))
    sizes = sizes.join(per_combo.filter(F.col("rasters") > 1), "combo", "left_semi")
    if collapsed is not None:
        folded = collapsed.select("combo").distinct()
        sizes = sizes.join(folded, "combo", "left_anti")
        files = files.join(folded, "combo", "left_anti")
    nothing = F.lit(None)
    return (
        headers.select(
            F.lit("group").alias("row_type"), "combo", nothing.cast("int").alias("width"),
            nothing.cast("int").alias("height"), nothing.cast("bigint").alias("import_idx"),
            nothing.cast("string").alias("image_id"), "files",
        )
        .unionByName(
            sizes.select(
                F.lit("size").alias("row_type"), "combo", "width", "height",
                nothing.cast("bigint").alias("import_idx"), nothing.cast("string").alias("image_id"), "files",
            )
        )
        .unionByName(
            files.select(
                F.lit("file").alias("row_type"), "combo", "width", "height", "import_idx", "image_id",
                F.lit(1).cast("bigint").alias("files"),
            )
        )
    )


# NULLs sort first, so each header stands above the rows it heads.
OUTLINE_ORDER = [*LIBRARY_ORDER, "width", "height", "import_idx"]


def sort_outline(outline: DataFrame) -> DataFrame:
    return outline.orderBy(*library_order(), "width", "height", "import_idx")


def display_order(images: DataFrame) -> DataFrame:
    """images plus the columns that order them as the grouped library shows them (DISPLAY_ORDER)."""
    return images.select("*", *library_order())


DISPLAY_ORDER = [*LIBRARY_ORDER, "width", "height", "import_idx"]


def review_queue(view: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Each file of a view with the files before and after it, its 1-based position and the total.

    The order must end in a unique column; by default it is the one the grouped library is drawn in.
    """
    if order is None:
        view, order = display_order(view), DISPLAY_ORDER
    sliced = range_slices(view.select("image_id", *order), order)
    inside = Window.partitionBy(SLICE).orderBy(*order)
    place = F.struct(*order)
    ends = slice_summary(
        sliced, F.count("*").alias("_n"),
        F.min_by("import_idx", place).alias("_head"), F.max_by("import_idx", place).alias("_tail"),
    )
    walk = across_slices()
    before = walk.rowsBetween(Window.unboundedPreceding, -1)
    everything = walk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        SLICE,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.lag("_tail").over(walk).alias("_before"),
        F.lead("_head").over(walk).alias("_after"),
        F.sum("_n").over(everything).alias("total"),
    )
    local = sliced.select(
        "image_id", "import_idx", SLICE,
        F.row_number().over(inside).alias("_local"),
        F.lag("import_idx").over(inside).alias("_previous"),
        F.lead("import_idx").over(inside).alias("_next"),
    )
    return local.join(F.broadcast(ends), SLICE).select(
        "image_id", "import_idx",
        F.coalesce("_previous", "_before").alias("previous"),
        F.coalesce("_next", "_after").alias("next"),
        (F.col("_offset") + F.col("_local")).alias("position"),
        "total",
    )


def write_queue(view: DataFrame, path: str) -> PagedTable:
    """A view stored in the order the grouped library is drawn in: its pages and the neighbours of a file are read without sorting again."""
    return PagedTable.write(display_order(view), DISPLAY_ORDER, path)


def queue_page(queue: PagedTable, page: int, size: int) -> DataFrame:
    """One page of a stored queue: each file with its 1-based position and the total."""
    return queue.page(page, size).withColumn("position", F.col("position") + 1).withColumn("total", F.lit(queue.total).cast("long"))


def queue_neighbours(queue: DataFrame, outside: DataFrame) -> DataFrame:
    """For files outside a queue, where to step to from them; their own position is NULL.

    `previous` is the last queue entry with a lower import index, `next` the first with a higher one, last
    and first being meant in queue order. Both are running extremes along the import index: a prefix
    maximum of (position, file) and a suffix minimum, carried across slices by one row per slice.
    """
    entry = F.struct("position", F.col("import_idx").alias("file"))
    nothing = F.lit(None).cast("struct<position:bigint,file:bigint>")
    both = queue.select("image_id", "import_idx", entry.alias("entry")).unionByName(
        outside.join(queue, "image_id", "left_anti").select("image_id", "import_idx", nothing.alias("entry"))
    )
    sliced = range_slices(both, ["import_idx", "image_id"])
    inside = Window.partitionBy(SLICE).orderBy("import_idx", "image_id")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Extremes of what follows, as what precedes in reverse: Spark would go through the rest of a slice again for every row.
    reverse = Window.partitionBy(SLICE).orderBy(F.desc("import_idx"), F.desc("image_id"))
    onward = reverse.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walk = across_slices()
    carried = slice_summary(
        sliced, F.max("entry").alias("_max"), F.min("entry").alias("_min"), F.count("entry").alias("_n")
    ).select(
        SLICE,
        F.max("_max").over(walk.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.min("_min").over(walk.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
        F.sum("_n").over(
            walk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ).alias("total"),
    )
    local = sliced.select(
        "image_id", "import_idx", SLICE, "entry",
        F.max("entry").over(upto).alias("_up"), F.min("entry").over(onward).alias("_down"),
    ).filter(F.col("entry").isNull())
    return local.join(F.broadcast(carried), SLICE).select(
        "image_id", "import_idx",
        F.greatest("_up", "_earlier")["file"].alias("previous"),
        F.least("_down", "_later")["file"].alias("next"),
        F.lit(None).cast("bigint").alias("position"),
        "total",
    )


def classify_assignment(combo: str) -> Column:
    """What setting one combo on an image would do to it."""
    now = F.coalesce("combo", F.lit(""))
    return F.when(now == combo, "unchanged").when(now == "", "assigned").otherwise("overwritten")


def check_combo(combo: str) -> str:
    """A combo is digits or, to clear it, nothing."""
    value = combo.strip()
    if value and not (value.isascii() and value.isdigit()):
        raise ValueError("Use a numeric combo ID, e.g. 16.")
    return value


def plan_combo_assignment(images: DataFrame, combo: str) -> DataFrame:
    """One row pricing the assignment: counts per outcome and the first four IDs it would replace."""
    value = check_combo(combo)
    per_combo = (
        images.groupBy(F.coalesce("combo", F.lit("")).alias("combo"), classify_assignment(value).alias("outcome"))
        .agg(F.count("*").alias("files"), F.min("import_idx").alias("first"))
    )
    replaced = F.col("outcome") == "overwritten"
    shown = per_combo.filter(replaced).orderBy("first").limit(4).select(
        F.lit(None).cast("string").alias("outcome"), F.lit(0).cast("bigint").alias("files"),
        F.struct("first", "combo").alias("shown"),
    )
    priced = per_combo.select(
        "outcome", "files", F.lit(None).cast("struct<first:bigint,combo:string>").alias("shown")
    ).unionByName(shown)
    outcomes = [
        F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("files"))), F.lit(0)).alias(o)
        for o in ("unchanged", "assigned", "overwritten")
    ]
    ids = F.transform(F.array_sort(F.collect_list("shown")), lambda s: s["combo"])
    return priced.agg(
        *outcomes, F.count_if(replaced).alias("replaced_id_count"), F.array_join(ids, ", ").alias("replaced_ids")
    ).select(
        F.lit(value).alias("combo"),
        (F.col("assigned") + F.col("overwritten")).alias("changed"),
        "unchanged", "assigned", "overwritten", "replaced_id_count", "replaced_ids",
    )


def describe_assignment(plan: DataFrame) -> DataFrame:
    """The plan as the text that asks for confirmation."""

    def files(c: str) -> Column:
        return F.concat(F.col(c).cast("string"), F.when(F.col(c) == 1, " file").otherwise(" files"))

    head = F.when(
        F.col("combo") != "", F.concat(F.lit("Set "), files("changed"), F.lit(" to combo "), "combo", F.lit("?"))
    ).otherwise(F.concat(F.lit("Clear the combo ID on "), files("changed"), F.lit("?")))
    more = F.when(F.col("replaced_id_count") > 4, ", …").otherwise("")
    lines = F.array(
        head,
        F.when(
            F.col("overwritten") > 0,
            F.concat(
                files("overwritten"), F.lit(" already carry a different ID ("), "replaced_ids", more,
                F.lit(") and will be overwritten."),
            ),
        ),
        F.when(F.col("unchanged") > 0, F.concat(files("unchanged"), F.lit(" already match and stay as they are."))),
        F.lit("Combo IDs are not covered by undo."),
    )
    return plan.select(F.array_join(F.array_compact(lines), "\n").alias("text"))


def assign_combo(images: DataFrame, combo: str) -> DataFrame:
    return images.withColumn("combo", F.lit(check_combo(combo)))


def with_device(images: DataFrame) -> DataFrame:
    """images with the four device columns as they are compared: never NULL, never trimmed."""
    others = [c for c in images.columns if c not in DEVICE]
    return images.select(*others, *device_attributes())
