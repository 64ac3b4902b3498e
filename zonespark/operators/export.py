"""What is exported: groups by device or by combo, their rasters and zones, conflicts, and the documents."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonespark.export_schema import ExportSchema
from zonespark.functions.device import SEPARATOR, attribute, attributes_source, device_attributes
from zonespark.functions.text import json_quote
from zonespark.operators.triage import export_blockers
from zonespark.operators.zones import layout_facts, layout_union, zone_facts
from zonespark.plans.documents import Level, document, literal, members
from zonespark.plans.ordering import lookup, materialise
from zonespark.schemas import DEVICE, LAYOUT_KEY, RECT, ZONE

GROUP_BY = ["attributes", "combo"]
SIZE_KEY = ["group_key", "ref_width", "ref_height"]
CUSTOM_PREFIX = "custom:"

# The names the documents are downloaded under.
FILE_NAMES = {
    "v2": "annotations.json", "v1": "annotations-combo-v1.json", "custom": "annotations-custom.json",
}


@dataclass
class ExportTables:
    """One grouping pass every format renders from.

    rows: one per group, with group_key. sizes: one per group and raster. zones: the distinct zones of
    each, `first` ordering them as first seen.
    """

    rows: DataFrame
    sizes: DataFrame
    zones: DataFrame


def _key(kind: str, *parts: Column) -> Column:
    texts = [*parts, *[F.lit("")] * (4 - len(parts))]
    return F.struct(F.lit(kind).alias("kind"), *[t.alias(f"k{i}") for i, t in enumerate(texts)]).alias("group_key")


def _combo() -> Column:
    return F.coalesce("combo", F.lit(""))


def _image_key(group_by: str) -> Column:
    if group_by not in GROUP_BY:
        raise ValueError(f"group_by: choose one of {', '.join(GROUP_BY)}.")
    return _key("combo", _combo()) if group_by == "combo" else _key("attributes", *[attribute(c) for c in DEVICE])


def _combo_number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(float("inf")))


def resolve_combo_id(counted: DataFrame, keys: list[str]) -> DataFrame:
    """The label of each key: of (keys, combo, files, first) the commonest combo.

    Ties go to a label over none, then to the lowest number, then to the one seen first.
    """
    best = F.min(
        F.struct(-F.col("files"), F.col("combo") == "", _combo_number(F.col("combo")), "first", F.col("combo").alias("combo"))
    )
    return counted.groupBy(*keys).agg(best["combo"].alias("combo_id"))


def modal_attributes(counted: DataFrame, keys: list[str]) -> DataFrame:
    """The commonest attribute set of each key, the one seen first on a tie, and how many sets there are."""
    best = F.min(F.struct(-F.col("files"), F.col("first"), F.struct(*DEVICE).alias("attributes")))
    return counted.groupBy(*keys).agg(best["attributes"].alias("attributes"), F.count("*").alias("variants"))


def _image_parts(images: DataFrame, zones: DataFrame, group_by: str) -> DataFrame:
    """Annotated images counted per (group, raster, combo, attribute set): far fewer rows than images."""
    annotated = images.join(zones.select("image_id").distinct(), "image_id", "left_semi")
    return annotated.groupBy(
        _image_key(group_by), F.col("width").alias("ref_width"), F.col("height").alias("ref_height"),
        _combo().alias("combo"), *device_attributes(), attributes_source().alias("source"),
    ).agg(
        F.count("*").alias("files"),
        F.min(F.struct(F.lit(0).alias("origin"), F.col("import_idx"))).alias("first"),
    )


def _layout_parts(layouts: DataFrame, layout_zones: DataFrame) -> DataFrame:
    used = layouts.filter("promoted").join(layout_zones.select(*LAYOUT_KEY).distinct(), LAYOUT_KEY, "left_semi")
    return used.select(
        _key("imported", _combo()), "ref_width", "ref_height", _combo().alias("combo"),
        *[F.lit("").alias(c) for c in DEVICE], F.lit("imported").alias("source"),
        F.lit(1).cast("bigint").alias("files"),
        F.struct(F.lit(1).alias("origin"), F.col("layout_idx").alias("import_idx")).alias("first"),
    )


def export_tables(
    images: DataFrame,
    zones: DataFrame,
    layouts: DataFrame | None = None,
    layout_zones: DataFrame | None = None,
    group_by: str = "attributes",
) -> ExportTables:
    """Annotated images grouped by device attributes or combo, and promoted layouts per combo.

    A raster whose zones all clip away stays, with no zones. The two aggregates everything else follows from,
    images per part and distinct zones, are written once, so that no format scans the library again.
    """
    parts = _image_parts(images, zones, group_by)
    facts = zone_facts(images, zones, *DEVICE).select(
        _image_key(group_by), "ref_width", "ref_height", *ZONE, "first"
    )
    if layouts is not None:
        parts = parts.unionByName(_layout_parts(layouts, layout_zones))
        facts = facts.unionByName(
            layout_facts(layouts, layout_zones).select(
                _key("imported", _combo()), "ref_width", "ref_height", *ZONE, "first"
            )
        )
    parts = materialise(parts)
    distinct = materialise(facts.groupBy(*SIZE_KEY, *ZONE).agg(F.min("first").alias("first")))
    zone_counts = distinct.groupBy(*SIZE_KEY).agg(F.count("*").alias("zone_count"))
    sizes = (
        parts.groupBy(*SIZE_KEY).agg(F.sum("files").alias("file_count"))
        .join(zone_counts, SIZE_KEY, "left").fillna(0, ["zone_count"])
        .withColumn("size", F.concat_ws("x", "ref_width", "ref_height"))
    )

    def counted(*by: str) -> DataFrame:
        return parts.groupBy("group_key", *by).agg(F.sum("files").alias("files"), F.min("first").alias("first"))

    labels = resolve_combo_id(counted("combo"), ["group_key"])
    devices = modal_attributes(counted(*DEVICE), ["group_key"])
    totals = parts.groupBy("group_key").agg(
        F.sum("files").alias("file_count"), F.min("first").alias("first"),
        F.min("source").alias("_source"), F.max("source").alias("_other"),
    )
    zone_totals = sizes.groupBy("group_key").agg(F.sum("zone_count").alias("zone_count"))
    mixed = (F.col("_source") != F.col("_other")) | (F.col("variants") > 1)
    rows = (
        totals.join(labels, "group_key").join(devices, "group_key").join(zone_totals, "group_key")
        .select(
            "group_key", "combo_id", F.col("attributes.manufacturer").alias("manufacturer"),
            F.col("attributes.model").alias("model"), F.col("attributes.sop_class").alias("sop_class"),
            F.col("attributes.software").alias("software_version"),
            F.when(mixed, "mixed").otherwise(F.col("_source")).alias("attributes_source"),
            "file_count", "zone_count", "first",
        )
    )
    return ExportTables(rows, sizes, distinct)


ROW_FIELDS = [
    "combo_id", "manufacturer", "model", "sop_class", "software_version", "attributes_source",
    "file_count", "zone_count",
]


def row_order(locale: bool = False) -> list[Column]:
    """Combo number with unlabelled last, then the attributes, then the order groups were first seen in.

    locale=True compares the attributes as people sort them (a A b B) rather than by code point.
    """
    texts = [F.col(c) for c in ("manufacturer", "model", "sop_class", "software_version")]
    if locale:
        texts = [F.collate(t, "UNICODE") for t in texts]
    return [_combo_number(F.nullif(F.col("combo_id"), F.lit(""))), *texts, F.col("first"), F.col("group_key")]


def sort_export_rows(rows: DataFrame, locale: bool = False) -> DataFrame:
    return rows.orderBy(*row_order(locale))


def sort_export_sizes(sizes: DataFrame) -> DataFrame:
    """Within a group rasters go by the text of their key: 1024x768 stands before 640x480."""
    return sizes.orderBy("group_key", "size")


# --- Conflicts ---------------------------------------------------------------------------------------


def combo_conflicts(images: DataFrame, zones: DataFrame) -> DataFrame:
    """Combos whose annotated files disagree on the device: one row per attribute set.

    A file without any attribute counts as one set. first_file is the earliest file of the set; shown_files
    are the first three.
    """
    annotated = images.filter(_combo() != "").join(zones.select("image_id").distinct(), "image_id", "left_semi")
    facts = annotated.select("combo", *device_attributes(), "name", "import_idx")
    keys = ["combo", *DEVICE]
    sets = facts.groupBy(*keys).agg(F.count("*").alias("files"))
    variants = sets.groupBy("combo").agg(F.count("*").alias("variants")).filter(F.col("variants") > 1)
    # Rank 3 and lower is cut in every task before the shuffle, so a hot set sends a handful of rows.
    early = F.row_number().over(Window.partitionBy(*keys).orderBy("import_idx", "name"))
    shown = (
        facts.withColumn("_n", early).filter(F.col("_n") <= 3).groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_n", "name"))).alias("_shown"))
    )
    return (
        sets.join(variants, "combo").join(shown, keys)
        .select(
            *keys, "variants", "files", F.col("_shown")[0]["name"].alias("first_file"),
            F.array_join(F.transform("_shown", lambda s: s["name"]), ", ").alias("shown_files"),
        )
    )


def sort_conflicts(conflicts: DataFrame) -> DataFrame:
    return conflicts.orderBy(
        F.col("combo").try_cast("double"), "combo", F.col("files").desc(), "first_file", *DEVICE
    )


def conflict_report(conflicts: DataFrame) -> DataFrame:
    """The conflicts as lines of text: a heading per combo (line 0) and a line per attribute set (line 1).

    Sort by combo number, line, files descending and first_file to read it.
    """
    label = F.concat_ws(SEPARATOR, *[F.nullif(F.col(c), F.lit("")) for c in DEVICE])
    more = F.when(
        F.col("files") > 3, F.concat(F.lit(", and "), (F.col("files") - 3).cast("string"), F.lit(" more"))
    ).otherwise("")
    text = F.concat(
        F.lit("  "), F.when(label == "", "no device tags").otherwise(label), F.lit(" — "),
        F.col("files").cast("string"), F.when(F.col("files") == 1, " file: ").otherwise(" files: "),
        F.col("shown_files"), more,
    )
    lines = conflicts.select("combo", F.lit(1).alias("line"), "files", "first_file", text.alias("text"))
    heads = conflicts.groupBy("combo").agg(F.max("variants").alias("variants")).select(
        "combo", F.lit(0).alias("line"), F.lit(None).cast("bigint").alias("files"),
        F.lit(None).cast("string").alias("first_file"),
        F.concat(
            F.lit("Combo "), "combo", F.lit(" holds "), F.col("variants").cast("string"),
            F.lit(" different device combinations:"),
        ).alias("text"),
    )
    return heads.unionByName(lines)


# --- Documents ---------------------------------------------------------------------------------------


def _number(c: Column) -> Column:
    return c.cast("string")


def _object(indent: int, fields: dict[str, Column]) -> Column:
    pad = " " * indent
    return F.concat(F.lit(pad + "{\n"), members(indent + 2, fields), F.lit("\n" + pad + "}"))


def _zone_fields() -> dict[str, Column]:
    return {**{c: _number(F.col(c)) for c in RECT}, "note": json_quote(F.col("note"))}


def _opened(indent: int, lead: str | Column, fields: dict[str, Column], holder: str, bracket: str) -> Column:
    """The start of an object whose last member, `holder`, is a list or object still to be filled."""
    start = F.lit(" " * indent + lead + "{\n") if isinstance(lead, str) else F.concat(
        F.lit(" " * indent), lead, F.lit("{\n")
    )
    body = [members(indent + 2, fields), F.lit(",\n")] if fields else []
    return F.concat(start, *body, F.lit(" " * (indent + 2) + literal(holder) + ": " + bracket))


def _closed(indent: int, bracket: str) -> str:
    return " " * (indent + 2) + bracket + "\n" + " " * indent + "}"


def _size_text(indent: int, lead: str | Column, fields: dict[str, Column], holder: str) -> tuple[Column, Column]:
    """Opening and closing text of what holds a zone list; an empty list is closed at once."""
    empty = F.col("zone_count") == 0
    opened = _opened(indent, lead, fields, holder, "[")
    whole = F.concat(opened, F.lit("]\n" + " " * indent + "}"))
    return F.when(empty, whole).otherwise(opened), F.when(~empty, F.lit(_closed(indent, "]")))


def _head(fields: dict[str, str], holder: str, bracket: str) -> str:
    lines = [f"  {literal(k)}: {v},\n" for k, v in fields.items()]
    return "{\n" + "".join(lines) + f"  {literal(holder)}: {bracket}"


def export_v1(
    images: DataFrame,
    zones: DataFrame,
    generated_at: str,
    layouts: DataFrame | None = None,
    layout_zones: DataFrame | None = None,
    check: bool = True,
) -> DataFrame:
    """The document keyed by combo and raster. Every annotated image needs a digit combo."""
    if check:
        blocker = export_blockers(images, zones).agg(F.min_by("name", "import_idx").alias("name"), F.count("*").alias("n")).first()
        if blocker["n"]:
            raise ValueError(f"{blocker['name']} has zones but no digit combo to export them under.")
    union = materialise(layout_union(images, zones, layouts, layout_zones))
    # JavaScript lists keys that are plain integers first, in ascending order, then the rest as first seen.
    plain = F.col("combo").rlike(r"^(0|[1-9][0-9]{0,9})\z") & (F.col("combo").try_cast("bigint") < 2**32 - 1)
    combos = union.groupBy("combo").agg(F.min("first").alias("first")).select(
        "combo",
        F.struct(
            (~plain).alias("late"), F.when(plain, F.col("combo").try_cast("bigint")).alias("number"), "first"
        ).alias("order"),
        F.concat(F.lit("    "), json_quote(F.col("combo")), F.lit(": {")).alias("open"),
        F.lit("    }").alias("close"),
    )
    sizes = union.groupBy(*LAYOUT_KEY).agg(F.min("first").alias("order"), F.count("*").alias("zone_count"))
    lead = F.concat(F.lit('"'), F.concat_ws("x", "ref_width", "ref_height"), F.lit('": '))
    opened, closed = _size_text(
        6, lead, {c: _number(F.col(c)) for c in ("ref_width", "ref_height")}, "zones"
    )
    leaves = union.select(
        *LAYOUT_KEY, F.struct("first", *ZONE).alias("order"), _object(10, _zone_fields()).alias("open"),
        F.lit(None).cast("string").alias("close"),
    )
    return document(
        _head({"generated_at": literal(generated_at)}, "annotations", "{"),
        [
            Level(combos, ["combo"]),
            Level(sizes.select(*LAYOUT_KEY, "order", opened.alias("open"), closed.alias("close")), LAYOUT_KEY),
            Level(leaves, [*LAYOUT_KEY, *ZONE]),
        ],
        "  }\n}",
    )


def _entries(rows: DataFrame, opened: Column, closed: str, locale: bool) -> Level:
    order = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(row_order(locale))])
    return Level(
        rows.select("group_key", order.alias("order"), opened.alias("open"), F.lit(closed).alias("close")),
        ["group_key"],
    )


def _row_values() -> dict[str, Column]:
    counts = ("file_count", "zone_count")
    return {c: _number(F.col(c)) if c in counts else json_quote(F.col(c)) for c in ROW_FIELDS}


def _size_values() -> dict[str, Column]:
    return {
        "size": json_quote(F.col("size")),
        **{c: _number(F.col(c)) for c in ("ref_width", "ref_height", "zone_count", "file_count")},
    }


def _leaves(zones: DataFrame, indent: int, fields: dict[str, Column]) -> Level:
    return Level(
        zones.select(
            *SIZE_KEY, F.struct("first", *ZONE).alias("order"), _object(indent, fields).alias("open"),
            F.lit(None).cast("string").alias("close"),
        ),
        [*SIZE_KEY, "order"],
    )


def _size_lead() -> Column:
    return F.concat(json_quote(F.col("size")), F.lit(": "))


def _size_level(sizes: DataFrame, texts: tuple[Column, Column]) -> Level:
    return Level(
        sizes.select(
            *SIZE_KEY, F.struct("size").alias("order"), texts[0].alias("open"), texts[1].alias("close")
        ),
        SIZE_KEY,
    )


def export_v2(tables: ExportTables, generated_at: str, locale: bool = False) -> DataFrame:
    """The document with an entry per device, from tables grouped by attributes."""
    fields = {k: v for k, v in _row_values().items() if k not in ("file_count", "zone_count")}
    size_fields = {c: _number(F.col(c)) for c in ("ref_width", "ref_height")}
    return document(
        _head({"schema_version": "2", "generated_at": literal(generated_at)}, "annotations", "["),
        [
            _entries(tables.rows, _opened(4, "", fields, "sizes", "{"), _closed(4, "}"), locale),
            _size_level(tables.sizes, _size_text(8, _size_lead(), size_fields, "zones")),
            _leaves(tables.zones, 12, _zone_fields()),
        ],
        "  ]\n}",
    )


def _projected(mapping: dict[str, str], constants: dict, values: dict[str, Column], holder: str = "") -> dict[str, Column]:
    """Mapped fields with constants over them; the holder of the next level is written separately.

    Keys that are plain integers come first in ascending order, as in any JavaScript object.
    """
    fields = {key: values[source] for key, source in mapping.items()}
    fields.update({key: F.lit(literal(value)) for key, value in constants.items()})
    fields.pop(holder, None)
    index = {k: int(k) for k in fields if k.isascii() and k.isdigit() and str(int(k)) == k}
    return {k: fields[k] for k in sorted(fields, key=lambda k: (0, index[k]) if k in index else (1, 0))}


def export_custom(schema: ExportSchema, tables: ExportTables, generated_at: str, locale: bool = False) -> DataFrame:
    """A user's schema: fields renamed, constants added, coordinates as they are.

    A flat schema has an entry per group and raster, whose counts are that raster's; a nested one keeps
    the rasters in an object of their own.
    """
    root = {k: literal(v) for k, v in schema.root.items()}
    if schema.timestamp_field:
        root[schema.timestamp_field] = literal(generated_at)
    head, tail = _head(root, schema.entries_field, "["), "  ]\n}"
    zone_fields = _projected(schema.zone, schema.zone_constants, _zone_fields())
    if schema.shape == "flat":
        facts = tables.rows.drop("file_count", "zone_count")
        joined = lookup(tables.sizes, facts, ["group_key"], ["ref_width", "ref_height"])
        values = {**_row_values(), **_size_values()}
        opened, closed = _size_text(
            4, "", _projected(schema.entry, schema.entry_constants, values, schema.zones_field), schema.zones_field
        )
        order = F.struct(*[c.alias(f"r{i}") for i, c in enumerate([*row_order(locale), F.col("size")])])
        entries = joined.select(*SIZE_KEY, order.alias("order"), opened.alias("open"), closed.alias("close"))
        return document(head, [Level(entries, SIZE_KEY), _leaves(tables.zones, 8, zone_fields)], tail)
    fields = _projected(schema.entry, schema.entry_constants, _row_values(), schema.sizes_field)
    size_fields = _projected(schema.size, {}, _size_values(), schema.zones_field)
    return document(
        head,
        [
            _entries(tables.rows, _opened(4, "", fields, schema.sizes_field, "{"), _closed(4, "}"), locale),
            _size_level(tables.sizes, _size_text(8, _size_lead(), size_fields, schema.zones_field)),
            _leaves(tables.zones, 12, zone_fields),
        ],
        tail,
    )


def export(
    format: str,
    images: DataFrame,
    zones: DataFrame,
    generated_at: str,
    layouts: DataFrame | None = None,
    layout_zones: DataFrame | None = None,
    schemas: list[ExportSchema] = (),
    locale: bool = False,
) -> tuple[DataFrame, str]:
    """(document, file name) in format v1, v2 or custom:<schema id>; an unknown format means v2."""
    if format == "v1":
        return export_v1(images, zones, generated_at, layouts, layout_zones), FILE_NAMES["v1"]
    if format.startswith(CUSTOM_PREFIX):
        schema = next((s for s in schemas if CUSTOM_PREFIX + s.id == format), None)
        if schema is None:
            raise ValueError("No schema given has the id this format names.")
        tables = export_tables(images, zones, layouts, layout_zones, schema.group_by)
        return export_custom(schema, tables, generated_at, locale), FILE_NAMES["custom"]
    tables = export_tables(images, zones, layouts, layout_zones)
    return export_v2(tables, generated_at, locale), FILE_NAMES["v2"]
