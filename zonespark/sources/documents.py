"""Writing documents and exchange files.

Recognised text must not leave the detection tables: every writer refuses a table that has it.
"""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonespark.export_schema import ExportSchema
from zonespark.functions.text import json_quote
from zonespark.operators import export as X
from zonespark.operators.templates import template_order
from zonespark.plans.documents import Level, document, literal, members, write_document
from zonespark.plans.ordering import join_large, materialise, sorted_parts
from zonespark.schemas import DEVICE, FRAME, RECOGNISED, RECT, ZONE

PRODUCT = "zonespark"


def refuse_text(*tables: DataFrame | None) -> None:
    """Stop a table with recognised text from being written, under whatever name the text goes.

    Columns of recognised text carry a mark in their metadata, which renaming and joins keep; one called text is refused
    in any case.
    """
    for table in tables:
        for column in table.schema if table is not None else ():
            if column.metadata.get(RECOGNISED) or column.name.lower() == "text":
                raise ValueError(f"The column {column.name} holds recognised text and cannot be exported.")


def write_export(
    path: str, format: str, images: DataFrame, zones: DataFrame, generated_at: str,
    layouts: DataFrame | None = None, layout_zones: DataFrame | None = None,
    schemas: list[ExportSchema] = (), locale: bool = False,
) -> str:
    """Write an export below `path`, in a folder named like the document; the folder's name is returned."""
    refuse_text(images, zones, layouts, layout_zones)
    fragments, name = X.export(format, images, zones, generated_at, layouts, layout_zones, schemas, locale)
    write_document(fragments, f"{path}/{name}")
    return f"{path}/{name}"


def write_export_tables(path: str, tables: X.ExportTables, format: str = "parquet") -> None:
    """The same groups as three tables, for corpora read by machines: rows, sizes and zones."""
    refuse_text(tables.rows, tables.sizes, tables.zones)
    for name in ("rows", "sizes", "zones"):
        getattr(tables, name).write.mode("errorifexists").format(format).save(f"{path}/{name}")


def _zone_text(indent: int):
    fields = {**{c: F.col(c).cast("string") for c in RECT}, "note": json_quote(F.coalesce("note", F.lit("")))}
    pad = " " * indent
    return F.concat(F.lit(pad + "{\n"), members(indent + 2, fields), F.lit("\n" + pad + "}"))


def _zone_leaves(zones: DataFrame, keys: list[str], indent: int) -> Level:
    return Level(
        zones.select(
            *keys, F.struct("ord", *ZONE).alias("order"), _zone_text(indent).alias("open"),
            F.lit(None).cast("string").alias("close"),
        ),
        [*keys, "order"], few_parents=False,
    )


def _image_head(images: DataFrame, at: str = ""):
    """The text of an image up to its frames, from columns of that name or the fields of a struct `at`."""

    def column(name: str):
        return F.col(f"{at}{name}")

    def optional(name: str):
        return F.coalesce(column(name).cast("string"), F.lit("null"))

    def string(name: str):
        return json_quote(F.coalesce(column(name), F.lit("")))

    metadata = {
        **{"sopClass" if c == "sop_class" else c: string(c) for c in DEVICE if c in images.columns},
        **{k: string(c) for k, c in (("modality", "modality"), ("photometric", "photometric"),
                                     ("transferSyntax", "transfer_syntax")) if c in images.columns},
    }
    head = {
        "id": string("image_id"), "name": string("name"), "path": string("path"), "combo": string("combo"),
        **{k: column(c).cast("string") for k, c in (("width", "width"), ("height", "height"))},
        **{k: optional(c) for k, c in (("filenameWidth", "filename_width"), ("filenameHeight", "filename_height"))
           if c in images.columns},
        **({"sample": string("sample")} if "sample" in images.columns else {}),
        "kind": string("kind"), "frameCount": column("frame_count").cast("string"),
        "frameIndex": column("open_frame").cast("string"),
        "metadata": F.concat(F.lit("{\n"), members(8, metadata), F.lit("\n      }")),
    }
    return F.concat(F.lit("    {\n"), members(6, head), F.lit(',\n      "frames": {'))


_EMPTY_IMAGE, _IMAGE_END, _FRAME_END, _DOCUMENT_END = "}\n    }", "      }\n    }", "        ]", "  ]\n}"


def _frame_start():
    return F.concat(F.lit('        "'), F.col("frame_index").cast("string"), F.lit('": ['))


def _backup_start(generated_at: str, format: str) -> str:
    return (
        "{\n" + f'  "format": {literal(format)},\n  "version": 1,\n  "generated_at": {literal(generated_at)},\n'
        + '  "images": ['
    )


def backup_document(images: DataFrame, zones: DataFrame, generated_at: str, format: str = f"{PRODUCT}-project") -> DataFrame:
    """Images with their zones by frame, as an annotation backup."""
    refuse_text(zones)
    frames = zones.select(*FRAME).distinct()
    used = frames.select("image_id").distinct().withColumn("_used", F.lit(True))
    opened = _image_head(images)
    empty = F.col("_used").isNull()
    entries = images.join(used, "image_id", "left").select(
        "image_id", F.struct("import_idx", "image_id").alias("order"),
        F.when(empty, F.concat(opened, F.lit(_EMPTY_IMAGE))).otherwise(opened).alias("open"),
        F.when(~empty, _IMAGE_END).alias("close"),
    )
    lists = frames.select(
        *FRAME, F.struct("frame_index").alias("order"), _frame_start().alias("open"), F.lit(_FRAME_END).alias("close"),
    )
    levels = [Level(entries, ["image_id"]), Level(lists, FRAME, False), _zone_leaves(zones, FRAME, 10)]
    return document(_backup_start(generated_at, format), levels, _DOCUMENT_END)


def _placed_zones(images: DataFrame, zones: DataFrame) -> DataFrame:
    """The zones of images with the number of their image and what begins and ends at each. An image has its zones in one task, as it has to fit a value
    where it is read."""
    placed = join_large(zones.select(*FRAME, "ord", *ZONE), images.select("image_id", "import_idx"), ["image_id"])
    along = Window.partitionBy("import_idx", "image_id").orderBy("frame_index", "ord", *ZONE)
    own = F.struct("frame_index")
    rows = placed.withColumn("_before", F.lag(own).over(along)).withColumn("_after", F.lead(own).over(along))

    def other(beside: str):
        return F.col(beside).isNull() | ~F.col(f"{beside}.frame_index").eqNullSafe(F.col("frame_index"))

    told = rows.select(
        "import_idx", *FRAME, "ord", *ZONE, other("_before").alias("begins"), other("_after").alias("ends"), F.col("_after").isNull().alias("ends_image"),
    )
    # A frame without a number has no zones in a document.
    return told.filter(F.col("frame_index").isNotNull() | F.col("begins") | F.col("ends"))


def _backup_lines(images: DataFrame, zones: DataFrame, generated_at: str, format: str) -> DataFrame:
    """The lines of backup_document in order. What is sorted are the rows, which are made into text where they end up."""
    leaves = materialise(_placed_zones(images, zones))
    used = leaves.filter("ends_image").select("image_id").distinct().withColumn("used", F.lit(True))
    entries = join_large(images, used, ["image_id"], "left")
    last = images.select("import_idx", "image_id").orderBy(F.desc("import_idx"), F.desc("image_id")).first()
    spark = images.sparkSession
    rows = (
        leaves.withColumns({"phase": F.lit(1), "leaf": F.lit(True)})
        .unionByName(
            entries.select(F.lit(1).alias("phase"), F.lit(False).alias("leaf"), "import_idx", "image_id", "used", F.struct(*images.columns).alias("image")),
            allowMissingColumns=True,
        )
        .unionByName(spark.range(1).select(F.lit(0).alias("phase")), allowMissingColumns=True)
        .unionByName(spark.range(1).select(F.lit(2).alias("phase")), allowMissingColumns=True)
    )
    ordered = sorted_parts(rows, "phase", "import_idx", "image_id", "leaf", "frame_index", "ord", *ZONE)

    end = F.when(F.col("image_id") == F.lit(last and last["image_id"]), "").otherwise(",")
    head = F.when(F.col("used"), F.col("head")).otherwise(F.concat("head", F.lit(_EMPTY_IMAGE), end))
    zone = F.concat(_zone_text(10), F.when(F.col("ends"), "").otherwise(","))
    leaf = F.concat_ws(
        "\n", F.when(F.col("begins"), F.coalesce(_frame_start(), F.lit(""))),
        F.when(F.col("frame_index").isNotNull(), F.coalesce(zone, F.lit(""))),
        F.when(F.col("ends"), F.concat(F.lit(_FRAME_END), F.when(F.col("ends_image"), "").otherwise(","))),
        F.when(F.col("ends_image"), F.concat(F.lit(_IMAGE_END), end)),
    )
    line = (
        F.when(F.col("phase") == 0, _backup_start(generated_at, format)).when(F.col("phase") == 2, _DOCUMENT_END)
        .when(F.col("leaf"), leaf).otherwise(head)
    )
    return ordered.withColumn("head", _image_head(images, "image.")).select(line.alias("line"))


def _listed_zones(zones: DataFrame, keys: list[str]) -> DataFrame:
    """The zones of each key as one array in their order. A key is a frame or a template, never a whole library."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", *[F.coalesce(c, F.lit("")).alias(c) if c == "note" else c for c in ZONE])))
    return zones.groupBy(*keys).agg(F.transform(ordered, lambda z: F.struct(*[z[c].alias(c) for c in ZONE])).alias("zones"))


def _records(kind: str, items: str, entry, generated_at: str, format: str | None):
    """A document with a single entry, as one line of JSON."""
    head = (F.lit(format or f"{PRODUCT}-{kind}").alias("format"), F.lit(1).alias("version"), F.lit(generated_at).alias("generated_at"))
    return F.to_json(F.struct(*head, F.array(entry).alias(items))).alias("value")


def _backup_entries(images: DataFrame, zones: DataFrame) -> DataFrame:
    """import_idx, image_id and the entry of each image in a backup. Zones are exchanged once, by their image."""
    refuse_text(images, zones)
    lists = _listed_zones(zones.repartition("image_id"), FRAME).groupBy("image_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("frame_index").cast("string"), "zones"))).alias("frames")
    )
    have = images.columns
    names = {"id": "image_id", "filenameWidth": "filename_width", "filenameHeight": "filename_height", "frameCount": "frame_count",
             "frameIndex": "open_frame", **{c: c for c in ("name", "path", "combo", "width", "height", "sample", "kind")}}
    metadata = {"sopClass": "sop_class", "transferSyntax": "transfer_syntax", "bits": "bits",
                **{c: c for c in (*DEVICE, "modality", "photometric") if c != "sop_class"}}
    display = {"windowWidth": "window_width", "windowCenter": "window_center", "invert": "invert"}

    def part(fields: dict[str, str]) -> list:
        return [F.col(c).alias(k) for k, c in fields.items() if c in have]

    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(lists.schema["frames"].dataType.valueType.simpleString().join(["array<", ">"])))
    entry = F.struct(
        *part(names), F.struct(*part(metadata)).alias("metadata"), *([F.struct(*part(display)).alias("display")] if part(display) else []),
        F.coalesce("frames", empty).alias("frames"),
    )
    return join_large(images, lists, ["image_id"], "left").select("import_idx", "image_id", entry.alias("entry"))


def backup_records(images: DataFrame, zones: DataFrame, generated_at: str, format: str | None = None) -> DataFrame:
    """A backup as records: every row is an annotation backup of one image, so any number of files is still a backup."""
    record = _records("project", "images", F.col("entry"), generated_at, format)
    return _backup_entries(images, zones).select("import_idx", "image_id", record)


def write_backup(path: str, images: DataFrame, zones: DataFrame, generated_at: str, compression: str | None = None) -> None:
    """Write a backup as records, sorted as the library is. With the compression `gzip` each part is a gzip file, which reads back as it is."""
    # A sort goes through its input twice, once for the ranges: records are made into text after it.
    ordered = sorted_parts(_backup_entries(images, zones), "import_idx", "image_id")
    record = _records("project", "images", F.col("entry"), generated_at, None)
    ordered.select(record).write.mode("errorifexists").text(path, compression=compression)


def write_backup_document(path: str, images: DataFrame, zones: DataFrame, generated_at: str, compression: str | None = None) -> None:
    """Write a backup as the single document other tools read; the part files put one after the other are it.

    With the compression `gzip` they are gzip files, which put one after the other are a gzip file of the document.
    """
    refuse_text(zones)
    lines = _backup_lines(images, zones, generated_at, f"{PRODUCT}-project")
    lines.write.mode("errorifexists").text(path, compression=compression)


def templates_document(
    templates: DataFrame, template_zones: DataFrame, generated_at: str, format: str = f"{PRODUCT}-templates"
) -> DataFrame:
    """Templates in their listing order, each with its zones."""
    refuse_text(template_zones)
    fields = {
        "id": json_quote(F.col("template_id")), "name": json_quote(F.col("name")), "combo": json_quote(F.col("combo")),
        "width": F.col("width").cast("string"), "height": F.col("height").cast("string"),
        "createdAt": json_quote(F.col("created_at")),
    }
    order = F.struct(*[c.alias(f"t{i}") for i, c in enumerate([*template_order(), F.col("template_id")])])
    entries = templates.select(
        "template_id", order.alias("order"),
        F.concat(F.lit("    {\n"), members(6, fields), F.lit(',\n      "zones": [')).alias("open"),
        F.lit("      ]\n    }").alias("close"),
    )
    start = (
        "{\n" + f'  "format": {literal(format)},\n  "version": 1,\n  "generated_at": {literal(generated_at)},\n'
        + '  "templates": ['
    )
    levels = [Level(entries, ["template_id"]), _zone_leaves(template_zones, ["template_id"], 8)]
    return document(start, levels, "  ]\n}")


def template_records(templates: DataFrame, template_zones: DataFrame, generated_at: str, format: str | None = None) -> DataFrame:
    """Templates as records: every row is a template file of one template."""
    refuse_text(templates, template_zones)
    lists = _listed_zones(template_zones, ["template_id"])
    entry = F.struct(F.col("template_id").alias("id"), "name", "combo", "width", "height", "zones", F.col("created_at").alias("createdAt"))
    record = _records("templates", "templates", entry, generated_at, format)
    return templates.join(lists, "template_id", "left").select(*templates.columns, record)


def write_templates(path: str, templates: DataFrame, template_zones: DataFrame, generated_at: str) -> None:
    """Write templates as records in their listing order."""
    rows = template_records(templates, template_zones, generated_at)
    rows.orderBy(*template_order(), "template_id").select("value").write.mode("errorifexists").text(path)


def write_templates_document(path: str, templates: DataFrame, template_zones: DataFrame, generated_at: str) -> None:
    """Write templates as the single document other tools read."""
    write_document(templates_document(templates, template_zones, generated_at), path)


def write_export_schemas(spark: SparkSession, path: str, schemas: list[ExportSchema], generated_at: str) -> None:
    """Export schemas as one small exchange file in a folder, on whatever storage Spark writes to."""
    body = {
        "format": f"{PRODUCT}-schema", "version": 1, "generated_at": generated_at,
        "schemas": [schema.as_dict() for schema in schemas],
    }
    text = json.dumps(body, ensure_ascii=False, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
