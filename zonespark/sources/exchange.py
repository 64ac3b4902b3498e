"""Reading exchange files: layouts, annotation backups, templates and export schemas.

A file with any defect is refused as a whole, with the reason; rectangles that do not fit are never
repaired. Readers return what the good files hold and a table of rejects. `files` tables have path and text.
A file is parsed once: what is read from it is written before it is judged, and so are the rejects.
"""

import json
from collections.abc import Callable, Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonespark.export_schema import ExportSchema, validate_schema_file
from zonespark.functions import variants as V
from zonespark.functions.definitions import definition_columns, definition_defects
from zonespark.functions.geometry import inside
from zonespark.functions.text import is_digits, js_trim
from zonespark.operators.templates import derived_id, template_name
from zonespark.plans.ordering import join_large, materialise, with_global_rank, without_few
from zonespark.schemas import DEVICE, LAYOUT_KEY, ZONE
from zonespark.sources import json_scan as J
from zonespark.sources.ranged import MANIFEST, document_parts, path_exists, reachable


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows (path, text)."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


class Read:
    """What the readers start from: texts that are whole documents (path, text), and documents that were cut while they were read.

    Of the latter, skeletons has path and text, elements path, container, at and text (see json_scan). `unique` says that no two texts have
    the same path.
    """

    def __init__(self, texts: DataFrame, skeletons: DataFrame | None = None, elements: DataFrame | None = None, unique: bool = False):
        self.texts, self.unique = texts, unique
        self.skeletons = None if skeletons is None else skeletons.withColumnRenamed("document", "path")
        self.elements = None if elements is None else elements.withColumnRenamed("document", "path")


def read_documents(spark: SparkSession, path: str, one_document: bool = False) -> Read:
    """The documents of a file or folder. A folder may hold files of one document each and files written as records.

    Records are lines that are documents of their own; whether a file has them shows in its first line that is not blank, and they are
    named so that they sort as they stand. Other files are documents, cut into parts while they are read. With `one_document`
    the files of the folder, in the order of its manifest or else of their names, are the parts of a single document. Every file is read in parts,
    whatever its length. Where Python cannot open the store, Spark reads files that are documents whole.
    """
    if not reachable(path):
        return Read(documents_in(spark, path))
    if one_document and path_exists(f"{path}/{MANIFEST}"):
        listed = [(path, part, at, size) for part, at, size in document_parts(path)]
        nothing = spark.createDataFrame([], "path string, text string")
        return Read(nothing, *J.documents(spark.createDataFrame(listed, "document string, path string, base long, length long")))
    files = J.listed(spark, path)
    if one_document:
        # As many rows as the document has parts.
        before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
        base = F.coalesce(F.sum(J.room(F.col("path"), F.col("length"))).over(before), F.lit(0))
        parts = files.select(F.lit(path).alias("document"), "path", base.alias("base"), "length")
        nothing = spark.createDataFrame([], "path string, text string")
        return Read(nothing, *J.documents(materialise(parts)))
    kinds = J.with_kinds(files)
    whole = kinds.filter(~F.col("records"))
    if not kinds.filter("records").isEmpty():
        # A file of nothing but blanks is no record, and beside records no document either.
        whole = whole.filter(~F.col("blank"))
    whole = whole.select(F.col("path").alias("document"), "path", F.lit(0).cast("long").alias("base"), "length")
    return Read(J.records(kinds.filter("records")), *J.documents(whole), unique=True)


def documents_in(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a file or folder as rows (path, text), by Spark's text source: lines of files with records, and other files whole."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), place.alias("place"), "value")
    filled = lines.filter(F.trim("value") != "")
    # Only the part of a file that begins it can hold its first line.
    first = filled.filter("place.block = 0").groupBy("path").agg(F.min_by("value", "place").alias("value"))
    kinds = materialise(first.select("path", F.coalesce(V.is_one_value(F.col("value")), F.lit(False)).alias("records")))
    if kinds.filter("records").isEmpty():
        return text_files(spark, path)
    # The kinds have a row per file; the files themselves are never listed here.
    records = filled.join(kinds.filter("records"), "path", "left_semi").select(
        F.concat_ws("#", "path", *[F.lpad(F.col(f"place.{c}").cast("string"), 20, "0") for c in ("block", "line")]).alias("path"),
        F.col("value").alias("text"),
    )
    return records.unionByName(text_files(spark, path).join(kinds.filter("NOT records"), "path", "left_semi"))


def _zone_columns(zone: Column) -> list[Column]:
    numbers = [V.integer(V.member(zone, c)).alias(c) for c in ZONE[:-1]]
    return [*numbers, V.text(V.member(zone, "note")).alias("note")]


def _whole_zone() -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ZONE])


def _defects(rows: DataFrame, reason: Column) -> DataFrame:
    return rows.select("path", reason.alias("reason")).filter(F.col("reason").isNotNull())


def _first_reason(parts: list[DataFrame]) -> DataFrame:
    """One reason per refused file: from the outermost level, and the first by text within it."""
    numbered = [part.withColumn("level", F.lit(i)) for i, part in enumerate(parts)]
    every = reduce(lambda a, b: a.unionByName(b), numbered)
    refused = every.groupBy("path").agg(F.min(F.struct("level", "reason"))["reason"].alias("reason"))
    return materialise(refused)


def _ints(*names: str) -> list[Column]:
    return [F.col(c).cast("int").alias(c) for c in names]


def _annotations(read: Read) -> tuple[DataFrame, DataFrame]:
    """(path and whether the file has annotations, path, pos, combo and raw of each of them)."""

    def annotations(text: Column) -> Column:
        whole = F.when(V.is_one_value(text), text)
        return F.from_json(whole, "struct<annotations: map<string, string>>")["annotations"]

    top = materialise(read.texts.select("path", annotations(F.col("text")).alias("annotations")))
    known = top.select("path", F.col("annotations").isNotNull().alias("known"))
    combos = top.select("path", F.posexplode("annotations").alias("pos", "combo", "raw")).withColumn("pos", F.col("pos").cast("long"))
    if read.skeletons is None:
        return known, combos
    # In a skeleton an object holds its number only, as a key and as its value.
    held = materialise(read.skeletons.select("path", annotations(F.col("text")).alias("held")))
    numbers = held.select("path", F.map_keys("held")[0].try_cast("long").alias("container"))
    member = F.concat(F.lit("{"), "text", F.lit("}"))
    parsed = read.elements.join(numbers.filter("container IS NOT NULL"), ["path", "container"]).select(
        "path", F.col("at").alias("pos"), F.from_json(F.when(V.is_one_value(member), member), "map<string, string>").alias("one")
    )
    parsed = materialise(parsed)
    broken = parsed.filter(F.col("one").isNull() | (F.size("one") != 1)).select("path").distinct().withColumn("_broken", F.lit(True))
    cut = held.join(broken, "path", "left").select("path", (F.col("held").isNotNull() & F.col("_broken").isNull()).alias("known"))
    members = parsed.join(broken, "path", "left_anti").select("path", "pos", F.explode("one").alias("combo", "raw"))
    return known.unionByName(cut), combos.unionByName(members)


def parse_layouts(files: DataFrame | Read) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(layouts, layout_zones, rejects) of files keyed by combo and raster. Nothing arrives promoted."""
    top, entries = _annotations(files if isinstance(files, Read) else Read(files))
    # A repeated key stands where it came first and means what it says last.
    combos = (
        entries
        .groupBy("path", "combo").agg(F.min("pos").alias("combo_pos"), F.max_by("raw", "pos").alias("raw"))
        .withColumn("sizes", F.from_json("raw", "map<string, variant>"))
    )
    combos = materialise(combos.drop("raw"))
    sizes = (
        combos.select("path", "combo", "combo_pos", F.posexplode("sizes").alias("pos", "size", "body"))
        .groupBy("path", "combo", "combo_pos", "size")
        .agg(F.min("pos").alias("size_pos"), F.max_by(F.to_json("body"), "pos").alias("body"))
        .withColumn("body", F.try_parse_json("body"))
    )
    key = r"^([0-9]+)x([0-9]+)\z"
    sizes = sizes.select(
        "*",
        F.regexp_extract("size", key, 1).try_cast("bigint").alias("ref_width"),
        F.regexp_extract("size", key, 2).try_cast("bigint").alias("ref_height"),
        V.elements(V.member(F.col("body"), "zones")).alias("list"),
    )
    sizes = materialise(sizes)
    agrees = V.integer(V.member(F.col("body"), "ref_width")).eqNullSafe(F.col("ref_width")) & V.integer(
        V.member(F.col("body"), "ref_height")
    ).eqNullSafe(F.col("ref_height"))
    zones = sizes.select(
        "path", "combo", "combo_pos", "size_pos", "ref_width", "ref_height",
        F.posexplode("list").alias("ord", "zone"),
    ).select("*", *_zone_columns(F.col("zone"))).drop("zone")
    outside = ~inside(F.col("ref_width"), F.col("ref_height"))
    some = zones.select("path").distinct().withColumn("_some", F.lit(True))
    rejects = _first_reason(
        [
            _defects(top, F.when(~F.col("known"), "Not an annotations file.")),
            _defects(
                combos,
                F.when(~is_digits(F.col("combo")), F.concat(F.lit("Invalid combo ID: "), "combo"))
                .when(F.col("sizes").isNull(), F.concat(F.lit("Invalid sizes in combo "), "combo")),
            ),
            _defects(
                sizes,
                F.when(F.col("ref_width").isNull() | F.col("ref_height").isNull(), F.concat(F.lit("Invalid size key: "), "size"))
                .when(~agrees, F.concat(F.lit("ref_width and ref_height disagree with "), "size"))
                .when(F.col("list").isNull(), F.concat(F.lit("Missing zones at "), "size")),
            ),
            _defects(
                zones,
                F.when(~_whole_zone(), F.concat(F.lit("Invalid rectangle in combo "), "combo"))
                .when(outside, F.concat(F.lit("A rectangle lies outside its raster in combo "), "combo")),
            ),
            _defects(
                top.join(some, "path", "left"),
                F.when(F.col("known") & F.col("_some").isNull(), "The file contains no zones."),
            ),
        ]
    )
    good = zones.join(rejects, "path", "left_anti")
    # Combos that are plain integers come first in ascending order, as in any JavaScript object.
    plain = F.col("combo").rlike(r"^(0|[1-9][0-9]{0,9})\z") & (F.col("combo").try_cast("bigint") < 2**32 - 1)
    found = good.select(
        "path", (~plain).alias("late"), F.when(plain, F.col("combo").try_cast("bigint")).alias("number"),
        "combo_pos", "size_pos", "combo", *_ints("ref_width", "ref_height"),
    ).distinct()
    ranked = with_global_rank(found, ["path", "late", "number", "combo_pos", "size_pos"], "layout_idx")
    layouts = ranked.select(
        *LAYOUT_KEY, F.lit(False).alias("promoted"), "layout_idx", F.col("path").alias("file")
    )
    layout_zones = good.select(
        "combo", *_ints("ref_width", "ref_height"), F.col("ord").cast("bigint").alias("ord"),
        *_ints("x", "y", "width", "height"), "note", F.col("path").alias("file"),
    )
    return layouts, layout_zones, rejects


def read_layouts(spark: SparkSession, path: str, one_document: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse_layouts(read_documents(spark, path, one_document))


def _envelope(read: Read, items: str, kind: str, products: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """(path and whether the file is known, path, pos and item of each of its items).

    A file is known if its envelope is of the kind, version and product read here. A format is the name of a product and the kind.
    Files of any product load unless `products` lists the ones to accept.
    """

    top = materialise(_accepted(read.texts, items, "variant", kind, products))
    known = top.select("path", F.col("items").isNotNull().alias("known"))
    entries = top.select("path", F.posexplode("items").alias("pos", "item")).withColumn("pos", F.col("pos").cast("long"))
    if read.skeletons is None:
        return known, entries
    held = _held(read, items, kind, products)
    members = materialise(_members(read, held))
    broken = materialise(members.filter(F.col("item").isNull()).select("path").distinct())
    told = broken.withColumn("_broken", F.lit(True))
    cut = held.join(told, "path", "left").select("path", (F.col("items").isNotNull() & F.col("_broken").isNull()).alias("known"))
    return known.unionByName(cut), entries.unionByName(without_few(members, broken, ["path"]))


def _accepted(files: DataFrame, items: str, item: str, kind: str, products: list[str] | None) -> DataFrame:
    """path and items of files, the latter NULL unless the envelope is one that is read here."""
    whole = F.when(V.is_one_value(F.col("text")), F.col("text"))
    body = F.from_json(whole, f"struct<format: variant, version: variant, {items}: array<{item}>>")
    format = V.text(F.col("body.format"))
    accepted = format.endswith(f"-{kind}") if products is None else format.isin([f"{p}-{kind}" for p in products])
    known = accepted & (V.integer(F.col("body.version")) == 1)
    return files.select("path", body.alias("body")).select("path", F.when(known, F.col(f"body.{items}")).alias("items"))


def _held(read: Read, items: str, kind: str, products: list[str] | None) -> DataFrame:
    # In a skeleton an array holds its number only.
    return materialise(_accepted(read.skeletons, items, "bigint", kind, products))


def _members(read: Read, held: DataFrame) -> DataFrame:
    """path, pos and item of the items of documents that were cut; item is NULL where the text is no value."""
    # Cut at depth two, a text closes no bracket that it has not opened: alone in an array it is a value if the array can be read.
    one = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]"))), "$[0]", "variant")
    return read.elements.join(held.select("path", F.col("items")[0].alias("container")), ["path", "container"]).select(
        "path", F.col("at").alias("pos"), one.alias("item")
    )


def _positive(name: str) -> Column:
    return F.coalesce(F.col(name) > 0, F.lit(False))


def _image_text(name: str) -> Column:
    return V.text(V.member(F.col("image"), name))


def _image_whole(name: str) -> Column:
    return V.integer(V.member(F.col("image"), name))


def _typed_frames(frames: Column) -> Column:
    """The frames of an image with their zones, as far as they are what they should be; zones is NULL where a frame holds no list."""

    def zone(z: Column) -> Column:
        numbers = [F.when(V.is_number(V.member(z, c)), F.try_variant_get(z, f"$.{c}", "double")).alias(c) for c in ZONE[:-1]]
        return F.struct(*numbers, V.text(V.member(z, "note")).alias("note"))

    def whole(z: Column) -> Column:
        return F.struct(*[V.whole(z[c]).alias(c) for c in ZONE[:-1]], z["note"].alias("note"))

    def frame(entry: Column) -> Column:
        zones = F.transform(F.transform(V.elements(entry["value"]), zone), whole)
        return F.struct(entry["key"].alias("key"), entry["key"].try_cast("bigint").alias("frame_index"), zones.alias("zones"))

    return F.transform(F.map_entries(frames), frame)


_NO_BACKUP = "Not a supported annotation backup."


def _backup_reason() -> Column:
    """The first reason to refuse the file of an image that the image itself gives, as a struct of its level and text."""
    valid_id = F.coalesce(F.col("image_id").rlike(r"^[a-f0-9]{64}\z"), F.lit(False))
    known_kind = F.coalesce(F.col("kind").isin("PNG", "DICOM"), F.lit(False))
    sized = _positive("ref_width") & _positive("ref_height") & _positive("frame_count")
    combo_ok = F.coalesce((F.col("combo") == "") | is_digits(F.col("combo")), F.lit(False))
    image = (
        F.when(~valid_id, "Invalid or duplicate image identifier.")
        .when(F.col("name").isNull() | ~known_kind | ~sized, "Invalid image information.")
        .when(~combo_ok, "Invalid combo ID.")
        .when(F.col("frames").isNull(), "Missing frame annotations.")
    )

    def bad_frame(f: Column) -> Column:
        fits = F.coalesce(f["frame_index"] < F.col("frame_count"), F.lit(False))
        return ~(f["key"].rlike(r"^(0|[1-9][0-9]*)\z") & fits) | f["zones"].isNull()

    def torn(z: Column) -> Column:
        return reduce(lambda a, b: a | b, [z[c].isNull() for c in ZONE])

    def outside(z: Column) -> Column:
        return ~torn(z) & F.coalesce(~inside(F.col("ref_width"), F.col("ref_height"), z), F.lit(False))

    # NULL if a frame holds no list, which is a reason before any of these.
    zones = F.flatten(F.transform("frames", lambda f: f["zones"]))
    reasons = [
        (0, F.when(~F.col("known") | F.col("broken"), _NO_BACKUP)),
        (1, F.when(F.col("pos").isNotNull(), image)),
        (2, F.when(F.exists("frames", bad_frame), "Invalid frame index.")),
        (3, F.when(F.exists(zones, outside), "A rectangle lies outside the source image.").when(F.exists(zones, torn), "Invalid native-pixel rectangle.")),
    ]
    return F.coalesce(*[F.when(text.isNotNull(), F.struct(F.lit(level).alias("level"), text.alias("reason"))) for level, text in reasons])


def _judged_backup(files: DataFrame | Read, products: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """(images, rejects) of annotation backups: a row per image of a good file, with its frames and their zones.

    An image is read once, and stored with what it is refused for. A text with a single image that has its path to itself is judged by that row
    alone; all others by the rows of their path.
    """
    read = files if isinstance(files, Read) else Read(files)
    texts = _accepted(read.texts, "images", "variant", "project", products)
    alone = F.lit(read.unique) & F.coalesce(F.size("items") == 1, F.lit(True))
    never = F.lit(False)
    entries = texts.select(
        "path", F.col("items").isNotNull().alias("known"), alone.alias("alone"), never.alias("broken"), F.posexplode_outer("items").alias("pos", "image")
    ).withColumn("pos", F.col("pos").cast("long"))
    if read.skeletons is not None:
        held = _held(read, "images", "project", products)
        unknown = held.filter(F.col("items").isNull()).select(
            "path", never.alias("known"), never.alias("alone"), never.alias("broken"), F.lit(None).cast("long").alias("pos"),
            F.lit(None).cast("variant").alias("image"),
        )
        members = _members(read, held).select(
            "path", F.lit(True).alias("known"), never.alias("alone"), F.col("item").isNull().alias("broken"), "pos", F.col("item").alias("image")
        )
        entries = entries.unionByName(unknown).unionByName(members)
    text, whole = _image_text, _image_whole
    metadata = {**{c: c for c in DEVICE}, "sop_class": "sopClass", "modality": "modality", "photometric": "photometric",
                "transfer_syntax": "transferSyntax"}
    window = V.number(V.member(F.col("image"), "display.windowWidth"))
    invert = V.member(F.col("image"), "display.invert")
    # What JavaScript takes as false: nothing, false, 0 and the empty string.
    falsy = (
        invert.isNull() | (F.schema_of_variant(invert) == "VOID")
        | (F.to_json(invert).isin("false", "0", '""', "0.0", "-0"))
    )
    images = entries.select(
        "path", "known", "alone", "broken", "pos", text("id").alias("image_id"), text("name").alias("name"),
        text("path").alias("image_path"), text("combo").alias("combo"), text("kind").alias("kind"),
        whole("width").alias("ref_width"), whole("height").alias("ref_height"),
        whole("frameCount").alias("frame_count"), whole("frameIndex").alias("frame_index"),
        whole("filenameWidth").alias("filename_width"), whole("filenameHeight").alias("filename_height"),
        F.coalesce(text("sample"), F.lit("")).alias("sample"),
        *[F.coalesce(text(f"metadata.{source}"), F.lit("")).alias(name) for name, source in metadata.items()],
        whole("metadata.bits").cast("int").alias("bits"),
        F.when(window >= 1, window).alias("window_width"),
        V.number(V.member(F.col("image"), "display.windowCenter")).alias("window_center"),
        (~falsy).alias("invert"),
        F.try_variant_get("image", "$.frames", "map<string, variant>").alias("frames"),
    ).withColumn("frames", _typed_frames(F.col("frames")))
    judged = materialise(images.withColumn("reason", _backup_reason()))

    rest = judged.filter(~F.col("alone"))
    reasons = rest.filter(F.col("reason").isNotNull()).select("path", "reason.*")
    # Equal ids have equal hashes, and few others do.
    hashed = rest.filter(F.col("pos").isNotNull()).select("path", "image_id", F.xxhash64("image_id").alias("hash"))
    met = materialise(hashed.groupBy("path", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("path", "hash"))
    if not met.isEmpty():
        twice = join_large(hashed, met, ["path", "hash"], "left_semi").groupBy("path", "image_id").agg(F.count("*").alias("n")).filter("n > 1")
        reasons = reasons.unionByName(twice.select("path", F.lit(1).alias("level"), F.lit("Invalid or duplicate image identifier.").alias("reason")))
    refused = materialise(reasons.groupBy("path").agg(F.min(F.struct("level", "reason"))["reason"].alias("reason")))
    good = without_few(rest.filter(F.col("pos").isNotNull()), refused, ["path"])
    if not read.unique:
        return good, refused
    single = judged.filter("alone")
    fine = single.filter(F.col("pos").isNotNull() & F.col("reason").isNull()).select(*good.columns)
    bad = single.filter(F.col("reason").isNotNull()).select("path", F.col("reason.reason").alias("reason"))
    return fine.unionByName(good), bad.unionByName(refused)


def backup_rejects(files: DataFrame | Read, products: list[str] | None = None) -> DataFrame:
    """The rejects of parse_backup alone: what the good files hold is neither joined nor ranked."""
    return _judged_backup(files, products)[1]


class Backup(Sequence):
    """(images, zones, rejects) of annotation backups. Images get their numbers when they are first asked for."""

    def __init__(self, images: Callable[[], DataFrame], zones: DataFrame, rejects: DataFrame):
        self._made, self._zones, self._rejects = images, zones, rejects

    @cached_property
    def images(self) -> DataFrame:
        return self._made()

    def __len__(self) -> int:
        return 3

    def __getitem__(self, i):
        if isinstance(i, slice):
            return tuple(self[k] for k in range(*i.indices(3)))
        return self.images if i in (0, -3) else (self._zones, self._rejects)[i - 1 if i > 0 else i]


def parse_backup(
    files: DataFrame | Read, sources: DataFrame | None = None, products: list[str] | None = None
) -> Sequence[DataFrame]:
    """(images, zones, rejects) of annotation backups. `sources` lists the image_id of files at hand."""
    good, rejects = _judged_backup(files, products)

    def restored() -> DataFrame:
        opened = F.when(
            (F.col("frame_index") >= 0) & (F.col("frame_index") < F.col("frame_count")), F.col("frame_index")
        ).otherwise(0)
        images = good.select(
            "path", "pos", "image_id", "name", F.coalesce("image_path", "name").alias("image_path"), "combo",
            F.col("ref_width").cast("int").alias("width"), F.col("ref_height").cast("int").alias("height"),
            F.col("frame_count").cast("int").alias("frame_count"), "filename_width", "filename_height", "sample", "kind",
            opened.cast("int").alias("open_frame"), *DEVICE, "modality", "photometric", "transfer_syntax", "bits",
            "window_width", "window_center", "invert",
        )
        ranked = with_global_rank(images, ["path", "pos"], "import_idx")
        if sources is None:
            held = ranked.withColumn("has_source", F.lit(False))
        else:
            at_hand = sources.select("image_id").distinct().withColumn("_held", F.lit(True))
            held = join_large(ranked, at_hand, ["image_id"], "left").withColumn(
                "has_source", F.coalesce("_held", F.lit(False))
            ).drop("_held")
        return held.withColumnRenamed("path", "file").withColumnRenamed("image_path", "path").drop("pos")

    frames = good.select("path", "image_id", F.explode("frames").alias("frame"))
    zones = frames.select("path", "image_id", "frame.frame_index", F.posexplode("frame.zones").alias("ord", "zone"))
    kept = zones.select("path", "image_id", "frame_index", "ord", "zone.*").select(
        "image_id", F.col("frame_index").cast("int").alias("frame_index"), F.col("ord").cast("bigint").alias("ord"),
        *_ints("x", "y", "width", "height"), "note", F.col("path").alias("file"),
    )
    return Backup(restored, kept, rejects)


def read_backup(
    spark: SparkSession, path: str, sources: DataFrame | None = None, products: list[str] | None = None, one_document: bool = False
) -> Sequence[DataFrame]:
    return parse_backup(read_documents(spark, path, one_document), sources, products)


def rekey(rows: DataFrame, keys: list[str], id_column: str, place: list[str]) -> DataFrame:
    """Within `keys`, the first row of an id (by place) keeps it and every later one gets an id of its own.

    New ids follow from where the row stands, so they are the same whenever the job runs again.
    """
    firsts = rows.groupBy(*keys, id_column).agg(F.min(F.struct(*place)).alias("_first"))
    beside = firsts.select(*keys, id_column, *[F.col("_first")[p].alias(p) for p in place], F.lit(True).alias("_own"))
    fresh = derived_id(F.col(id_column), *[F.col(c).cast("string") for c in [*keys, *place]])
    return (
        rows.join(beside, [*keys, id_column, *place], "left")
        .withColumn(id_column, F.when(F.col("_own"), F.col(id_column)).otherwise(fresh))
        .drop("_own")
    )


def parse_templates(
    files: DataFrame | Read, known: DataFrame | None = None, created_at: str = "", products: list[str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(templates, template_zones, rejects). Ids in `known` are skipped; `created_at` fills a missing time."""
    top, entries = _envelope(files if isinstance(files, Read) else Read(files), "templates", "templates", products)
    entries = entries.withColumnRenamed("item", "t")

    def text(name: str) -> Column:
        return V.text(V.member(F.col("t"), name))

    combo = V.member(F.col("t"), "combo")
    own_id = F.nullif(text("id"), F.lit(""))
    rows = entries.select(
        "path", "pos",
        F.coalesce(own_id, derived_id(F.col("path"), F.col("pos").cast("string"))).alias("template_id"),
        text("name").alias("raw_name"), V.text(combo).alias("combo"),
        V.integer(V.member(F.col("t"), "width")).alias("ref_width"),
        V.integer(V.member(F.col("t"), "height")).alias("ref_height"),
        V.elements(V.member(F.col("t"), "zones")).alias("list"),
        F.coalesce(text("createdAt"), F.lit(created_at)).alias("created_at"),
    )
    rows = materialise(rows)
    zones = rows.select(
        "path", "pos", "ref_width", "ref_height", F.posexplode("list").alias("ord", "zone")
    ).select("*", *_zone_columns(F.col("zone"))).drop("zone")
    named = F.coalesce(js_trim(F.col("raw_name")) != "", F.lit(False))
    combo_ok = F.coalesce((F.col("combo") == "") | is_digits(F.col("combo")), F.lit(False))
    rejects = _first_reason(
        [
            _defects(top, F.when(~F.col("known"), "Not a template file.")),
            _defects(
                rows,
                F.when(~named, "A template is missing its name.")
                .when(~(_positive("ref_width") & _positive("ref_height")), "Invalid raster size.")
                .when(~combo_ok, "Invalid combo ID.")
                .when(F.coalesce(F.size("list"), F.lit(0)) <= 0, "A template has no zones."),
            ),
            _defects(
                zones,
                F.when(~_whole_zone(), "Invalid rectangle.")
                .when(~inside(F.col("ref_width"), F.col("ref_height")), "A rectangle lies outside its raster."),
            ),
        ]
    )
    keyed = rekey(rows.join(rejects, "path", "left_anti"), ["path"], "template_id", ["pos"])
    if known is not None:
        keyed = keyed.join(known.select("template_id").distinct(), "template_id", "left_anti")
    templates = keyed.select(
        "template_id", template_name(F.col("raw_name")).alias("name"), "combo",
        F.col("ref_width").cast("int").alias("width"), F.col("ref_height").cast("int").alias("height"),
        "created_at", F.col("path").alias("file"),
    )
    template_zones = zones.join(keyed.select("path", "pos", "template_id"), ["path", "pos"]).select(
        "template_id", F.col("ord").cast("bigint").alias("ord"), *_ints("x", "y", "width", "height"), "note"
    )
    return templates, template_zones, rejects


def read_templates(
    spark: SparkSession, path: str, known: DataFrame | None = None, created_at: str = "", products: list[str] | None = None,
    one_document: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse_templates(read_documents(spark, path, one_document), known, created_at, products)


def read_export_schemas(spark: SparkSession, path: str, known: list[ExportSchema] = ()) -> list[ExportSchema]:
    """The schemas of one exchange file that are not known yet: a handful of settings, wherever Spark can read them."""
    files = text_files(spark, path).limit(2).collect()
    if len(files) != 1:
        raise ValueError("A schema file is one file.")
    try:
        given = json.loads(files[0]["text"])
    except json.JSONDecodeError as error:
        raise ValueError("Not a schema file.") from error
    ids = {schema.id for schema in known}
    return [schema for schema in validate_schema_file(given) if schema.id not in ids]


def judge_definitions(definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(schemas, defects) of a table of definitions: its own columns, and `definition`, the JSON of a schema.

    schemas has the parts of each definition in order (see definition_columns) beside its own columns; defects has a row per
    definition that is not, with everything wrong with it.
    """
    own = [c for c in definitions.columns if c != "definition"]
    one = F.when(V.is_one_value(F.col("definition")), F.try_parse_json("definition"))
    read = definitions.select(*own, one.alias("_d")).select("*", definition_defects(F.col("_d")).alias("defects"))
    # Judged once, for both.
    judged = materialise(read.select(*own, "defects", F.struct(*definition_columns(F.col("_d"))).alias("_s"), V.text(V.member(F.col("_d"), "id")).alias("_id")))
    schemas = judged.filter(F.size("defects") == 0).select(*own, F.nullif("_id", F.lit("")).alias("own_id"), "_s.*")
    return schemas, judged.filter(F.size("defects") > 0).select(*own, "defects")


def parse_schemas(
    files: DataFrame | Read, known: DataFrame | None = None, products: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(schemas, rejects) of schema files or records. A file with any definition out of order is refused as a whole.

    Of equal ids the first in order of file and place keeps it, and every later one gets an id of its own that follows from
    where it stands; so does a schema without one. Ids in `known` are skipped.
    """
    top, entries = _envelope(files if isinstance(files, Read) else Read(files), "schemas", "schema", products)
    schemas, wrong = judge_definitions(entries.select("path", "pos", F.to_json("item").alias("definition")))
    rejects = _first_reason(
        [_defects(top, F.when(~F.col("known"), "Not a schema file.")), _defects(wrong, F.col("defects")[0])]
    )
    good = schemas.join(rejects, "path", "left_anti").withColumn(
        "schema_id", F.coalesce("own_id", derived_id(F.col("path"), F.col("pos").cast("string")))
    ).drop("own_id")
    keyed = rekey(good, [], "schema_id", ["path", "pos"])
    if known is not None:
        keyed = keyed.join(known.select("schema_id").distinct(), "schema_id", "left_anti")
    return keyed.withColumnRenamed("path", "file"), rejects


def read_schemas(
    spark: SparkSession, path: str, known: DataFrame | None = None, products: list[str] | None = None, one_document: bool = False
) -> tuple[DataFrame, DataFrame]:
    """parse_schemas of a file or folder, however many schemas it holds."""
    return parse_schemas(read_documents(spark, path, one_document), known, products)
