"""Image files as tables: what each file is, and every DICOM tag it carries."""

import json
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonespark.functions.filenames import parse_filename
from zonespark.functions.identifying import is_identifying_tag
from zonespark.functions.tags import format_tag, is_private_tag, keyword_to_name
from zonespark.functions.text import MAX_SAFE_INTEGER
from zonespark.plans.ordering import materialise
from zonespark.schemas import DEVICE, names_of
from zonespark.shipping import ship_package
from zonespark.sources.dicom_dictionary import DICTIONARY
from zonespark.sources.dicom_values import find_warnings, tag_rows
from zonespark.sources.dicom_walk import PIXEL_DATA, Malformed, read_elements
from zonespark.sources.ranged import DicomTags, ImageHeaders, Opener, in_batches, is_archive, load, map_files, members_of, ranged, reachable

PNG_MAGIC = bytearray([0x89, 0x50, 0x4E, 0x47, 0x0D, 0x0A, 0x1A, 0x0A])

_HEADER = (
    "width BIGINT, height BIGINT, frame_count DOUBLE, manufacturer STRING, model STRING, sop_class STRING,"
    " software STRING, modality STRING, photometric STRING, transfer_syntax STRING, bits INT, error STRING"
)
#: What a file is, before it is judged: its path, hash, whether it is a PNG, and the facts of its header.
FILE_HEADER = f"path STRING, image_id STRING, png BOOLEAN, {_HEADER}"
TAGS = (
    "file STRING, image_id STRING, row_idx BIGINT, hex STRING, vr STRING, keyword STRING, value STRING,"
    " binary BOOLEAN, sequence BOOLEAN, length BIGINT, steps STRING, partial BOOLEAN, warning STRING"
)
_ARROW = {
    "STRING": pa.string(), "BIGINT": pa.int64(), "INT": pa.int32(), "DOUBLE": pa.float64(), "BOOLEAN": pa.bool_(),
}


def _arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (column.split() for column in ddl.split(","))])


HEADER_ARROW, TAGS_ARROW = _arrow_schema(FILE_HEADER), _arrow_schema(TAGS)
_WARNINGS = "image_id STRING, file STRING, partial BOOLEAN, warning STRING"
_WARNINGS_ARROW = _arrow_schema(_WARNINGS)
# Where the four device attributes and the other header facts are stored.
HEADER_TAGS = {
    "sop_class": "00080016", "modality": "00080060", "manufacturer": "00080070", "model": "00081090",
    "software": "00181020", "photometric": "00280004", "transfer_syntax": "00020010",
}


def list_files(spark: SparkSession, path: str, archives: bool = False) -> DataFrame:
    """Every file below a folder with its bytes, leaving out hidden files and DICOMDIR. With `archives`, ZIP files stand for what they hold."""
    files = importable(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content"))
    if not archives:
        return files
    ship_package(spark)

    def row(name: str, content: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([content], pa.binary())], ["path", "content"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not is_archive(name):
                    yield row(name, value.as_py())
                    continue
                try:
                    for member, opener in members_of(pa.BufferReader(value.as_buffer()), name):
                        try:
                            with opener() as data:
                                content = data[:]
                        except OSError:
                            content = b""
                        yield row(member, content)
                except (zipfile.BadZipFile, pa.ArrowException, OSError):
                    # No archive, so a file that is no image.
                    yield row(name, value.as_py())

    return files.mapInArrow(unpack, "path string, content binary")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def importable(files: DataFrame) -> DataFrame:
    name = file_name(F.col("path"))
    return files.filter(~name.startswith(".") & (name != "DICOMDIR"))


def _dicom_facts(data) -> dict:
    """The header of a DICOM file given as bytes or as a file read by range."""
    empty = dict.fromkeys(names_of(_HEADER))
    try:
        found, problem = read_elements(data, DICTIONARY, until=PIXEL_DATA)
    except Malformed:
        problem = "unreadable"
    if problem:
        return {**empty, "error": "Not a readable DICOM Part 10 file or PNG."}
    if PIXEL_DATA not in found.elements:
        return {**empty, "error": "DICOM contains no supported image Pixel Data."}
    facts = {name: found.string(tag) for name, tag in HEADER_TAGS.items()}
    for name in ("modality", "photometric", "transfer_syntax"):
        facts[name] = facts[name] or "—"
    try:
        frames = float(found.string("00280008") or 1)
    except ValueError:
        frames = None
    return {
        **empty, **facts, "width": found.number("00280011"), "height": found.number("00280010"),
        "frame_count": frames, "bits": found.number("00280100"),
    }


def _dicom_header(contents: pd.Series) -> pd.DataFrame:
    empty = dict.fromkeys(names_of(_HEADER))
    return pd.DataFrame([empty if c is None else _dicom_facts(bytes(c)) for c in contents], columns=names_of(_HEADER))


UNREADABLE = "The file could not be read."


def header_rows(path: str, opener: Opener | None = None) -> Iterator[tuple]:
    """The row of one file, read by range. A file that cannot be read is a row with an error."""
    facts, image_id, png = dict.fromkeys(names_of(_HEADER)), None, False
    try:
        with opener() if opener else ranged(path) as data:
            image_id, png = data.sha256(), data[:8] == bytes(PNG_MAGIC)
            if png:
                # What follows the length and name of the first chunk; a shorter file has no size.
                sizes = [data[at:at + 4] for at in (16, 20)]
                width, height = (int.from_bytes(raw, "big") if raw else None for raw in sizes)
                facts = {**facts, "width": width, "height": height, "frame_count": 1.0}
            else:
                facts = _dicom_facts(data)
    except OSError:
        facts["error"] = UNREADABLE
    yield path, image_id, png, *facts.values()


def inspect_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, rejects) of a table of files (path, content).

    The id is the SHA-256 of the bytes. A PNG's size is read from its header by Spark itself; only DICOM bytes
    go to a Python worker. A file that cannot be used is a row of rejects and stops nothing.
    """
    ship_package(files.sparkSession)
    is_png = F.substring("content", 1, 8) == F.lit(PNG_MAGIC)

    def png_number(start: int) -> Column:
        return F.conv(F.hex(F.substring("content", start, 4)), 16, 10).try_cast("bigint")

    read = (
        files.withColumn("_png", is_png)
        .withColumn("_dicom", F.when(~F.col("_png"), F.col("content")))
        .select(
            "path", F.sha2("content", 256).alias("image_id"), "_png",
            F.when(F.col("_png"), png_number(17)).alias("_pw"), F.when(F.col("_png"), png_number(21)).alias("_ph"),
            F.pandas_udf(_dicom_header, _HEADER)("_dicom").alias("h"),
        )
    )
    return _judged(read)


def inspect_paths(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, rejects) of a table of files given by their path alone. They are read by range, whatever their length."""
    return _judged(_as_read(map_files(paths, FILE_HEADER, HEADER_ARROW, header_rows)))


def _as_read(headers: DataFrame) -> DataFrame:
    facts = [F.col(c) for c in names_of(_HEADER)]
    nothing = F.lit(None).cast("bigint")
    return headers.select("path", "image_id", F.col("png").alias("_png"), nothing.alias("_pw"), nothing.alias("_ph"), F.struct(*facts).alias("h"))


def _judged(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    width, height = F.coalesce("_pw", "h.width"), F.coalesce("_ph", "h.height")
    frames = F.when(F.col("_png"), F.lit(1.0)).otherwise(F.col("h.frame_count"))
    # Rasters and frame counts are INT columns from here on; the format's own fields are narrower still.
    limit = 2**31 - 1
    whole = (
        width.between(1, limit) & height.between(1, limit) & frames.between(1, min(limit, MAX_SAFE_INTEGER))
        & (frames == F.floor(frames))
    )
    error = F.coalesce(
        F.col("h.error"),
        F.when(~F.coalesce(whole, F.lit(False)), "Invalid image dimensions or frame count."),
    )
    facts = [*DEVICE, "modality", "photometric", "bits", "transfer_syntax"]
    judged = read.select(
        "path", "image_id", "_png", width.alias("width"), height.alias("height"), frames.alias("frame_count"), error.alias("error"),
        *[F.col(f"h.{c}").alias(c) for c in facts],
    )
    # Images and rejects come from one reading of the files. What the path tells is not stored beside it.
    judged = materialise(judged)
    rejects = judged.filter(F.col("error").isNotNull()).select("path", "error")
    header = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in DEVICE]
    name = file_name(F.col("path"))
    named = judged.filter(F.col("error").isNull()).withColumn("name", name).withColumn("stated", parse_filename(name))
    images = named.select(
        "image_id", "name", "path",
        F.coalesce("stated.combo", F.lit("")).alias("combo"),
        F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"),
        F.col("frame_count").cast("int").alias("frame_count"),
        F.col("stated.width").alias("filename_width"), F.col("stated.height").alias("filename_height"),
        F.coalesce("stated.sample", F.lit("")).alias("sample"),
        F.when(F.col("_png"), "PNG").otherwise("DICOM").alias("kind"),
        F.lit(0).alias("open_frame"), F.lit(True).alias("has_source"),
        *header, *facts[len(DEVICE):],
    )
    return images, rejects


#: Longest file that Spark's own source gives as a value.
_LONGEST_VALUE = 2**31 - 1
TOO_LONG = "The file is too long for a store that only Spark reads."


def _too_long(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.col("length") > _LONGEST_VALUE)
    return importable(files.select("path")).withColumn("error", F.lit(TOO_LONG))


def scan_images(spark: SparkSession, path: str, archives: bool = False) -> tuple[DataFrame, DataFrame]:
    """(images, rejects) of every file below a folder.

    Files are read by range, however long they are, and a file that cannot be read is a row of rejects. Where Python cannot open
    the store, Spark reads whole files, and those too long for a value are rejects as well. With `archives`, ZIP files stand for the
    files they hold (see members_of).
    """
    if reachable(path):
        return _judged(_as_read(load(spark, ImageHeaders, path, archives=str(archives).lower())))
    images, rejects = inspect_files(list_files(spark, path, archives))
    return images, rejects.unionByName(_too_long(spark, path))


def file_tags(path: str, dictionary: dict | None, opener: Opener | None = None) -> Iterator[tuple]:
    """The tag rows and warnings of one DICOM file, read by range; a PNG has none."""
    try:
        with opener() if opener else ranged(path) as data:
            if data[:8] == bytes(PNG_MAGIC):
                return
            start = path, data.sha256()
            yield from ((*start, *row) for row in _one_file(data, DICTIONARY if dictionary is None else dictionary))
    except OSError:
        yield path, None, *(None,) * 9, False, UNREADABLE


def _one_file(content, dictionary: dict) -> Iterator[tuple]:
    """The tag rows of a file, and a row per warning: those have no tag but say what is wrong."""
    blank = (None,) * 9
    try:
        found, problem = read_elements(content, dictionary)
    except Malformed:
        yield *blank, False, _NOTHING_READ
        return
    warnings: dict[str, None] = {}
    for row_idx, row in enumerate(tag_rows(found, dictionary, warnings)):
        yield row_idx, *row, None, None
    for partial, warning in _told(warnings, problem):
        yield *blank, partial, warning


_NOTHING_READ = "Could not parse the DICOM metadata."


def _told(warnings: dict[str, None], problem: str | None) -> Iterator[tuple]:
    if problem:
        warnings["Partial metadata: only the tags before a malformed or unsupported element are shown."] = None
    for warning in warnings:
        yield problem is not None, warning


def _warnings_of(content, dictionary: dict) -> Iterator[tuple]:
    """Whether it could be read in part, and the warning, for each warning of a file."""
    try:
        found, problem = read_elements(content, dictionary)
    except Malformed:
        yield False, _NOTHING_READ
        return
    warnings: dict[str, None] = {}
    find_warnings(found, dictionary, warnings)
    yield from _told(warnings, problem)


def read_warnings(files: DataFrame, dictionary: dict[str, tuple[str, str]] = DICTIONARY) -> DataFrame:
    """The warnings of read_tags alone: every file is gone through as there, but no row of a tag is made or written."""
    ship_package(files.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i, content in enumerate(batch.column(2)):
                    for told in _warnings_of(content.as_py(), dictionary):
                        yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), *told

        yield from in_batches(rows(), _WARNINGS_ARROW)

    hashed = files.select(F.sha2("content", 256).alias("image_id"), F.col("path").alias("file"), "content")
    return hashed.mapInArrow(parse, _WARNINGS)


def read_tags(files: DataFrame, dictionary: dict[str, tuple[str, str]] = DICTIONARY) -> tuple[DataFrame, DataFrame]:
    """(tags, warnings) of a table of DICOM files (path, content).

    tags has a row per element, sequence items included, numbered by row_idx in file order. warnings tells of
    text that could not be decoded and of files that could be read in part or not at all.
    """
    ship_package(files.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, image_id, content in zip(*(batch.column(i) for i in range(3))):
                    start = path.as_py(), image_id.as_py()
                    yield from ((*start, *row) for row in _one_file(content.as_py(), dictionary))

        yield from in_batches(rows(), TAGS_ARROW)

    # Tags and warnings come from one reading of the files.
    hashed = files.select("path", F.sha2("content", 256).alias("image_id"), "content")
    return _tags_and_warnings(hashed.mapInArrow(parse, TAGS))


def _tags_and_warnings(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = materialise(read)
    tags = parsed.filter(F.col("hex").isNotNull()).select(
        "image_id", "file", "row_idx", format_tag(F.col("hex")).alias("tag"), "hex", "vr",
        keyword_to_name(F.col("keyword")).alias("name"), "keyword", "value", "binary",
        is_private_tag(F.col("hex")).alias("private"), is_identifying_tag(F.col("hex")).alias("phi"), "sequence",
        keyword_to_name(F.col("steps")).alias("path"), "length",
    )
    warnings = parsed.filter(F.col("warning").isNotNull()).select("image_id", "file", "partial", "warning")
    return tags, warnings


def scan_dicom_tags(
    spark: SparkSession, path: str, dictionary: dict[str, tuple[str, str]] = DICTIONARY, archives: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(tags, warnings) of every DICOM file below a folder; PNG files have none.

    Files are read by range, however long they are. Where Python cannot open the store, Spark reads whole files.
    With `archives`, ZIP files stand for the files they hold.
    """
    if reachable(path):
        given = {} if dictionary is DICTIONARY else {"dictionary": json.dumps(dictionary)}
        return _tags_and_warnings(load(spark, DicomTags, path, archives=str(archives).lower(), **given))
    files = list_files(spark, path, archives).filter(F.substring("content", 1, 8) != F.lit(PNG_MAGIC))
    tags, warnings = read_tags(files, dictionary)
    long = _too_long(spark, path).select(
        F.lit(None).cast("string").alias("image_id"), F.col("path").alias("file"), F.lit(False).alias("partial"), F.col("error").alias("warning")
    )
    return tags, warnings.unionByName(long)
