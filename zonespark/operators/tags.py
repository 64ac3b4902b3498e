"""Searching and counting DICOM tag rows."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonespark.functions.identifying import is_identifying_tag
from zonespark.functions.tags import format_tag, is_private_tag
from zonespark.functions.text import js_trim

FILTERS = ["all", "phi", "standard", "private", "sequences"]
PAGE = 150
BURNED_IN = "00280301"


def with_tag_facts(tags: DataFrame) -> DataFrame:
    """Tag rows (hex, vr, …) with the columns that follow from the tag number, where they are missing."""
    facts = {
        "tag": format_tag(F.col("hex")), "private": is_private_tag(F.col("hex")),
        "phi": is_identifying_tag(F.col("hex")), "sequence": F.col("vr") == "SQ",
    }
    return tags.withColumns({name: fact for name, fact in facts.items() if name not in tags.columns})


def in_filter(name: str) -> Column:
    if name == "phi":
        return F.col("phi")
    if name == "standard":
        return ~F.col("private")
    if name == "private":
        return F.col("private")
    if name == "sequences":
        return F.col("sequence")
    return F.lit(True)


def tag_text(columns: list[str]) -> Column:
    """What a tag row is searched in, in lower case."""
    searched = [c for c in ("tag", "name", "keyword", "vr", "value", "path") if c in columns]
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in searched]))


def tag_digits(query: str) -> str | None:
    """The digits of a query that may be a tag number."""
    digits = re.sub(r"[(),\s]", "", re.sub(r"^(0x|x)", "", query.strip().lower()))
    return digits if re.fullmatch(r"[0-9a-f]{4,}", digits) else None


def search_tags(tags: DataFrame, query: str = "", filter: str = "all") -> DataFrame:
    """Rows of one filter whose number, name, keyword, VR, value or path contains the query.

    A query of four or more hexadecimal digits, however it is punctuated, is also looked up as a number.
    """
    kept = tags.filter(in_filter(filter))
    needle, digits = query.strip().lower(), tag_digits(query)
    if not needle:
        return kept
    hit = tag_text(tags.columns).contains(needle)
    if digits:
        hit = hit | F.col("hex").contains(digits)
    return kept.filter(hit)


def tag_page(tags: DataFrame, page: int, size: int = PAGE, image_id: str | None = None) -> DataFrame:
    """One page of the tags of a file, in file order; without image_id that page of every file.

    Tags are numbered within their file, so a page costs the same wherever the file stands.
    """
    chosen = tags if image_id is None else tags.filter(F.col("image_id") == image_id)
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("row_idx"))
    first = page * size
    ranked = chosen.withColumn("_place", place).filter((F.col("_place") > first) & (F.col("_place") <= first + size))
    return ranked.orderBy("image_id", "_place").drop("_place")


def tag_counts(tags: DataFrame, per_image: bool = False) -> DataFrame:
    """How many tag rows every filter keeps, over all or per image."""
    grouped = tags.groupBy("image_id") if per_image else tags.groupBy()
    return grouped.agg(*[F.count_if(in_filter(name)).alias(name) for name in FILTERS])


def burned_in_flag(tags: DataFrame) -> DataFrame:
    """What each file declares about burned-in text. The declaration can be absent or wrong."""
    here = F.col("hex") == BURNED_IN
    first = F.min(F.when(here, F.struct("row_idx", F.coalesce("value", F.lit("")).alias("value"))))
    flagged = tags.groupBy("image_id").agg(first.alias("_first"))
    value = js_trim(F.col("_first.value"))
    declared = (
        F.when(F.col("_first").isNull(), "absent").when(value == "", "empty")
        .when(F.lower(value) == "yes", "yes").when(F.lower(value) == "no", "no").otherwise("unrecognised")
    )
    return flagged.select("image_id", value.alias("value"), declared.alias("declared"))
