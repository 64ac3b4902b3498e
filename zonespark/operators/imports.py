"""Bringing files into a library by content: equal bytes are the same image, whatever the name."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonespark.plans.ordering import join_large, with_global_rank


def import_outcomes(library: DataFrame, incoming: DataFrame, order: str = "path") -> DataFrame:
    """incoming (image_id and its order) with what happens to each file: added, reconnected or duplicate.

    Only the first file of every content can be anything but a duplicate, so the library meets one row per
    content, and the answer goes back to that very file; copies of one content never gather anywhere.
    """
    told = _told_of_firsts(library, incoming, order)
    return incoming.join(told, ["image_id", order], "left").withColumn(
        "outcome", F.coalesce("outcome", F.lit("duplicate"))
    )


def _told_of_firsts(library: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """The first file of every content, with its outcome: NULL where the library has content and source."""
    firsts = incoming.groupBy("image_id").agg(F.min(order).alias(order))
    known = library.select("image_id", F.coalesce("has_source", F.lit(False)).alias("_has_source"))
    outcome = F.when(F.col("_has_source").isNull(), "added").when(~F.col("_has_source"), "reconnected")
    return firsts.join(known, "image_id", "left").select("image_id", order, outcome.alias("outcome"))


def taken_files(library: DataFrame, incoming: DataFrame, order: str = "path") -> DataFrame:
    """The files of incoming (image_id and its order) that are added or reconnected: import_outcomes without the duplicates.

    Files do not meet their contents once more for it, unless one of them is listed twice.
    """
    told = _told_of_firsts(library, incoming, order).filter(F.col("outcome").isNotNull())
    listed = incoming.select("image_id", order)
    if listed.groupBy(F.xxhash64("image_id", order).alias("file")).count().filter("count > 1").isEmpty():
        return told
    return listed.join(told, ["image_id", order])


def added_images(library: DataFrame, outcomes: DataFrame, order: str = "path") -> DataFrame:
    """The new images of an import, numbered on from the library's last one in `order`."""
    fresh = with_global_rank(outcomes.filter(F.col("outcome") == "added").drop("outcome"), [order], "_rank")
    after = library.agg(F.coalesce(F.max("import_idx") + 1, F.lit(0)).alias("after"))
    return (
        fresh.withColumn("import_idx", F.col("_rank") + after.scalar()).drop("_rank")
        .withColumn("has_source", F.lit(True))
    )


def numbered(images: DataFrame, start: int, order: str = "path", places: DataFrame | None = None) -> DataFrame:
    """New images numbered from `start` in `order`: all of them, or those of `places` (image_id, order and place), which are ranked already.

    Only the order column is sorted and ranked; the images meet their numbers in a join that splits like any other.
    """
    if places is None:
        places = with_global_rank(images.select("image_id", order), [order], "place")
    return join_large(images, places, ["image_id", order]).withColumn("import_idx", F.col("place") + F.lit(start)).drop("place")


def reconnect(library: DataFrame, back: DataFrame) -> DataFrame:
    """The library with the images of `back` (image_id) marked as having their source again."""
    marked = back.select("image_id").distinct().withColumn("_back", F.lit(True))
    source = F.coalesce("has_source", F.lit(False)) | F.coalesce("_back", F.lit(False))
    return library.join(marked, "image_id", "left").withColumn("has_source", source).drop("_back")


def merge_import(library: DataFrame, incoming: DataFrame, order: str = "path") -> tuple[DataFrame, DataFrame]:
    """(library after the import, outcome per incoming file).

    A known image without a source gets it back and keeps everything else; new images go to the end of the
    library in `order`, which has to be unique per file.
    """
    outcomes = import_outcomes(library, incoming, order)
    kept = reconnect(library, outcomes.filter(F.col("outcome") == "reconnected"))
    added = added_images(library, outcomes, order)
    return kept.unionByName(added.select(*[c for c in library.columns if c in added.columns]), True), outcomes


def import_summary(outcomes: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """How many files were added, reconnected, skipped as duplicates, or could not be read."""
    counts = outcomes.groupBy("outcome").agg(F.count("*").alias("files"))
    if rejects is None:
        return counts
    failed = rejects.agg(F.lit("failed").alias("outcome"), F.count("*").alias("files")).filter(F.col("files") > 0)
    return counts.unionByName(failed)
