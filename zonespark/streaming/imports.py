"""Continuous import: new files in a folder join the library once per content.

Content hashes of the whole past have to be known, so streaming de-duplication would keep its state for ever.
The library on disk is that state instead: every micro-batch asks it for its own hashes and writes what it adds as a run
under the number of the batch. A batch that runs again after a failure overwrites its own run and no others.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from zonespark.operators.imports import numbered, taken_files
from zonespark.plans.ordering import join_large, with_global_rank
from zonespark.sources.images import importable, inspect_files, inspect_paths
from zonespark.sources.ranged import reachable
from zonespark.streaming.library import Library, Run, brief, table, whole

_REJECTS = "path STRING, error STRING"


def read_library(spark: SparkSession, library_path: str, before: int | None = None) -> DataFrame:
    """The library as the batches wrote it, or as it was before one of them."""
    return Library(spark, library_path, before).images()


def read_rejects(spark: SparkSession, library_path: str) -> DataFrame:
    """Files that could not be imported, with the reason and the batch that met them."""
    return table(spark, f"{library_path}/rejects", f"{_REJECTS}, batch BIGINT")


def import_batch(files: DataFrame, batch: int, library_path: str) -> None:
    """Add the new contents of one batch of files to the library. Files have a path and, if need be, their content."""
    library = Library(files.sparkSession, library_path, batch).merge_runs()
    inspect = inspect_files if "content" in files.columns else inspect_paths
    images, rejects = inspect(importable(files))
    rejects.select("path", "error").write.mode("overwrite").parquet(f"{library_path}/rejects/batch={batch}")
    # The contents of files have a hash each, which is exchanged as bytes.
    hashed = brief(images)
    near = library.near(images.select("image_id")).select(F.unhex("image_id").alias("image_id"), "has_source")
    known = near.groupBy("image_id").agg(F.max("has_source").alias("has_source"))
    # What happens to a file is told by its hash and path; the images meet that once, and are not stored again for it.
    incoming = hashed.withColumnsRenamed({"hash": "image_id", "id": "_id"})
    taken = with_global_rank(taken_files(known, incoming.select("image_id", "path")), ["outcome", "path"], "place")
    counts = {r["outcome"]: r["count"] for r in taken.groupBy("outcome").count().collect()}
    # Added files come before those of images that are known.
    new, back = (taken.filter(F.col("outcome") == o).drop("outcome") for o in ("added", "reconnected"))
    rows = numbered(incoming, library.next_idx, places=new).withColumn("again", F.lit(False))
    if counts.get("reconnected"):
        again = join_large(incoming, back.drop("place").distinct(), ["image_id", "path"])
        rows = rows.unionByName(again.withColumn("import_idx", F.lit(None).cast("bigint")).withColumn("again", F.lit(True)))
    rows = whole(rows.withColumnsRenamed({"image_id": "hash", "_id": "id"}))
    added = counts.get("added", 0)
    library.write_run(
        rows.withColumn("has_source", F.lit(True)), Run(0, batch, batch), library.next_idx + added - 1, added + counts.get("reconnected", 0)
    )


def import_stream(files: DataFrame, library_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Import a stream of files (path, and content where Spark has to read it), wherever it comes from."""
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: import_batch(batch, number, library_path)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_import(
    spark: SparkSession, path: str, library_path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Watch a folder and import what appears. once=True takes what is there and stops.

    A file that cannot be read as an image does not stop the stream; read_rejects lists it. Files are read by range, so
    the stream itself carries only their paths, unless Spark alone can open the store.
    """
    files = (
        spark.readStream.format("binaryFile").option("recursiveFileLookup", True)
        .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY").load(path)
    )
    return import_stream(files.select("path") if reachable(path) else files.select("path", "content"), library_path, checkpoint, once)
