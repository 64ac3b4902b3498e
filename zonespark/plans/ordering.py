"""Order-dependent results over a whole table without ever sorting it in one task.

The table is range-partitioned on the order columns and materialised once, so every later step sees the
same slices. Work inside a slice is an ordinary window; what crosses slices is one summary row per slice,
and the number of slices is a setting, not a function of the data.
"""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICE = "_slice"
#: Rows that are counted as few, and broadcast.
_FEW = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for written intermediate results; made up only for a local session."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
        folder = tempfile.mkdtemp(prefix="zonespark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and go on from the written table.

    As a table rather than a checkpoint of rows, later steps read only the columns they need and know its size.
    """
    spark = df.sparkSession
    table = f"{shared_folder(spark)}/zonespark-{uuid.uuid4().hex}"
    # Tables that are read once or twice take less to pack than to store.
    df.write.option("compression", "zstd").parquet(table)
    return spark.read.schema(df.schema).parquet(table)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt over as many tasks as the session has partitions, however few bytes it has.

    A row may stand for work of any size, a stretch of a file or a document to be parsed. Without a number AQE would put such
    small tables into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def sorted_parts(df: DataFrame, *order: str) -> DataFrame:
    """df in order over as many parts as the session has partitions: rows that compress well would end up in one after a plain sort."""
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)


def range_slices(df: DataFrame, order: list[str]) -> DataFrame:
    """df cut into consecutive ranges of `order`, numbered in the column _slice.

    `order` must end in a unique column: ties cannot be split, and a tie could be as large as the table.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(slices, *order).withColumn(SLICE, F.spark_partition_id())
    return materialise(ranged)


def slice_summary(sliced: DataFrame, *aggregates) -> DataFrame:
    return sliced.groupBy(SLICE).agg(*aggregates)


def across_slices():
    """Window over slice summaries. It has no partition key on purpose: there is one row per slice."""
    return Window.orderBy(SLICE)


def with_global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """A dense 0-based position over the whole table in the order given.

    Rows are numbered within their slice as it is written in order, so they are exchanged once.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = sorted_parts(df, *order).withColumn(SLICE, F.spark_partition_id()).withColumn("_local", within)
    sliced = materialise(numbered)
    before = across_slices().rowsBetween(Window.unboundedPreceding, -1)
    offsets = slice_summary(sliced, F.count("*").alias("_n")).select(
        SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        sliced.join(F.broadcast(offsets), SLICE)
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop(SLICE, "_offset", "_local")
    )


def without_few(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in a stored table that mostly has few rows, if any: then the rows stay where they are.

    The few are counted and broadcast, up to some ten thousand; more meet the rows by sorting.
    """
    if others.count() <= _FEW:
        return rows.join(F.broadcast(others.select(*keys)), keys, "left_anti")
    return join_large(rows, others, keys, "left_anti")


def with_rank_within(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """A dense 0-based position inside each key. A key may hold any share of the table.

    Keys lie in consecutive slices, so only the first key of a slice can have begun in slices before it: what is carried
    over is one row per slice, however many keys there are.
    """
    sliced = range_slices(df, keys + order)
    key = F.struct(*keys)
    ends = F.broadcast(slice_summary(sliced, F.min(key).alias("_low"), F.max(key).alias("_high")))
    last = sliced.select(SLICE, key.alias("_key")).join(ends, SLICE).filter(F.col("_key").eqNullSafe(F.col("_high")))
    held = last.groupBy(SLICE, "_key").agg(F.count("*").alias("_n"))
    begun = ends.select(SLICE, F.col("_low").alias("_key"), F.lit(0).cast("bigint").alias("_n"))
    # At most two rows per slice from here on.
    marks = held.unionByName(begun).groupBy(SLICE, "_key").agg(F.sum("_n").alias("_n"))
    earlier = Window.partitionBy("_key").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("_before", F.sum("_n").over(earlier)).filter("_before > 0").select(SLICE, "_key", "_before")
    inside = Window.partitionBy(SLICE, *keys).orderBy(*order)
    ranked = sliced.withColumn("_local", F.row_number().over(inside)).join(F.broadcast(carried), SLICE, "left")
    before = F.when(key.eqNullSafe(F.col("_key")), F.col("_before")).otherwise(0)
    return ranked.withColumn(name, before + F.col("_local") - 1).drop(SLICE, "_local", "_key", "_before")


def lookup(
    rows: DataFrame, per_key: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner", copies: int = 16
) -> DataFrame:
    """Join rows to a table with one row per key, dividing each key over `copies` tasks.

    For tables that came out of a group-by on the key: they are far smaller than `rows`, so repeating them
    costs little, while a key holding a third of `rows` no longer lands in one task.
    """
    if copies <= 1:
        return rows.join(per_key, keys, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(copies)).cast("int"))
    repeated = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def join_large(rows: DataFrame, others: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the library, by sorting and never by a broadcast.

    A stored table counts as large as its files, which hold many times their size in rows: a table of a million image ids passes
    for one to broadcast, and the driver would have to hold it. AQE still splits keys that hold a large share.
    """
    return rows.join(others.hint("merge"), keys, how)


def beside_each_other(*single_rows: DataFrame) -> DataFrame:
    """Tables of one row each as one row with all their columns, without a join."""
    stacked = single_rows[0]
    for table in single_rows[1:]:
        stacked = stacked.unionByName(table, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
