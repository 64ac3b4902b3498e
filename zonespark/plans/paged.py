"""A table in an order, stored so that a page or the neighbours of a row cost one slice and not a sort.

The table is written once in consecutive slices of its order, each row with its position. A directory keeps a row per slice: where it
begins, how many rows it has and the order columns of its first and last. Whoever looks for a place asks the directory and reads one slice or two.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonespark.plans.ordering import SLICE, across_slices, range_slices, slice_summary

POSITION = "position"


class PagedTable:
    """An ordered table below a path; positions count from 0."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        # One row per slice, as many as the session had shuffle partitions when the table was written.
        self.slices = spark.read.parquet(f"{path}/directory").orderBy("first").collect()
        self.total = sum(s["n"] for s in self.slices)

    @staticmethod
    def write(table: DataFrame, order: list[str], path: str) -> "PagedTable":
        """Write a table in an order that ends in a unique column."""
        sliced = range_slices(table, order)
        inside = Window.partitionBy(SLICE).orderBy(*order)
        place = F.struct(*order)
        before = across_slices().rowsBetween(Window.unboundedPreceding, -1)
        directory = slice_summary(sliced, F.count("*").alias("n"), F.min(place).alias("low"), F.max(place).alias("high")).select(
            SLICE, F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first"), "n", "low", "high"
        )
        directory.coalesce(1).write.mode("overwrite").parquet(f"{path}/directory")
        spark = table.sparkSession
        # The directory has one row per slice.
        firsts = F.broadcast(spark.read.parquet(f"{path}/directory").select(SLICE, "first"))
        placed = sliced.withColumn("_local", F.row_number().over(inside)).join(firsts, SLICE)
        rows = placed.withColumn(POSITION, (F.col("first") + F.col("_local") - 1).cast("long")).drop("first", "_local")
        # An empty table has no directories that would tell its columns.
        rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
        rows.write.mode("overwrite").partitionBy(SLICE).parquet(f"{path}/rows")
        return PagedTable(spark, path)

    def _rows(self, first: int, last: int) -> DataFrame:
        """Rows of the positions first to last, both included; only the slices they lie in are read."""
        needed = [s[SLICE] for s in self.slices if s["first"] <= last and s["first"] + s["n"] > first]
        rows = self._stored().filter(F.col(SLICE).isin(needed))
        return rows.filter(F.col(POSITION).between(first, last)).drop(SLICE)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/columns").schema).parquet(f"{self.path}/rows")

    def page(self, number: int, size: int) -> DataFrame:
        """The rows of one page, in order; pages count from 0."""
        return self._rows(number * size, (number + 1) * size - 1).orderBy(POSITION)

    def around(self, position: int, reach: int = 1) -> DataFrame:
        """The row at a position with its neighbours on both sides, in order."""
        return self._rows(position - reach, position + reach).orderBy(POSITION)

    def position_of(self, key: dict) -> int | None:
        """Where the row stands whose order columns have these values; None if there is none. Reads one slice."""
        names = list(self.slices[0]["low"].asDict()) if self.slices else []

        def sorts(values) -> tuple:
            # As Spark sorts: null before anything.
            return tuple((v is not None, v) if v is not None else (False,) for v in values)

        wanted = sorts(key[n] for n in names)
        for s in self.slices:
            if sorts(s["low"]) <= wanted <= sorts(s["high"]):
                rows = self._stored().filter(F.col(SLICE) == s[SLICE])
                for n in names:
                    rows = rows.filter(F.col(n).eqNullSafe(F.lit(key[n])))
                found = rows.select(POSITION).first()
                return found[POSITION] if found else None
        return None
