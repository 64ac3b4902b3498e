"""Searching for a part of a text by its three-letter grams.

Rows are stored in slices, and for each gram of their text a posting says in which row and slice it stands. A text that
contains a needle has all its grams: the postings of the rarest are intersected, only the slices of what is left are read, and the needle is
looked for in them exactly. A needle of less than three letters has no gram and reads all rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonespark.operators.tags import in_filter, tag_digits, tag_text
from zonespark.operators.triage import image_text

GRAM = 3
#: Directories the postings are dealt over, and grams of a needle whose postings are read.
_BUCKETS, _RAREST = 64, 3
_POSTINGS = "gram string, _row long, _slice int, bucket int"


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(_BUCKETS)).cast("int")


def _grams(text: Column) -> Column:
    """The different grams of a text."""
    starts = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(GRAM))))


class SearchIndex:
    """Rows below a path with an index of one text of each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def write(rows: DataFrame, text: Column, path: str, slices: int | None = None) -> "SearchIndex":
        """Store rows and index a text of them, which is kept in the column _text."""
        spark = rows.sparkSession
        slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
        kept = rows.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_row", F.monotonically_increasing_id())
        # A row's number says which task wrote it, and those of a task stay together.
        sliced = kept.withColumn("_slice", F.pmod(F.shiftright("_row", 33), F.lit(slices)).cast("int"))
        # An empty table has no directories that would tell its columns.
        sliced.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
        sliced.write.mode("overwrite").partitionBy("_slice").parquet(f"{path}/rows")
        stored = SearchIndex(spark, path).rows(None)
        postings = stored.select(F.explode(_grams(F.col("_text"))).alias("gram"), "_row", "_slice").withColumn("bucket", _bucket(F.col("gram")))
        # A gram that stands everywhere is divided by row.
        spread = postings.repartition("bucket", F.pmod(F.xxhash64("_row"), F.lit(8))).sortWithinPartitions("bucket", "gram", "_row")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        counts = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.count("*").alias("rows"))
        counts.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")
        return SearchIndex(spark, path)

    def _rarest(self, needle: str) -> list[tuple[str, int]] | None:
        """(gram, bucket) of the rarest grams of a needle; None if one of them stands nowhere."""
        grams = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string").withColumn("bucket", _bucket(F.col("gram")))
        places = {r["gram"]: r["bucket"] for r in asked.collect()}
        counts = self.spark.read.schema("gram string, rows long, bucket int").parquet(f"{self.path}/counts").filter(F.col("bucket").isin(sorted(set(places.values()))) & F.col("gram").isin(grams))
        found = counts.orderBy("rows", "gram").limit(len(grams)).collect()
        if len(found) < len(grams):
            return None
        return [(r["gram"], places[r["gram"]]) for r in found[:_RAREST]]

    def candidates(self, needle: str) -> DataFrame | None:
        """_row and _slice of the rows that have the rarest grams of a needle; None if every row may hold it."""
        if len(needle) < GRAM:
            return None
        rarest = self._rarest(needle)
        if rarest is None:
            return self.spark.createDataFrame([], "_row long, _slice int")
        postings = self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings")
        chosen = postings.filter(F.col("bucket").isin(sorted({b for _, b in rarest})) & F.col("gram").isin([g for g, _ in rarest]))
        return chosen.groupBy("_row", "_slice").agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).select("_row", "_slice")

    def rows(self, candidates: DataFrame | None) -> DataFrame:
        """The stored rows, or those of some candidates; of the latter only the slices are read."""
        columns = self.spark.read.parquet(f"{self.path}/columns").schema
        stored = self.spark.read.schema(columns).parquet(f"{self.path}/rows")
        if candidates is None:
            return stored
        # At most as many as there are slices.
        slices = [r["_slice"] for r in candidates.select("_slice").distinct().collect()]
        return stored.filter(F.col("_slice").isin(slices)).join(candidates.select("_row"), "_row", "left_semi")

    def search(self, needle: str) -> DataFrame:
        """The rows whose text contains the needle, as they were written."""
        found = self.rows(self.candidates(needle)).filter(F.col("_text").contains(needle))
        return found.drop("_row", "_slice", "_text")


def index_images(images: DataFrame, path: str) -> SearchIndex:
    """An index for search_images_indexed."""
    return SearchIndex.write(images, image_text(), path)


def search_images_indexed(index: SearchIndex, query: str) -> DataFrame:
    """search_images over indexed images."""
    return index.search(query.strip().lower())


def index_tags(tags: DataFrame, path: str) -> SearchIndex:
    """An index for search_tags_indexed of tag rows with all their facts; numbers are indexed beside the text."""
    return SearchIndex.write(tags, F.concat_ws("\n", tag_text(tags.columns), "hex"), path)


def search_tags_indexed(index: SearchIndex, query: str = "", filter: str = "all") -> DataFrame:
    """search_tags over indexed tag rows."""
    needle, digits = query.strip().lower(), tag_digits(query)
    if not needle:
        return index.rows(None).filter(in_filter(filter)).drop("_row", "_slice", "_text")
    candidates = index.candidates(needle)
    if digits and candidates is not None:
        # A number has four digits at least, so it has grams.
        candidates = candidates.unionByName(index.candidates(digits)).distinct()
    rows = index.rows(candidates).filter(in_filter(filter))
    # What stands before the number, which is the last line.
    hit = F.expr("substring(_text, 1, length(_text) - length(hex) - 1)").contains(needle)
    if digits:
        hit = hit | F.col("hex").contains(digits)
    return rows.filter(hit).drop("_row", "_slice", "_text")
