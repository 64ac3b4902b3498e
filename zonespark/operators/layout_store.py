"""Layouts kept up to date: a batch of added and removed zones costs the layouts it touches, not the library.

The store keeps, per layout, every place a zone was seen at and how often. The union of a layout follows from these alone, so
a zone whose first place goes is first seen at the next one, and a zone whose last place goes leaves the union. Layouts lie in
buckets by their key; an update reads and rewrites the buckets of the layouts it touches, and the others stay as they are.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonespark.functions.text import is_digits
from zonespark.operators.zones import layout_facts, zone_facts
from zonespark.plans.ordering import materialise
from zonespark.schemas import LAYOUT_KEY, ZONE

_BUCKETS = 64
_PLACE = (
    "combo STRING, ref_width INT, ref_height INT, x INT, y INT, width INT, height INT, note STRING,"
    " first STRUCT<origin: INT, import_idx: BIGINT, frame_index: INT, ord: BIGINT>"
)
_COLUMNS = {"places": f"{_PLACE}, n BIGINT", "union": _PLACE}


def occurrences(
    images: DataFrame, zones: DataFrame, layouts: DataFrame | None = None, layout_zones: DataFrame | None = None
) -> DataFrame:
    """Every place (first) the zones of each layout are seen at, with `n`, how often. What layout_union unites."""
    facts = zone_facts(images.filter(is_digits(F.col("combo"))), zones).select(*LAYOUT_KEY, *ZONE, "first")
    if layouts is not None:
        facts = facts.unionByName(layout_facts(layouts, layout_zones))
    return facts.groupBy(*LAYOUT_KEY, *ZONE, "first").agg(F.count("*").alias("n"))


def union_of(places: DataFrame) -> DataFrame:
    """The distinct zones of each layout with the first place each is seen at."""
    return places.groupBy(*LAYOUT_KEY, *ZONE).agg(F.min("first").alias("first"))


def net_change(added: DataFrame | None, removed: DataFrame | None) -> DataFrame:
    """Added and removed occurrences as one table, those that cancel out left out."""
    signed = [t.withColumn("n", F.col("n") * sign) for t, sign in ((added, 1), (removed, -1)) if t is not None]
    both = reduce(DataFrame.unionByName, signed)
    return both.groupBy(*LAYOUT_KEY, *ZONE, "first").agg(F.sum("n").alias("n")).filter("n <> 0")


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*LAYOUT_KEY), F.lit(_BUCKETS)).cast("int")


class LayoutStore:
    """The layouts below a path, as the last committed version of each bucket has them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        commits = spark.read.schema("bucket int, version long").parquet(f"{path}/commits").collect()
        # At most as many as there are buckets per version.
        self.version = max(c["version"] for c in commits)
        self.current: dict[int, int] = {}
        for c in commits:
            self.current[c["bucket"]] = max(c["version"], self.current.get(c["bucket"], -1))

    @staticmethod
    def create(spark: SparkSession, path: str, places: DataFrame) -> "LayoutStore":
        _write(spark, path, places, 0, list(range(_BUCKETS)))
        return LayoutStore(spark, path)

    def _read(self, kind: str, buckets: list[int] | None = None) -> DataFrame:
        versions: dict[int, list[int]] = {}
        for bucket, version in self.current.items():
            if buckets is None or bucket in buckets:
                versions.setdefault(version, []).append(bucket)
        # Only directories of the versions that are current are read.
        here = [(F.col("version") == v) & F.col("bucket").isin(b) for v, b in versions.items()]
        rows = self.spark.read.schema(f"{_COLUMNS[kind]}, version long, bucket int").parquet(f"{self.path}/{kind}")
        return rows.filter(reduce(lambda a, b: a | b, here, F.lit(False))).drop("version", "bucket")

    def union(self) -> DataFrame:
        """What layout_union gives for everything added and not removed."""
        return self._read("union")

    def layout(self, combo: str, width: int, height: int) -> DataFrame:
        """One layout of the union; only its bucket is read."""
        key = [F.lit(v).cast(t).alias(c) for c, v, t in zip(LAYOUT_KEY, (combo, width, height), ("string", "int", "int"))]
        bucket = self.spark.range(1).select(*key).select(_bucket().alias("b")).first()["b"]
        same = [F.col(c) == v for c, v in zip(LAYOUT_KEY, (combo, width, height))]
        return self._read("union", [bucket]).filter(reduce(lambda a, b: a & b, same))

    def places(self) -> DataFrame:
        return self._read("places")

    def update(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> "LayoutStore":
        """The store after a batch of occurrences is added and another removed. Removing what is not there is refused.

        An update that runs again after it failed writes the same version once more; what it left behind counts for nothing.
        """
        net = materialise(net_change(added, removed))
        touched = [r["b"] for r in net.select(_bucket().alias("b")).distinct().collect()]
        if not touched:
            return self
        both = self._read("places", touched).unionByName(net)
        after = materialise(both.groupBy(*LAYOUT_KEY, *ZONE, "first").agg(F.sum("n").alias("n")).filter("n <> 0"))
        if not after.filter("n < 0").isEmpty():
            raise ValueError("The batch removes zones that are not there.")
        _write(self.spark, self.path, after, self.version + 1, touched)
        return LayoutStore(self.spark, self.path)


def _write(spark: SparkSession, path: str, places: DataFrame, version: int, buckets: list[int]) -> None:
    """Write buckets as a version of both tables, and commit it. A bucket without rows is committed as empty."""
    # A layout that holds a third of all zones is divided by zone.
    spread = places.withColumn("bucket", _bucket()).repartition("bucket", F.pmod(F.xxhash64(*ZONE), F.lit(8)))
    spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/places/version={version}")
    # From what was written, so that the library behind the places is gone through once.
    written = spark.read.schema(f"{_COLUMNS['places']}, bucket int").parquet(f"{path}/places/version={version}")
    union = union_of(written).withColumn("bucket", _bucket())
    union.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/union/version={version}")
    commit = spark.createDataFrame([(b, version) for b in buckets], "bucket int, version long")
    commit.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/commit={version}")
