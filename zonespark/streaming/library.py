"""A library on disk that grows by batches, looked up at the cost of the batch and not of the library.

Every batch is written as a run: its images in buckets by the first digits of their hash, a Bloom filter per bucket, and a
commit that lists the buckets. A batch that asks which of its contents are known reads the filters of the buckets its hashes fall
in, then only those buckets whose filter may hold one, and compares hashes there. When runs of a level have become
many they are merged into one of the next level, so their number grows with the logarithm of the batches and each
image is rewritten as seldom. A run counts from its commit on; a merged run stands for the runs it covers.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonespark.schemas import IMAGES

#: Runs of a level that are merged into one of the next.
MERGED = 16
#: Images of a bucket, about, and the most digits of the hash that name it.
_BUCKET, _DIGITS = 250_000, 2
#: Bits per image and hash functions of a filter (about one false answer in 400), and bits of a row of it.
_BITS, _HASHES, _ROW = 16, 3, 1 << 15
#: `again` marks the row of a known image that has its source back; the image's own row stands in an older run.
_IMAGES = f"{IMAGES}, again BOOLEAN"
_FILTERS = "bucket STRING, part BIGINT, bits BINARY"
#: Columns that differ from image to image.
_OWN = ["import_idx", "name", "path", "combo", "filename_width", "filename_height", "sample", "bucket"]
_COMMITS = "level INT, first BIGINT, last BIGINT, bucket STRING, images BIGINT, size BIGINT, last_idx BIGINT"


@dataclass(frozen=True)
class Run:
    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"{self.level}-{self.first}-{self.last}"

    def covers(self, other: "Run") -> bool:
        return self.level > other.level and self.first <= other.first and other.last <= self.last


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that batches write below a path; one that no batch has written yet is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        # Any other failure must not pass for an empty table.
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def brief(rows: DataFrame) -> DataFrame:
    """Images as they are exchanged: the hash as bytes, half as long as its digits, and the columns that many images share as one value, which packs as one.

    An id that is no hash stays as it is. `whole` makes images of them again.
    """
    short = F.unhex("image_id")
    hashed = F.coalesce(F.lower(F.hex(short)) == F.col("image_id"), F.lit(False))
    own = [F.col(c) for c in rows.columns if c in _OWN]
    shared = F.struct(*[c for c in rows.columns if c not in _OWN and c != "image_id"]).alias("shared")
    return rows.select(F.when(hashed, short).alias("hash"), F.when(~hashed, F.col("image_id")).alias("id"), *own, shared)


def whole(rows: DataFrame) -> DataFrame:
    own = [c for c in rows.columns if c not in ("hash", "id", "shared")]
    return rows.select(F.coalesce(F.lower(F.hex("hash")), "id").alias("image_id"), *own, "shared.*")


def _bucket(digits: int) -> Column:
    return F.concat(F.lit("x"), F.substring("image_id", 1, digits) if digits else F.lit(""))


def _positions(size: Column) -> Column:
    """The bits of an image in a filter of `size` bits, a power of two."""
    return F.array(*[F.xxhash64(F.lit(i), F.col("image_id")).bitwiseAND(size - 1) for i in range(_HASHES)])


class Library:
    """The runs below a path, or those of the batches before one of them."""

    def __init__(self, spark: SparkSession, path: str, before: int | None = None):
        self.spark, self.path = spark, path
        rows = table(spark, f"{path}/commits", f"{_COMMITS}, run STRING").collect()
        if before is not None:
            rows = [r for r in rows if r["last"] < before]
        runs = {r["run"]: Run(r["level"], r["first"], r["last"]) for r in rows}
        self.live = {name: run for name, run in runs.items() if not any(o.covers(run) for o in runs.values())}
        self.covered = [name for name in runs if name not in self.live]
        self.buckets = [r for r in rows if r["run"] in self.live]
        #: The number the next image gets.
        self.next_idx = max((r["last_idx"] for r in rows if r["last_idx"] is not None), default=-1) + 1

    def _rows(self) -> DataFrame:
        found = table(self.spark, f"{self.path}/images", f"{_IMAGES}, run STRING, bucket STRING")
        return found.filter(F.col("run").isin(list(self.live)))

    def images(self) -> DataFrame:
        """All images, as the batches left them."""
        return _folded(self._rows().drop("run", "bucket")).filter(~F.col("again")).drop("again")

    def may_hold(self, ids: DataFrame) -> list[tuple[str, str]]:
        """(run, bucket) of the buckets whose filter may hold some of the ids (image_id): one answer per bucket, not per image."""
        if not self.buckets:
            return []
        numbered = [(i, r["run"], r["bucket"], r["size"]) for i, r in enumerate(self.buckets)]
        # One row per bucket of a live run: there are at most 256 in each of a logarithmic number of runs.
        places = F.broadcast(self.spark.createDataFrame(numbered, "place int, run string, bucket string, size long"))
        asked = ids.select("image_id", F.explode(F.array(*[_bucket(d) for d in range(_DIGITS + 1)])).alias("bucket"))
        asked = asked.join(places, "bucket").select("place", _positions(F.col("size")).alias("at"))
        asked = asked.select("place", *[F.col("at")[i].alias(f"at{i}") for i in range(_HASHES)])
        filters = table(self.spark, f"{self.path}/filters", f"{_FILTERS}, run STRING").filter(F.col("run").isin(list(self.live)))
        filters = filters.join(places, ["run", "bucket"]).select("place", "part", "bits")
        byte = "cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)"
        # Bit after bit: only what has met one is asked for the next, and neither the ids nor the names of buckets are exchanged for it.
        for i in range(_HASHES):
            rest = [f"at{k}" for k in range(i + 1, _HASHES)]
            here = asked.select("place", F.expr(f"at{i} div {_ROW}").alias("part"), F.expr(f"cast(at{i} % {_ROW} as int)").alias("bit"), *rest)
            asked = here.join(filters, ["place", "part"]).filter(F.expr(f"shiftright({byte}, bit % 8) & 1 = 1")).select("place", *rest)
        return [numbered[r["place"]][1:3] for r in asked.distinct().collect()]

    def near(self, ids: DataFrame) -> DataFrame:
        """image_id and has_source of the rows in the buckets that may hold one of the ids, which are the only ones that are opened."""
        places = self.may_hold(ids)
        if not places:
            return self.spark.createDataFrame([], "image_id string, has_source boolean")
        runs: dict[str, list[str]] = {}
        for run, bucket in places:
            runs.setdefault(run, []).append(bucket)
        here = [(F.col("run") == run) & F.col("bucket").isin(buckets) for run, buckets in runs.items()]
        return self._rows().filter(reduce(lambda a, b: a | b, here)).select("image_id", "has_source")

    def known(self, ids: DataFrame) -> DataFrame:
        """image_id and has_source of those of the ids that the library holds. Opens only the buckets that may hold them."""
        held = self.near(ids).join(ids.select("image_id").distinct(), "image_id", "left_semi")
        return held.groupBy("image_id").agg(F.max("has_source").alias("has_source"))

    def write_run(self, rows: DataFrame, run: Run, last_idx: int | None, n: int) -> None:
        """Write n images (with `again`) as a run and commit it. Writing a run again replaces it."""
        columns = [F.col(c).cast(kind).alias(c) for c, kind in (column.split() for column in _IMAGES.split(","))]
        if not n:
            # A batch that adds nothing is committed all the same, with the last number so far.
            self._commit([(run.level, run.first, run.last, "none", 0, _ROW, last_idx)], run)
            return
        digits = next((d for d in range(_DIGITS) if n <= _BUCKET * 16**d), _DIGITS)
        at = f"{self.path}/images/run={run.name}"
        bucketed = rows.select(*columns, _bucket(digits).alias("bucket"))
        if digits:
            bucketed = whole(brief(bucketed).repartition("bucket")).sortWithinPartitions("bucket", "image_id")
        bucketed.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(at)

        written = self.spark.read.schema(f"{_IMAGES}, bucket STRING").parquet(at)
        power = F.expr(f"shiftleft(cast(1 as bigint), cast(greatest(15, ceil(log2({_BITS} * count(*)))) as int))")
        sizes = written.groupBy("bucket").agg(F.count("*").alias("images"), power.alias("size"))
        commit = [(run.level, run.first, run.last, r["bucket"], r["images"], r["size"], last_idx) for r in sizes.collect()]
        # At most one row per bucket.
        places = F.broadcast(self.spark.createDataFrame(commit, _COMMITS).select("bucket", "size"))
        bits = written.select("bucket", "image_id").join(places, "bucket").select("bucket", F.explode(_positions(F.col("size"))).alias("at"))
        parts = bits.groupBy("bucket", F.expr(f"at div {_ROW}").alias("part")).agg(F.expr(f"bitmap_construct_agg(at % {_ROW})").alias("bits"))
        parts.write.mode("overwrite").parquet(f"{self.path}/filters/run={run.name}")
        self._commit(commit, run)

    def _commit(self, buckets: list[tuple], run: Run) -> None:
        self.spark.createDataFrame(buckets, _COMMITS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/run={run.name}")

    def merge_runs(self) -> "Library":
        """Merge the runs of every level that has become full; the library is returned as it is afterwards."""
        by_level: dict[int, list[Run]] = {}
        for run in self.live.values():
            by_level.setdefault(run.level, []).append(run)
        full = min((level for level, runs in by_level.items() if len(runs) >= MERGED), default=None)
        if full is None:
            return self
        runs = sorted(by_level[full], key=lambda r: r.first)
        merged = Run(full + 1, runs[0].first, runs[-1].last)
        rows = self._rows().filter(F.col("run").isin([r.name for r in runs])).drop("run", "bucket")
        n = sum(r["images"] for r in self.buckets if r["run"] in {m.name for m in runs})
        self.write_run(_folded(rows), merged, self.next_idx - 1, n)
        return Library(self.spark, self.path, merged.last + 1).merge_runs()

    def remove_covered(self) -> list[str]:
        """Delete the runs that merged ones stand for, once nothing reads them any more; their names are returned."""
        jvm = self.spark._jvm
        for name in self.covered:
            for kind in ("commits", "filters", "images"):
                place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/run={name}")
                place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
        return self.covered


def _folded(rows: DataFrame) -> DataFrame:
    """Rows that give an image its source back, put into the image's own row where that is among the rows."""
    own = rows.filter(~F.col("again"))
    if rows.filter("again").isEmpty():
        # Mostly so: images that never lost their source wait for nothing.
        return own
    back = rows.filter("again").select("image_id").distinct().withColumn("_back", F.lit(True))
    held = own.join(back, "image_id", "left").withColumn("has_source", F.col("has_source") | F.coalesce("_back", F.lit(False))).drop("_back")
    waiting = rows.filter("again").join(own.select("image_id"), "image_id", "left_anti").dropDuplicates(["image_id"])
    return held.unionByName(waiting)
