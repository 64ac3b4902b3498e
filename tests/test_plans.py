"""What the plans look like: no join without a key, no sort of a whole table in one task, pruned scans."""

import re

import pytest
from pyspark.sql import functions as F

from tables import BAND, detections, image_id, images, listed, zones
from zonespark.catalog.registry import Tables
from zonespark.operators import detect as K
from zonespark.operators import reuse as R
from zonespark.operators import triage as T
from zonespark.operators import zones as Z
from zonespark.plans import ordering as O
from zonespark.schemas import ZONE

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("scope", ["frame", "file"])
def test_coverage_joins_on_keys(spark, scope):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        t = Tables(spark, SF)
        plan = plan_of(K.uncovered(t.det, t.zon, scope))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert re.search(r"(SortMergeJoin|ShuffledHashJoin).*image_id.*LeftAnti", plan)


def test_a_window_without_keys_only_sees_slices(spark):
    t = Tables(spark, SF)
    plan = plan_of(T.review_queue(t.img))
    # The one exchange to a single partition carries a row per slice, after its aggregation.
    single = plan[plan.index("== Physical Plan =="):].count("SinglePartition")
    assert single == 1 and "RangePartitioning" not in plan


def test_union_reads_only_its_columns_and_pushes_the_key_down(spark):
    t = Tables(spark, SF)
    plan = plan_of(Z.layout_for(Z.layout_union(t.img, t.zon), "5", 1024, 768))
    physical = plan[plan.index("== Physical Plan =="):]
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", physical)
    orders = [s for s in schemas if "o_orderkey" in s]
    assert orders and all("o_totalprice" not in s and "o_orderdate" not in s for s in orders)
    # The combo and raster asked for are tested above the scan of the images, below every join and aggregate.
    assert re.search(r"Filter .*o_custkey.* = 5.*", physical)


def test_ranks_do_not_depend_on_the_number_of_slices(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1000).alias("v"))
    for slices in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", slices)
        try:
            ranked = O.with_global_rank(rows, ["v"], "r")
            assert ranked.filter("r <> v").isEmpty() and ranked.count() == 1000
            within = O.with_rank_within(rows, ["k"], ["v"], "r")
            ends = within.groupBy("k").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.count_distinct("r").alias("d"))
            assert ends.filter("lo <> 0 or hi <> n - 1 or d <> n").isEmpty()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_lookup_keeps_every_row_once(spark):
    rows = spark.range(100).select(F.col("id"), F.lit("hot").alias("k")).unionByName(
        spark.createDataFrame([(100, "cold"), (101, "lost")], "id bigint, k string")
    )
    info = spark.createDataFrame([("hot", 1), ("cold", 2), ("unused", 3)], "k string, v int")
    assert O.lookup(rows, info, ["k"], ["id"]).count() == 101
    left = O.lookup(rows, info, ["k"], ["id"], "left")
    assert left.count() == 102 and listed(left.filter("v is null"), "k") == ["lost"]
    assert O.lookup(rows, info, ["k"], ["id"], "left_anti").count() == 1
    assert O.lookup(rows, info, ["k"], ["id"], copies=1).count() == 101
    assert plan_of(O.lookup(rows, info, ["k"], ["id"])).count("_salt") > 0


def test_one_hot_image_gives_the_same_answers(spark):
    """A third of all zones and boxes on one image: split by strip, nothing lost."""
    many = [(i % 600, i * 7 % 460, 20 + i % 30, 10, "n" if i % 2 else "") for i in range(900)]
    boxes = [(x + 2, y + 2, 8, 6, f"t{i}", 50) for i, (x, y, _, _, _) in enumerate(many)]
    pictures = images(spark, {}, {})
    drawn = zones(spark, {(0, 0): many, (1, 0): [BAND]})
    inside = lambda b, z: b[0] >= z[0] and b[1] >= z[1] and b[0] + 8 <= z[0] + z[2] and b[1] + 6 <= z[1] + z[3]
    want = sum(not any(inside(b, z) for z in many) for b in boxes)
    assert K.uncovered(detections(spark, {(0, 0): boxes}), drawn).count() == want
    union = Z.layout_union(pictures, drawn, with_position=True)
    clipped = {(x, y, min(x + w, 640) - x, min(y + h, 480) - y, n) for x, y, w, h, n in many}
    assert union.count() == len(clipped) + 1
    assert T.box_counts(pictures, drawn).filter(F.col("image_id") == image_id(0)).head().boxes == 900


def test_intermediate_tables_go_to_the_folder_the_session_names(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://elsewhere:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        O.shared_folder(Session())
    Conf.get = lambda self, key, default=None: "hdfs://cluster/shared/" if key == "spark.checkpoint.dir" else default
    assert O.shared_folder(Session()) == "hdfs://cluster/shared"


def test_ranks_within_keys_repeat_no_key(spark):
    """A key per row: what is carried between slices is a row per slice, never one per key on the driver."""
    rows = spark.range(5000).select((F.col("id") * 7919 % 1700).alias("k"), F.col("id").alias("v"))
    within = O.with_rank_within(rows, ["k"], ["v"], "r")
    assert "_salt" not in plan_of(within)
    wrong = within.groupBy("k").agg(F.count("*").alias("n"), F.max("r").alias("hi"), F.count_distinct("r").alias("d"))
    assert wrong.filter("hi <> n - 1 or d <> n").isEmpty() and within.count() == 5000


def test_copies_are_planned_without_broadcasts_of_frames(spark, monkeypatch):
    """Stored tables look small by their files; frames and zones are joined by sorting, and no offered zone is shuffled."""
    written = []
    keep = R.materialise
    monkeypatch.setattr(R, "materialise", lambda df: written.append(keep(df)) or written[-1])
    zone = [(i, i, 9, 9, "") for i in range(40)]
    pictures = images(spark, *[{}] * 30)
    drawn = zones(spark, {(0, 0): zone, (1, 0): zone[:3], (2, 0): zone, (3, 0): [BAND]})
    source = drawn.filter(F.col("image_id") == image_id(0)).select(F.lit("s").alias("source_key"), "ord", *ZONE)
    targets = pictures.filter("import_idx > 0").select(F.lit("s").alias("source_key"), "image_id", F.lit(0).alias("frame_index"))
    plan = R.plan_copy(source, targets, drawn)
    # 29 frames and 40 zones make 1,160 offers: what is written is what frames hold of them, and the frames that change.
    assert sorted(w.count() for w in written) == [28, 43]
    new = plan.filter("is_new").groupBy("image_id").agg(F.count("*").alias("n"), F.min("ord").alias("lo"))
    assert {(r.n, r.lo): r["count"] for r in new.groupBy("n", "lo").count().collect()} == {(37, 6): 1, (40, 0): 26, (40, 1): 1}
    assert plan.filter("NOT is_new").count() == 4
    assert "BroadcastHashJoin" not in re.sub(r"_salt|_n\b", "", plan_of(O.join_large(drawn, pictures.select("image_id"), ["image_id"])))
