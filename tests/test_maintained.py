"""Layouts kept up to date, indexed search and stored orders."""

import random

import pytest
from pyspark.sql import functions as F

from tables import BAND, LABEL, detections, image_id, images, layouts, listed, zones
from test_files import tag_file
from zonespark.operators import detect as K
from zonespark.operators import search_index as I
from zonespark.operators import tags as T
from zonespark.operators import triage as R
from zonespark.operators import zones as Z
from zonespark.operators.layout_store import LayoutStore, net_change, occurrences
from zonespark.plans.paged import PagedTable
from zonespark.sources import images as S

FIRST = ["combo", "ref_width", "ref_height", "x", "y", "width", "height", "note", "first"]


def rows(df):
    return sorted(map(str, df.select(*FIRST).collect()))


def test_a_batch_changes_a_stored_union_as_if_it_were_made_anew(spark, tmp_path):
    rng = random.Random(4)
    pictures = images(spark, *[{"combo": rng.choice(["16", "7", "", "07"]), "width": rng.choice([640, 800])} for _ in range(40)])
    drawn = zones(spark, {(i, f): [rng.choice([BAND, LABEL, (i, 1, 5, 5, ""), (-9, 0, 4, 4, "off")]) for _ in range(rng.randrange(4))] for i in range(40) for f in range(2)})
    heads, inner = layouts(spark, ("7", 640, 480, True, [BAND, (1, 1, 2, 2, "")]), ("9", 640, 480, False, [LABEL]))
    held = set(range(25))
    pick = lambda numbers: pictures.filter(F.col("import_idx").isin(sorted(numbers)))
    store = LayoutStore.create(spark, str(tmp_path / "s"), occurrences(pick(held), drawn, heads, inner))
    assert rows(store.union()) == rows(Z.layout_union(pick(held), drawn, heads, inner))
    for gone, come in (({0, 1, 2}, {25, 26}), (set(), {27, 28, 29}), (set(range(3, 20)), set()), ({25}, {0, 1, 30})):
        store = store.update(occurrences(pick(come), drawn) if come else None, occurrences(pick(gone), drawn) if gone else None)
        held = held - gone | come
        assert rows(store.union()) == rows(Z.layout_union(pick(held), drawn, heads, inner))
        assert rows(LayoutStore(spark, str(tmp_path / "s")).union()) == rows(store.union())
    one = store.layout("7", 640, 480)
    assert rows(one) == rows(Z.layout_union(pick(held), drawn, heads, inner).filter("combo = '7' AND ref_width = 640"))


def test_a_zone_whose_first_place_goes_is_first_seen_at_the_next(spark, tmp_path):
    pictures = images(spark, {}, {}, {"combo": "9"})
    drawn = zones(spark, {(0, 0): [BAND, BAND], (1, 0): [LABEL, BAND], (2, 0): [BAND]})
    store = LayoutStore.create(spark, str(tmp_path / "s"), occurrences(pictures, drawn))
    # One of two equal zones of a frame goes: they stood at places of their own.
    last = occurrences(pictures, drawn.filter("image_id = '%s' AND ord = 1" % image_id(0)))
    assert rows(store.update(removed=last).union()) == rows(Z.layout_union(pictures, drawn))
    store = LayoutStore(spark, str(tmp_path / "s")).update(removed=occurrences(pictures, drawn.filter("image_id = '%s' AND ord = 0" % image_id(0))))
    seen = {r.note: r["first"].import_idx for r in store.union().filter("combo = '16'").collect()}
    assert seen == {"headline": 1, "corner": 1}
    with pytest.raises(ValueError, match="not there"):
        store.update(removed=last)
    store = store.update(removed=occurrences(pictures, drawn.filter("image_id = '%s'" % image_id(1))))
    assert {r.combo for r in store.union().collect()} == {"9"}


def test_places_are_gone_through_once_when_they_are_stored(spark, tmp_path):
    places = occurrences(images(spark, {}, {}), zones(spark, {(0, 0): [BAND, LABEL], (1, 0): [BAND]}))
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    store = LayoutStore.create(spark, str(tmp_path / "s"), places.mapInArrow(told, places.schema))
    assert seen.value == places.count() == 3 and store.union().count() == 2


def test_an_update_rewrites_the_buckets_it_touches_and_no_others(spark, tmp_path):
    pictures = images(spark, *[{"combo": str(i)} for i in range(60)])
    drawn = zones(spark, {(i, 0): [BAND] for i in range(60)})
    store = LayoutStore.create(spark, str(tmp_path / "s"), occurrences(pictures.filter("import_idx <> 5"), drawn))
    after = store.update(occurrences(pictures.filter("import_idx = 5"), drawn))
    moved = [b for b in after.current if after.current[b] != store.current[b]]
    assert len(moved) == 1 and after.version == 1
    assert len(list((tmp_path / "s" / "union" / "version=1").glob("bucket=*"))) == 1
    same = occurrences(pictures.filter("import_idx = 5"), drawn)
    assert net_change(same, same).isEmpty() and after.update(same, same) is after


@pytest.mark.parametrize("scope", ["frame", "file"])
def test_boxes_and_zones_of_any_place_and_size(spark, scope):
    rng = random.Random(9)
    at = lambda: (rng.randrange(-50, 700), rng.randrange(-50, 500))
    some = {(i, f): [(*at(), rng.choice([0, 3, 40, 700, 5000]), rng.choice([0, 9, 300, 5000]), "") for _ in range(25)] for i in range(3) for f in range(2)}
    boxes = {(i, f): [(*at(), rng.choice([1, 10, 100, 600]), rng.choice([1, 10, 100]), f"{i} {f} {n}", 50) for n in range(60)] for i in range(3) for f in range(2)}
    inside = lambda b, z: z[0] <= b[0] and z[1] <= b[1] and b[0] + b[2] <= z[0] + z[2] and b[1] + b[3] <= z[1] + z[3]
    want = []
    for (i, f), listed_boxes in boxes.items():
        around = some[i, f] if scope == "frame" else some[i, 0] + some[i, 1]
        want += [b[4] for b in listed_boxes if not any(inside(b, z) for z in around)]
    found = K.uncovered(detections(spark, boxes), zones(spark, some), scope)
    assert listed(found, "text") == sorted(want) and 0 < len(want) < 360


def test_no_zone_is_repeated(spark):
    one = zones(spark, {(0, 0): [(0, 0, 4000, 3000, ""), BAND, LABEL]})
    plan = K.uncovered(detections(spark, {(0, 0): [(1, 1, 2, 2, "t", 50)]}), one)._jdf.queryExecution().optimizedPlan().toString()
    # The only rows made of others are a box's cells.
    assert plan.count("Generate explode") == 1 and "_own" in plan.split("Generate explode")[1].split("\n")[0]


NEEDLES = ["co", "S1", "scan 1", "s1.dcm 16", "nothing here", "É_%", "a" * 40, "combo16_640x480_s2.dcm"]


def test_indexed_images_are_those_of_the_scan(spark, tmp_path):
    pictures = images(spark, *[
        {"name": f"combo{i % 20}_640x480_s{i}.dcm" if i % 3 else f"Scan {i} É_%\\", "path": f"x/{'b' if i % 2 else 'B'}/s{i}.dcm", "combo": str(i % 20) if i % 4 else None} for i in range(200)
    ])
    index = I.index_images(pictures, str(tmp_path / "i"))
    for needle in NEEDLES:
        found, plain = I.search_images_indexed(index, needle), R.search_images(pictures, needle)
        assert found.columns == plain.columns and listed(found, "import_idx") == listed(plain, "import_idx"), needle
    # Few slices are read for a needle that few rows hold.
    few = index.candidates("_s199.dcm")
    slices = [r["_slice"] for r in few.select("_slice").distinct().collect()]
    assert few.count() <= 3 and len(slices) < 8
    assert index.candidates("nothing here").isEmpty() and index.candidates("co") is None
    assert I.index_images(pictures.limit(0), str(tmp_path / "none")).rows(None).isEmpty()


def test_indexed_tags_are_those_of_the_scan(spark, tmp_path):
    files = spark.createDataFrame([(f"{i}.dcm", bytearray(tag_file() + bytes(i))) for i in range(3)], "path string, content binary")
    tags, _ = S.read_tags(files)
    index = I.index_tags(tags, str(tmp_path / "t"))
    for query in ("", "(0010,0010)", "x00100010", "ZOË", "no matching tag", "pn", "0011"):
        for filter in ("all", "private") if query else ("sequences",):
            found, plain = I.search_tags_indexed(index, query, filter), T.search_tags(tags, query, filter)
            assert listed(found, "image_id", "row_idx") == listed(plain, "image_id", "row_idx"), (query, filter)


def test_pages_and_neighbours_of_a_stored_order(spark, tmp_path):
    pictures = images(spark, *[{"combo": str(i * 7 % 20) if i % 5 else "", "width": 640 + i % 2} for i in range(95)])
    queue = R.write_queue(pictures, str(tmp_path / "q"))
    whole = listed(R.review_queue(pictures), "image_id", "position", "total", order=["position"])
    assert queue.total == 95 and PagedTable(spark, str(tmp_path / "q")).total == 95
    for page in (0, 3, 4, 5):
        found = R.queue_page(queue, page, 20)
        assert [tuple(r) for r in found.select("image_id", "position", "total").collect()] == whole[page * 20 : page * 20 + 20]
    assert [r.image_id for r in queue.around(0).collect()] == [i for i, _, _ in whole[:2]]
    assert [r.image_id for r in queue.around(50, 2).collect()] == [i for i, _, _ in whole[48:53]]
    # One page lies in one slice or two, and no other is read.
    plan = queue.page(2, 5)._jdf.queryExecution().executedPlan().toString()
    needed = {s["_slice"] for s in queue.slices if s["first"] <= 14 and s["first"] + s["n"] > 10}
    assert "PartitionFilters" in plan and len(needed) <= 2
    order = R.DISPLAY_ORDER
    for r in R.display_order(pictures).filter("import_idx % 31 = 0").collect():
        key = {c: r[c] for c in order}
        assert whole[queue.position_of(key)][0] == r["image_id"]
    assert queue.position_of({c: (10**9 if c == "import_idx" else r[c]) for c in order}) is None


def test_empty_tables_are_stored_and_read(spark, tmp_path):
    pictures = images(spark, {}).limit(0)
    queue = R.write_queue(pictures, str(tmp_path / "q"))
    assert queue.total == 0 and R.queue_page(queue, 0, 10).isEmpty() and queue.around(3).isEmpty() and queue.position_of({}) is None
    store = LayoutStore.create(spark, str(tmp_path / "s"), occurrences(pictures, zones(spark, {(0, 0): [BAND]})))
    assert store.union().isEmpty() and store.layout("1", 2, 3).isEmpty()
    one = images(spark, {})
    assert store.update(occurrences(one, zones(spark, {(0, 0): [BAND]}))).union().count() == 1
