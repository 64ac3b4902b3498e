import random

import pytest
from pyspark.sql import functions as F

from tables import BAND, detections, image_id, images, listed, zones
from zonespark.functions.merge import join_boxes
from zonespark.functions.text import clean_text, readable
from zonespark.operators import detect as K
from zonespark.operators import export as X
from zonespark.schemas import OCR_RAW, RECT, ZONE
from zonespark.sources import documents as O


def box(x0, y0, x1, y1):
    return {"x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1)}


def region(edges, text="ALDER FOX", confidence=71.0, **children):
    return {"bbox": edges and box(*edges), "text": text, "confidence": confidence, **children}


LINES = [
    region((32, 24, 150, 48), "ALDER FOX", 77.0, words=[region((32, 24, 84, 48), "ALDER", 79.0), region((102, 24, 150, 48), "FOX", 75.0)]),
    region((32, 130, 260, 156), "BED 12", 66.0, words=[region((32, 130, 90, 156), "BED", 68.0), region((112, 130, 260, 156), "12", 64.0)]),
]
BLOCKS = [region((32, 24, 260, 156), paragraphs=[region((32, 24, 260, 156), lines=LINES)])]


def ocr(spark, *runs, scale=1.0):
    """Runs as (blocks, lines) of image 0, one frame each."""
    rows = [(image_id(0), i, scale, blocks, lines) for i, (blocks, lines) in enumerate(runs)]
    return spark.createDataFrame(rows, OCR_RAW)


def found(spark, runs, scale=1.0, granularity="line", **settings):
    cfg = K.validate_settings({"padding": 0, "granularity": granularity, **settings})
    regions = K.extract_regions(ocr(spark, *runs, scale=scale), cfg.granularity)
    return K.detections(regions, images(spark, {"frame_count": 9}), cfg)


def test_levels(spark):
    counts = {g: K.extract_regions(ocr(spark, (BLOCKS, None)), g).count() for g in K.GRANULARITIES}
    assert counts == {"word": 4, "line": 2, "paragraph": 1, "block": 1}
    flat = ocr(spark, (None, LINES[:1]), (None, None), ([], LINES))
    assert listed(K.extract_regions(flat), "frame_index", "text", order=["frame_index", "region_ord"]) == [
        (0, "ALDER FOX"), (2, "ALDER FOX"), (2, "BED 12"),
    ]
    assert K.extract_regions(flat, "word").isEmpty()


def test_padding_size_and_text_floors(spark):
    line = lambda *edges, text="WARD": (None, [region(edges, text)])
    assert listed(found(spark, [line(50, 60, 170, 84)]), *RECT) == [(50, 60, 120, 24)]
    assert listed(found(spark, [line(50, 6, 170, 30)], padding=9), *RECT) == [(41, 0, 138, 39)]
    assert listed(found(spark, [line(610, 455, 640, 480)], padding=20), *RECT) == [(590, 435, 50, 45)]
    speck = [(None, [region((33, 33, 38, 38), "b4"), region((80, 90, 240, 118), "WARD")])]
    assert found(spark, speck, min_width=0, min_height=0).count() == 2
    assert found(spark, speck, min_width=15).count() == 1
    assert found(spark, [line(5, 5, 60, 30, text="3")]).isEmpty()
    assert found(spark, [line(5, 5, 60, 30, text="3")], min_chars=1).count() == 1
    assert found(spark, [line(5, 5, 60, 30, text="-- |")], min_chars=1).isEmpty()
    assert found(spark, [(None, [region(None)])]).isEmpty()


def test_scale_is_divided_out_and_equal_rectangles_collapse(spark):
    runs = [(None, [region((21, 20, 400, 60), "first", 80.5), region((21, 20, 400, 60), "second", 99.0)])]
    assert listed(found(spark, runs, scale=2.0), *RECT, "text", "confidence") == [(11, 10, 189, 20, "first", 81)]


def test_text_rules(spark):
    odd = chr(0xA0) + "a " + chr(0xFEFF) + "\t b\n" + "x" * 90
    row = spark.createDataFrame([(odd,)], "s string").select(clean_text(F.col("s")).alias("c"), readable(F.col("s"), 92).alias("r")).head()
    assert row.c == ("a b " + "x" * 90)[:80] and row.r


def test_settings_and_profiles():
    assert K.validate_settings({"granularity": "sentence", "padding": 999, "confidence": "x"}) == K.Settings(padding=40)
    assert K.validate_settings({"padding": 2.5, "min_chars": 0, "scale": float("inf")}) == K.Settings(padding=3, min_chars=1)
    assert K.same_settings({}, K.Settings()) and not K.same_settings({"padding": 1}, {})
    names = [n for n, _ in K.validate_profiles([{"name": " A "}, {"name": "a"}, {"name": ""}, 5, {"name": "b" * 50}])]
    assert names == ["A", "b" * 40]
    assert len(K.validate_profiles([{"name": str(i)} for i in range(30)])) == 24
    assert K.validate_profiles(None) == []


def test_merging(spark):
    words = found(spark, [(BLOCKS, None)], granularity="word")
    assert K.merge_boxes(words, 0).count() == 4
    joined = K.merge_boxes(words, 22)
    assert listed(joined, *RECT, "text", "confidence") == [(32, 130, 228, 26, "BED 12", 64), (32, 24, 118, 24, "ALDER FOX", 75)]
    assert K.merge_boxes(words, 90).count() == 1
    assert K.merge_boxes(words.limit(0), 10).isEmpty()


def apart(a, b):
    """Clear space between two boxes on the axis where there is more of it; negative where they overlap on both."""
    return max(max(a[c], b[c]) - min(a[c] + a[c + 2], b[c] + b[c + 2]) for c in (0, 1))


def scattered(seed, count, side):
    rng = random.Random(seed)
    return [
        (rng.randrange(side), rng.randrange(side), rng.randrange(6, 30), rng.randrange(6, 30), f"t{i}", rng.randrange(100))
        for i in range(count)
    ]


def check_joined(boxes, joined, gap):
    """What joining promises: nothing near is left, every box is in one result, and results are their members' bounds."""
    for i, a in enumerate(joined):
        assert all(apart(a, b) > gap for b in joined[i + 1 :])
    home = {t: n for n, j in enumerate(joined) for t in j[4].split()}
    members = [[b for b in boxes if home[b[4]] == n] for n in range(len(joined))]
    assert sum(map(len, members)) == len(boxes)
    for j, own in zip(joined, members):
        x, y = min(b[0] for b in own), min(b[1] for b in own)
        assert j[:4] == (x, y, max(b[0] + b[2] for b in own) - x, max(b[1] + b[3] for b in own) - y)
        assert j[5] == min(b[5] for b in own)


def joined_locally(boxes, gap):
    columns = list(zip(*boxes))
    out = join_boxes(range(len(boxes)), *columns, gap)
    return [tuple(b[c] for c in ("x", "y", "width", "height", "text", "confidence")) for b in out]


@pytest.mark.parametrize("seed", range(40))
def test_joining_leaves_nothing_near_and_loses_nothing(seed):
    boxes = scattered(seed, 30, 900)
    check_joined(boxes, joined_locally(boxes, 5), 5)


def test_the_first_near_box_is_taken_first():
    # The third box is near the first only; the second is near the third once that has grown.
    boxes = [(0, 0, 10, 10, "a", 50), (60, 0, 10, 10, "b", 40), (14, 0, 40, 10, "c", 60)]
    assert joined_locally(boxes, 6) == [(0, 0, 70, 10, "a c b", 40)]
    assert joined_locally([(0, 0, 10, 10, "a", 50), (17, 0, 10, 10, "b", 40)], 6) == [(0, 0, 10, 10, "a", 50), (17, 0, 10, 10, "b", 40)]
    assert joined_locally([(0, 0, 10, 10, "a", 50), (16, 16, 10, 10, "b", 40)], 6) == [(0, 0, 26, 26, "a b", 40)]


def test_frames_are_cut_into_islands_without_changing_the_result(spark):
    frames = {(0, f): scattered(f, 60, 400 + 200 * f) for f in range(4)}
    frames[(1, 0)] = scattered(9, 5, 300)
    got = listed(K.merge_boxes(detections(spark, frames), 4), "image_id", "frame_index", *RECT, "text", "confidence")
    want = [(image_id(i), f, *b) for (i, f), boxes in frames.items() for b in joined_locally(boxes, 4)]
    assert got == sorted(want, key=lambda v: (str(type(v)), str(v)))


@pytest.mark.parametrize("count, side", [(10, 100), (5_000, 4_000), (20_000, 9_000)])
def test_one_frame_of_any_size_is_joined_alike(spark, count, side):
    boxes = list({b[:4]: b for b in scattered(7, count, side)}.values())
    got = listed(K.merge_boxes(detections(spark, {(0, 0): boxes}), 1), *RECT, "text", "confidence", order=["ord"])
    assert got == joined_locally(boxes, 1)


def test_order_of_input_does_not_change_rectangles(spark):
    boxes = scattered(3, 40, 250)
    turned = list(reversed(boxes))
    a = K.merge_boxes(detections(spark, {(0, 0): boxes}), 6)
    b = K.merge_boxes(detections(spark, {(0, 0): turned}), 6)
    assert listed(a, *RECT, "confidence") == listed(b, *RECT, "confidence")


def test_floor_comes_before_merging(spark):
    boxes = detections(
        spark, {(0, 0): [(40, 20, 110, 22, "EAST", 70), (165, 20, 90, 22, "WING", 81), (40, 48, 400, 22, "~~~", 12)]}
    )
    shown = K.visible_detections(boxes, K.Settings(merge_gap=18))
    assert listed(shown, *RECT) == [(40, 20, 215, 22)]
    assert K.visible_detections(boxes, K.Settings()).count() == 2


def test_coverage_needs_one_whole_zone(spark):
    boxes = detections(spark, {(0, 0): [(100, 100, 100, 20, "a", 90), (0, 0, 10, 10, "b", 90), (5, 470, 10, 10, "c", 10)]})

    def left(*listed_zones, scope="frame", frame=0):
        return listed(K.uncovered(boxes, zones(spark, {(0, frame): list(listed_zones)}), scope), "text")

    assert left((90, 90, 120, 40, ""), (0, 0, 20, 20, "")) == ["c"]
    assert left((100, 100, 99, 20, "")) == ["a", "b", "c"]
    assert left((100, 100, 50, 20, ""), (150, 100, 50, 20, "")) == ["a", "b", "c"]
    assert left((100, 100, 100, 20, ""), (0, 400, 640, 80, "")) == ["b"]
    assert left((-50, -50, 900, 900, "")) == []
    assert left((0, -(2**30), 640, 2**31 - 2, "")) == []
    assert left((0, 0, 640, 480, ""), frame=1) == ["a", "b", "c"]
    assert left((0, 0, 640, 480, ""), frame=1, scope="file") == []
    report = K.coverage_report(boxes, zones(spark, {(0, 0): [(0, 0, 20, 20, "")]}), 60)
    assert tuple(report.head()) == (image_id(0), 0, 2, 1, 1)


def test_coverage_against_brute_force(spark):
    rng = random.Random(5)
    boxes = {(0, f): scattered(f, 80, 460) for f in range(2)}
    drawn = {(0, f): [(rng.randrange(-20, 600), rng.randrange(-20, 460), rng.randrange(0, 200), rng.randrange(0, 200), "") for _ in range(60)] for f in range(2)}
    inside = lambda b, z: b[0] >= z[0] and b[1] >= z[1] and b[0] + b[2] <= z[0] + z[2] and b[1] + b[3] <= z[1] + z[3]
    want = sorted((f, i) for (_, f), listed_boxes in boxes.items() for i, b in enumerate(listed_boxes) if not any(inside(b, z) for z in drawn[(0, f)]))
    got = K.uncovered(detections(spark, boxes), zones(spark, drawn))
    assert sorted((r.frame_index, r.ord) for r in got.collect()) == want


def test_zones_of_images_without_boxes_are_left_out_first(spark):
    boxes = detections(spark, {(0, 0): [(20, 8, 30, 10, "A", 90), (600, 8, 30, 10, "B", 90)], (1, 0): [(20, 8, 30, 10, "C", 90)]})
    left = K.uncovered(boxes, zones(spark, {(0, 0): [BAND], **{(i, 0): [BAND] for i in range(2, 9)}}))
    assert listed(left, "text") == ["B", "C"]
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    # Once by image, before zones are grouped, and once by cell.
    assert plan.count("Join LeftSemi") == 2


def test_cells_are_the_smallest_that_hold_a_rectangle(spark):
    rng = random.Random(17)
    rows = [tuple(sorted(rng.randrange(-3000, 9000) for _ in range(2))) for _ in range(300)] + [(a, a + rng.randrange(80)) for a in range(-200, 200, 3)]
    rows = [(*a, *b) for a, b in zip(rows, reversed(rows))] + [(5, 5, 7, 7), (0, 2**31 - 1, 0, 1), (-(2**31), -(2**31) + 1, 0, 1)]
    table = spark.createDataFrame(rows, "x0 int, x1 int, y0 int, y1 int")
    size = K._smallest_cell(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    found = table.select("*", size.alias("size"), K._cell(F.col("x0"), size).alias("across")).collect()
    for x0, x1, y0, y1, size, across in found:
        holding = [c for c in K._CELLS if all((a + K._SHIFT) >> c == (b + K._SHIFT) >> c for a, b in ((x0, x1), (y0, y1)))]
        assert (size, across) == ((holding[0], (x0 + K._SHIFT) >> holding[0]) if holding else (K._EVERYWHERE, 0))


def test_accepting_never_carries_text(spark):
    boxes = detections(spark, {(0, 0): [(72, 90, 150, 24, "ALDER^FOX 12", 74)], (0, 1): [(3, 3, 30, 18, "ELM", 80)]})
    drawn = zones(spark, {(0, 0): [BAND]})
    after, resolved = K.accept_detections(boxes, drawn)
    assert after.columns == drawn.columns
    assert listed(after, *ZONE) == [BAND, (3, 3, 30, 18, "detected text"), (72, 90, 150, 24, "detected text")]
    assert listed(after.filter("frame_index = 0"), "note", order=["ord"]) == ["headline", "detected text"]
    assert K.drop_resolved(boxes, resolved).isEmpty()
    assert "ALDER" not in str(after.collect())
    marked = found(spark, [(BLOCKS, None)]).select("image_id", "frame_index", "ord", *RECT, F.col("text").alias("note"))
    for hidden in (marked, marked.withColumnRenamed("note", "label"), K.merge_boxes(found(spark, [(BLOCKS, None)]), 30).withColumnRenamed("text", "note")):
        with pytest.raises(ValueError, match="recognised text"):
            O.refuse_text(hidden)
    O.refuse_text(after, K.to_zones(boxes), None)
    for write in (
        lambda: O.write_export("/tmp/none", "v2", images(spark, {}), boxes, "now"),
        lambda: O.write_backup("/tmp/none", images(spark, {}), boxes, "now"),
        lambda: O.write_templates("/tmp/none", drawn, boxes, "now"),
        lambda: O.write_export_tables("/tmp/none", X.ExportTables(drawn, drawn, boxes)),
    ):
        with pytest.raises(ValueError, match="recognised text"):
            write()


def test_profile_sweep(spark):
    profiles = [
        {"name": "words", "settings": {"granularity": "word", "padding": 0}},
        {"name": "joined", "settings": {"granularity": "word", "padding": 0, "merge_gap": 25}},
        {"name": "strict", "settings": {"confidence": 70}},
    ]
    sweep = K.profile_sweep(ocr(spark, (BLOCKS, None)), images(spark, {}), zones(spark, {(0, 0): [(0, 0, 640, 60, "")]}), profiles)
    assert listed(sweep, "profile", "detected", "uncovered", "below_floor") == [("joined", 2, 1, 0), ("strict", 1, 0, 1), ("words", 4, 2, 0)]
    with pytest.raises(ValueError):
        K.profile_sweep(ocr(spark, (BLOCKS, None)), images(spark, {}), zones(spark, {(0, 0): [BAND]}), [])
