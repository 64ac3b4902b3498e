from pyspark.sql import functions as F

from tables import LABEL, BAND, images, layouts, listed, zones
from zonespark.functions import geometry as G
from zonespark.functions.filenames import parse_filename, size_mismatch
from zonespark.operators import zones as Z
from zonespark.schemas import RECT, ZONE


def test_rounding_goes_up_at_halves(spark):
    values = spark.createDataFrame([(-2.5, -2), (2.5, 3), (419.7, 420), (39.4, 39), (-0.5, 0)], "v double, want int")
    assert values.filter(G.js_round(F.col("v")) != F.col("want")).count() == 0


def test_corner_points_round_and_clamp(spark):
    row = spark.range(1).select(
        G.rect_between(F.lit(800.0), F.lit(600.0), F.lit(-4.0), F.lit(-5.0), F.lit(640), F.lit(480)).alias("a"),
        G.rect_between(F.lit(419.7), F.lit(39.8), F.lit(0.0), F.lit(0.0), F.lit(640), F.lit(480)).alias("b"),
    ).head()
    assert tuple(row.a) == (0, 0, 640, 480) and tuple(row.b) == (0, 0, 420, 40)


def test_clip_drops_what_has_no_area_and_defaults_the_note(spark):
    given = zones(spark, {(0, 0): [(-10, 5, 30, 10, None), (5, 5, 0, 9, "flat"), (900, 5, 40, 9, "out"), (630, 470, 40, 40, "c")]})
    kept = Z.clip_zones(given, images(spark, {}))
    assert listed(kept, *ZONE) == [(0, 5, 20, 10, ""), (630, 470, 10, 10, "c")]
    again = Z.clip_zones(kept, images(spark, {}))
    assert listed(again, *ZONE) == listed(kept, *ZONE)


def test_shift_slides_without_resizing(spark):
    box = zones(spark, {(0, 0): [(10, 10, 420, 40, "corner"), (0, 0, 640, 480, "")]})
    for (dx, dy), want in {(1, -1): (11, 9), (-10, 10): (0, 20), (-99, -99): (0, 0), (999, 999): (220, 440)}.items():
        moved = Z.shift_zones(box, images(spark, {}), dx, dy)
        assert listed(moved, *RECT, order=["ord"]) == [(*want, 420, 40), (0, 0, 640, 480)]


def test_scaled_zones_never_vanish(spark):
    given = zones(spark, {(0, 0): [(320, 240, 160, 120, ""), (0, 0, 2, 1, "")]})
    scaled = Z.scale_zones(given, images(spark, {}), 160, 120)
    assert listed(scaled, *RECT, order=["ord"]) == [(80.0, 60.0, 40.0, 30.0), (0.0, 0.0, 1.0, 1.0)]


def test_filenames(spark):
    names = [
        ("combo016_640x480_s1.dcm", ("016", 640, 480, "1")), ("COMBO2_1x2_S3.PNG", ("2", 1, 2, "3")),
        ("combo1_0x480_s1.dcm", None), ("combo1_640x480_s1.dcm\n", None), ("xcombo1_640x480_s1.dcm", None),
        ("combo1_99999999999999999999x480_s1.dcm", None), ("combo1_9007199254740992x1_s1.ima", None),
    ]
    given = spark.createDataFrame([(n,) for n, _ in names], "name string")
    parsed = [r.p and tuple(r.p) for r in given.select(parse_filename(F.col("name")).alias("p")).collect()]
    assert parsed == [want for _, want in names]
    sizes = images(spark, {"filename_width": 800, "filename_height": 480}, {"filename_width": 640, "filename_height": 480}, {})
    assert listed(sizes.filter(size_mismatch()), "import_idx") == [0]


def test_layout_union_over_frames_files_and_promoted_layouts(spark):
    pictures = images(spark, {"frame_count": 2}, {}, {"width": 1024, "height": 768}, {"combo": "22"}, {"combo": ""})
    drawn = zones(
        spark,
        {
            (0, 0): [BAND], (0, 1): [LABEL, BAND], (1, 0): [(*BAND[:4], "other note"), LABEL, (5, 5, 0, 9, "flat")],
            (2, 0): [BAND], (3, 0): [LABEL], (4, 0): [BAND],
        },
    )
    heads, inner = layouts(spark, ("16", 640, 480, True, [LABEL, (1, 1, 9, 9, "new")]), ("16", 1024, 768, False, [LABEL]))
    union = Z.layout_union(pictures, drawn, heads, inner, with_position=True)
    of = union.filter("combo = '16' and ref_width = 640")
    assert listed(of, "position", "note", order=["position"]) == [
        (0, "headline"), (1, "corner"), (2, "other note"), (3, "new"),
    ]
    lazily = Z.layout_union(pictures, drawn, heads, inner)
    assert listed(Z.layout_for(lazily, "16", 1024, 768), "note") == ["headline"]
    assert Z.layout_for(lazily, "", 640, 480) is None
    assert lazily.filter("combo = ''").isEmpty()


def test_summary_counts_raw_zones(spark):
    pictures = images(spark, {}, {"combo": ""})
    drawn = zones(spark, {(0, 0): [BAND, (5, 5, 0, 9, "")], (1, 0): [LABEL]})
    heads, inner = layouts(spark, ("7", 640, 480, True, [LABEL]), ("8", 640, 480, False, [LABEL]))
    summary = Z.zone_summary(pictures, drawn, heads, inner)
    assert listed(summary, "combo", "zones") == [("", 1), ("16", 2), ("7", 1)]
    assert tuple(Z.summary_totals(summary).head()) == (4, 1, True)


def test_clearing_notes_keeps_geometry(spark):
    drawn = zones(spark, {(0, 0): [BAND, (1, 1, 2, 2, "")]})
    assert Z.count_notes(drawn, drawn).head().notes == 2
    cleared = Z.clear_notes(drawn)
    assert listed(cleared, *ZONE) == [(1, 1, 2, 2, ""), (*BAND[:4], "")]
    assert Z.count_notes(cleared).head().notes == 0
