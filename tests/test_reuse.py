import pytest

from tables import LABEL, BAND, image_id, images, layouts, listed, zones
from zonespark.operators import layouts as L
from zonespark.operators import reuse as R
from zonespark.operators import templates as M
from zonespark.operators import zones as Z
from zonespark.schemas import FRAME, LAYOUT_ZONES, ZONE

KEY = image_id(0)


def frames_of(spark, *pairs):
    return spark.createDataFrame([(image_id(i), f) for i, f in pairs], "image_id string, frame_index int")


def targets_of(spark, *pairs):
    return spark.createDataFrame([(KEY, image_id(i), f) for i, f in pairs], "source_key string, image_id string, frame_index int")


def source_of(spark, *listed_zones):
    return spark.createDataFrame(
        [(KEY, i, *z) for i, z in enumerate(listed_zones)],
        "source_key string, ord bigint, x int, y int, width int, height int, note string",
    )


def test_source_zones_stay_raw(spark):
    given = zones(spark, {(0, 0): [(*LABEL[:4], None), (0, 0, 0, 9, ""), (900, 9, 40, 9, ""), (-5, 0, 20, 9, "edge")]})
    assert listed(R.source_zones(given, images(spark, {})), *ZONE) == [(-5, 0, 20, 9, "edge"), (*LABEL[:4], "")]


def test_targets(spark):
    pictures = images(
        spark, {"frame_count": 3, "open_frame": 1}, {"frame_count": 3, "open_frame": 2}, {"width": 1024, "height": 768},
        {"combo": "22"}, {"combo": None},
    )
    chosen = frames_of(spark, (0, 1))
    here = lambda scope, same=False: listed(R.reuse_targets(pictures, chosen, scope, same), *FRAME)
    assert here("frames") == [(KEY, 0), (KEY, 2)]
    assert here("files") == [(image_id(1), 2), (image_id(3), 0), (image_id(4), 0)]
    assert here("files", True) == [(image_id(1), 2)]
    assert here("files-all-frames", True) == [(image_id(1), 0), (image_id(1), 1), (image_id(1), 2)]
    unassigned = R.reuse_targets(pictures, frames_of(spark, (4, 0)), "files", True)
    assert unassigned.isEmpty()
    with pytest.raises(ValueError):
        R.reuse_targets(pictures, chosen, "everything")


def test_merge_plan(spark):
    drawn = zones(spark, {(0, 0): [BAND], (0, 1): [BAND], (0, 2): [LABEL]})
    targets = targets_of(spark, (0, 1), (0, 2))
    source = source_of(spark, BAND)
    plan = R.plan_copy(source, targets, drawn)
    assert listed(plan, "frame_index", "note", "is_new", order=["ord"]) == [(2, "corner", False), (2, "headline", True)]
    assert tuple(R.price_plan(source, targets, drawn, plan).head()) == (1, 1, 1, 0, 1, 2)
    written = R.apply_plan(drawn, plan)
    assert listed(written, "frame_index", "note") == [(0, "headline"), (1, "headline"), (2, "corner"), (2, "headline")]
    # Once written, the same plan changes nothing.
    assert R.plan_copy(source, targets, written).isEmpty()
    renamed = R.plan_copy(source_of(spark, (*BAND[:4], "name")), targets_of(spark, (0, 1)), drawn)
    assert renamed.filter("is_new").count() == 1
    twice = source_of(spark, LABEL, LABEL)
    price = R.price_plan(twice, targets_of(spark, (0, 1)), drawn, R.plan_copy(twice, targets_of(spark, (0, 1)), drawn))
    assert (price.head().added, price.head().duplicates) == (1, 1)


def test_replace_plan(spark):
    drawn = zones(spark, {(0, 0): [BAND], (0, 1): [LABEL, BAND], (1, 0): [BAND, LABEL], (1, 1): [BAND, LABEL, LABEL], (1, 2): [LABEL]})
    source, everywhere = source_of(spark, BAND, LABEL), targets_of(spark, (0, 1), (0, 2), (1, 0), (1, 1), (1, 2))
    plan = R.plan_copy(source, everywhere, drawn, "replace")
    # Only the frame that holds the same zones in the same order is left out; order and repeats count.
    changed = listed(plan.select(*FRAME).distinct(), *FRAME)
    assert changed == [(image_id(0), 1), (image_id(0), 2), (image_id(1), 1), (image_id(1), 2)]
    assert tuple(R.price_plan(source, everywhere, drawn, plan, "replace").head()) == (8, 4, 2, 6, 0, 10)
    written = R.apply_plan(drawn, plan)
    assert listed(written.filter("frame_index = 2"), "note") == ["corner", "corner", "headline", "headline"]
    nothing = R.plan_copy(source_of(spark).limit(0), targets_of(spark, (0, 1), (0, 2)), drawn, "replace")
    assert listed(nothing, "frame_index", "x") == [(1, None)]
    assert R.apply_plan(drawn, nothing).filter(f"image_id = '{KEY}' and frame_index = 1").isEmpty()


def test_plan_text(spark):
    def text(*row):
        columns = "added bigint, frames bigint, files bigint, replaced bigint, duplicates bigint, offered bigint"
        return R.describe_plan(spark.createDataFrame([row], columns)).head().text

    assert text(2, 1, 1, 0, 0, 2) == "2 boxes into 1 frame across 1 file"
    assert text(1, 2, 2, 3, 1, 2) == "1 box into 2 frames across 2 files · 3 boxes replaced · 1 duplicate skipped"
    assert text(0, 0, 0, 0, 4, 4) == "Every eligible frame already has these boxes."
    assert text(0, 0, 0, 0, 0, 0) == "No eligible destination frames."


def test_copy_previous_frame(spark):
    drawn = zones(spark, {(0, 0): [BAND, (0, 0, 0, 5, "flat")], (0, 1): [LABEL], (0, 2): [LABEL]})
    plan = R.copy_previous_frame(drawn, images(spark, {"frame_count": 3}))
    assert listed(plan, "frame_index", "note", "is_new") == [(1, "corner", False), (1, "headline", True)]


def test_templates(spark):
    pictures = images(spark, {"frame_count": 2}, {"combo": "x"}, {"width": 1024, "height": 768})
    drawn = zones(spark, {(0, 0): [BAND, (5, 5, 0, 9, "")], (1, 0): [LABEL]})
    chosen = spark.createDataFrame(
        [(image_id(0), 0, "  Kelvin  header+corner  "), (image_id(0), 1, "empty"), (image_id(1), 0, "odd"), (image_id(2), 0, " ")],
        "image_id string, frame_index int, name string",
    )
    templates, inner, rejects = M.make_templates(drawn, pictures, chosen, "now")
    assert listed(templates, "name", "combo", "width") == [("Kelvin header+corner", "16", 640), ("odd", "", 640)]
    assert listed(inner, *ZONE) == [BAND, LABEL]
    assert listed(rejects, "reason") == ["Give the template a name.", "This frame has no zones to save."]
    again = M.make_templates(drawn, pictures, chosen, "now")[0]
    assert listed(again, "template_id") == listed(templates, "template_id")

    choices = templates.filter("name <> 'odd'").select("template_id").crossJoin(pictures.select("image_id"))
    targets, refusals = M.template_targets(pictures, templates, choices, "combo")
    assert listed(targets, *FRAME) == [(image_id(0), 0), (image_id(0), 1), (image_id(1), 0)]
    assert listed(refusals, "image_id", "fitting_images") == [(image_id(2), 2)]
    plan = M.plan_template(inner, M.template_targets(pictures, templates, choices, "file")[0], drawn)
    assert listed(plan.filter("is_new"), *FRAME) == [(image_id(0), 1), (image_id(1), 0)]


def test_template_order(spark):
    rows = [("1", "b", "22", 640, 480, ""), ("2", "z", "", 640, 480, ""), ("3", "a", "16", 1024, 480, ""), ("4", "b", "16", 640, 480, ""), ("5", "a", "016", 640, 480, "")]
    templates = spark.createDataFrame(rows, "template_id string, name string, combo string, width int, height int, created_at string")
    assert [r.template_id for r in M.sort_templates(templates).collect()] == ["5", "4", "3", "1", "2"]
    mixed = spark.createDataFrame([(n, n, "", 1, 1, "") for n in "bBaA"], templates.schema)
    assert [r.name for r in M.sort_templates(mixed, locale=True).collect()] == ["a", "A", "b", "B"]


def test_layouts_merge_and_review(spark):
    heads, inner = layouts(spark, ("16", 640, 480, True, [BAND]))
    same = L.merge_layouts(heads, inner, *layouts(spark, ("16", 640, 480, False, [BAND])))
    assert listed(same[0], "combo", "promoted") == [("16", True)] and same[2].head().outcome == "unchanged"
    grown = L.merge_layouts(heads, inner, *layouts(spark, ("16", 640, 480, False, [BAND, LABEL, LABEL]), ("22", 640, 480, False, [BAND, BAND])))
    assert listed(grown[0], "combo", "promoted", "layout_idx") == [("16", False, 0), ("22", False, 2)]
    assert listed(grown[1].filter("combo = '16'"), "note", order=["ord"]) == ["headline", "corner"]
    assert grown[1].filter("combo = '22'").count() == 2
    assert listed(grown[2], "combo", "outcome", "fresh_zones") == [("16", "merged", 1), ("22", "added", 0)]


def test_layout_review_steps(spark):
    heads, inner = layouts(spark, ("16", 640, 480, True, [BAND, LABEL]), ("22", 640, 480, True, [BAND]), ("9", 640, 480, True, [BAND]))
    gone = spark.createDataFrame([("16", 640, 480, 1), ("22", 640, 480, 0)], "combo string, ref_width int, ref_height int, ord bigint")
    left, rest = L.remove_layout_zones(heads, inner, gone)
    assert listed(left, "combo", "promoted") == [("16", False), ("9", True)]
    assert listed(rest, "combo", "note") == [("16", "headline"), ("9", "headline")]
    held = L.set_promotion(heads, gone, False)
    assert listed(L.promoted(held), "combo") == ["9"]
    assert listed(L.discard_layouts(heads, inner, gone)[1], "combo") == ["9"]


def test_preview(spark):
    pictures = images(spark, {"frame_count": 2, "open_frame": 1}, {}, {"combo": ""})
    drawn = zones(spark, {(0, 0): [BAND], (0, 1): [LABEL, (-5, 0, 20, 9, "raw")], (1, 0): [BAND], (2, 0): [LABEL, LABEL]})
    empty = spark.createDataFrame([], LAYOUT_ZONES)
    union = Z.layout_union(pictures, drawn)
    counts = listed(L.preview_counts(pictures, drawn, union), "scope", "zones", "extra", order=["image_id"])
    assert counts == [("union", 3, 2), ("union", 3, 2), ("frame", 2, 0)]
    shown = L.preview_layout(pictures.filter("import_idx = 0"), drawn, union)
    assert listed(shown, "note", "extra") == [("corner", False), ("headline", True), ("raw", True)]
    alone = L.preview_layout(pictures.filter("import_idx = 2"), drawn, union)
    assert listed(alone, "note", "extra") == [("corner", False), ("corner", False)]
    assert empty.isEmpty()
    matched = L.matching_layouts(pictures, layouts(spark, ("16", 640, 480, True, [BAND]))[0])
    assert listed(matched, "import_idx") == [0, 1]


def test_previews_join_counts_to_images_once(spark):
    pictures, drawn = images(spark, {}, {"combo": ""}), zones(spark, {(0, 0): [BAND, BAND], (1, 0): [BAND, BAND]})
    union = spark.createDataFrame([], "combo string, ref_width int, ref_height int, x int, y int, width int, height int, note string")
    counts = L.preview_counts(pictures, drawn, union)
    assert counts._jdf.queryExecution().analyzed().toString().count("Join LeftOuter, (image_id") == 1
    assert listed(counts, "scope", "zones", "extra", order=["image_id"]) == [("union", 0, 0), ("frame", 2, 0)]
