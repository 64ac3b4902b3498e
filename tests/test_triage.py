import pytest
from pyspark.sql import functions as F

from tables import MAKER, BAND, image_id, images, listed, zones
from zonespark.functions import device as D
from zonespark.operators import triage as T


@pytest.fixture(scope="module")
def library(spark):
    pictures = images(
        spark,
        {"name": "blank.dcm", "path": "batch-a/blank.dcm"}, {"name": "drawn.dcm", "path": "batch-a/drawn.dcm"},
        {"name": "nocombo.dcm", "path": "batch-a/nocombo.dcm", "combo": ""},
        {"name": "gone.dcm", "path": "batch-b/gone.dcm", "has_source": False}, {"name": "odd.dcm", "combo": "abc", "path": None},
    )
    drawn = zones(spark, {(1, 0): [BAND], (1, 1): [BAND, BAND], (2, 0): [BAND], (3, 0): [BAND], (4, 0): [BAND]})
    return pictures, drawn


def test_states_and_counts(library):
    pictures, drawn = library
    found = {s: listed(T.triage_filter(pictures, drawn, s), "import_idx") for s in T.STATES}
    assert found == {
        "all": [0, 1, 2, 3, 4], "unannotated": [0], "annotated": [1, 2, 3, 4], "needs-combo": [2, 4], "source-needed": [3],
    }
    assert tuple(T.filter_counts(pictures, drawn).head()) == (5, 1, 4, 2, 1)
    assert listed(T.box_counts(pictures, drawn), "boxes", order=["import_idx"]) == [0, 3, 1, 1, 1]


def test_search(library):
    pictures, drawn = library
    assert listed(T.search_images(pictures, "batch-b"), "import_idx") == [3]
    assert listed(T.search_images(pictures, " DRAWN "), "import_idx") == [1]
    assert listed(T.search_images(pictures, "16"), "import_idx") == [0, 1, 3]
    assert T.search_images(pictures, "%").isEmpty()
    assert T.search_images(pictures, "  ").count() == 5
    both = T.search_images(T.triage_filter(pictures, drawn, "annotated"), "batch-a")
    assert listed(both, "import_idx") == [1, 2]


def test_review_scope_and_flags(spark, library):
    pictures, drawn = library
    anchor = {"combo": "16", "width": 640, "height": 480}
    assert listed(T.review_scope(pictures, anchor, "size"), "import_idx") == [0, 1, 3]
    assert listed(T.review_scope(pictures, {"combo": None}, "combo"), "import_idx") == [2]
    assert T.review_scope(pictures, None, "combo").count() == 5
    uncovered = spark.createDataFrame([(image_id(2),), (image_id(2),)], "image_id string")
    flags = listed(T.review_flags(pictures, drawn, uncovered), "flags", order=["import_idx"])
    assert flags == [["no zones"], [], ["no combo", "2 uncovered"], ["no source"], ["no combo"]]


def test_groups(spark):
    pictures = images(
        spark, {"combo": "22"}, {"combo": ""}, {"combo": "16", "manufacturer": "", "model": "", "sop_class": "", "software": ""},
        {"combo": "16", "width": 1024, "height": 768}, {"combo": "2"}, {"combo": "16", "software": "other"},
    )
    groups = T.group_library(pictures, zones(spark, {(2, 0): [BAND], (3, 0): [BAND, BAND]}))
    assert listed(T.sort_groups(groups), "combo", "total", "annotated", "size_count", "device_count", "mixed_devices", order=T.library_order()) == [
        ("", 1, 0, 1, 1, False), ("2", 1, 0, 1, 1, False), ("16", 3, 2, 2, 2, True), ("22", 1, 0, 1, 1, False),
    ]
    # The first file that states a device gives the group's device, not the first file.
    assert groups.filter("combo = '16'").head().software == MAKER["software"]
    outline = T.library_rollup(pictures)
    assert [r.row_type for r in T.sort_outline(outline).collect()] == [
        "group", "file", "group", "file", "group", "size", "file", "file", "size", "file", "group", "file",
    ]
    folded = T.library_rollup(pictures, spark.createDataFrame([("16",)], "combo string"))
    assert listed(folded.filter("combo = '16'"), "row_type") == ["group"]


@pytest.mark.parametrize("slices", [1, 3, 8])
def test_queue_and_neighbours(spark, slices):
    pictures = images(spark, *[{"combo": "" if i in (4, 5) else "1"} for i in range(7)])
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        queue = T.review_queue(pictures.filter("import_idx in (0, 1, 4, 5)"))
        rows = listed(queue, "import_idx", "previous", "next", "position", "total", order=["position"])
        assert rows == [(4, None, 5, 1, 4), (5, 4, 0, 2, 4), (0, 5, 1, 3, 4), (1, 0, None, 4, 4)]
        near = T.queue_neighbours(queue, pictures)
        # Previous is the entry drawn last of those before it, next the one drawn first of those after it.
        assert listed(near, "import_idx", "previous", "next", "position", "total") == [
            (2, 1, 4, None, 4), (3, 1, 4, None, 4), (6, 1, None, None, 4),
        ]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_neighbours_go_through_a_slice_once(spark):
    # A frame that ends with the slice is gone through again for every row.
    pictures = images(spark, {}, {}, {})
    near = T.queue_neighbours(T.review_queue(pictures.filter("import_idx = 1")), pictures)
    assert "currentrow$(), unboundedfollowing$()" not in near._jdf.queryExecution().optimizedPlan().toString()
    assert listed(near, "import_idx", "previous", "next") == [(0, None, 1), (2, 1, None)]


def test_combo_assignment(spark):
    pictures = images(spark, {}, {}, {"combo": ""}, {"combo": "22"})
    plan = T.plan_combo_assignment(pictures, " 16 ")
    assert tuple(plan.head()) == ("16", 2, 2, 1, 1, 1, "22")
    text = T.describe_assignment(plan).head().text.split("\n")
    assert text == [
        "Set 2 files to combo 16?", "1 file already carry a different ID (22) and will be overwritten.",
        "2 files already match and stay as they are.", "Combo IDs are not covered by undo.",
    ]
    many = images(spark, *[{"combo": str(c)} for c in (5, 3, 5, 1, 2, 4)])
    assert "(5, 3, 1, 2, …)" in T.describe_assignment(T.plan_combo_assignment(many, "9")).head().text
    assert T.describe_assignment(T.plan_combo_assignment(pictures, "")).head().text.startswith("Clear the combo ID on 3 files?")
    with pytest.raises(ValueError):
        T.plan_combo_assignment(pictures, "1a")
    assert listed(T.assign_combo(pictures, "016"), "combo") == ["016"] * 4


def test_device_text(spark):
    cases = [
        ({**MAKER, "software": "NL40:V4.0"}, "Nordlicht Imaging · NL40 · V4.0"),
        ({**MAKER, "software": "nl40 - V4.0"}, "Nordlicht Imaging · NL40 · V4.0"),
        ({**MAKER, "software": "NL40"}, "Nordlicht Imaging · NL40 · NL40"),
        ({**MAKER, "software": "NL40:"}, "Nordlicht Imaging · NL40 · NL40:"),
        ({**MAKER, "model": "Sonar (7)", "software": "Sonar (7):1.2"}, "Nordlicht Imaging · Sonar (7) · 1.2"),
        ({**MAKER, "model": "", "software": "V4"}, "Nordlicht Imaging · V4"),
        ({**MAKER, "manufacturer": None, "model": "", "software": "", "sop_class": ""}, ""),
    ]
    pictures = images(spark, *[c for c, _ in cases])
    assert listed(pictures.withColumn("l", D.device_label()), "l", order=["import_idx"]) == [want for _, want in cases]
    assert pictures.select(D.device_detail().alias("d")).head().d.endswith(" · Ultrasound Image")
    signed = pictures.filter(D.device_signature().isNull())
    assert listed(signed, "import_idx") == [6]
    assert pictures.filter(D.attributes_source() == "partial").count() == 2


def test_exact_device_values(spark):
    pictures = images(spark, {"model": " NL40 "}, {"model": None})
    assert listed(T.with_device(pictures), "model", order=["import_idx"]) == [" NL40 ", ""]
    assert pictures.select(D.sop_class_name(F.lit(" 1.2.3 ")).alias("n")).head().n == "1.2.3"
    assert "has_source" not in T.image_record(pictures).columns
