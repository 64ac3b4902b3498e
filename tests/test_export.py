import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tables import LABEL, MAKER, BAND, images, layouts, listed, zones
from zonespark.export_schema import SchemaDefects, validate_export_schema, validate_schema_file
from zonespark.operators import export as X
from zonespark.schemas import DEVICE
from zonespark.sources import documents as O
from zonespark.sources import exchange as E

NOW = "2026-01-01T00:00:00.000Z"


def whole(folder) -> str:
    return "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))


def document(tmp_path, name, *args, **kw):
    path = O.write_export(str(tmp_path / name), *args, **kw)
    text = whole(path)
    value = json.loads(text)
    # Written with two spaces, as any formatter would.
    assert text == json.dumps(value, indent=2, ensure_ascii=False) + "\n"
    return value


def zone(z):
    return dict(zip(("x", "y", "width", "height", "note"), z))


def test_v2_keys_by_device(spark, tmp_path):
    pictures = images(
        spark, {"frame_count": 3}, {"width": 1024, "height": 768}, {"combo": "22", "software": "NL40:V4.0"},
        {"combo": "", "manufacturer": "", "model": None, "sop_class": "", "software": ""}, {"model": "unused"},
        {"combo": "3", "model": ' "NL40\\ ', "software": ""},
    )
    drawn = zones(
        spark,
        {(0, 0): [BAND], (0, 1): [LABEL, BAND], (1, 0): [(*BAND[:2], 670, 40, "ä\n")], (2, 0): [LABEL], (3, 0): [BAND], (5, 0): [(0, 0, 0, 5, "flat")]},
    )
    heads, inner = layouts(spark, ("16", 640, 480, True, [LABEL]), ("22", 640, 480, False, [LABEL]))
    out = document(tmp_path, "v2", "v2", pictures, drawn, NOW, heads, inner)
    assert list(out) == ["schema_version", "generated_at", "annotations"] and out["schema_version"] == 2
    assert [(a["combo_id"], a["software_version"], a["attributes_source"]) for a in out["annotations"]] == [
        ("3", "", "partial"), ("16", "", "imported"), ("16", "NL40:V3.1", "dicom_tags"),
        ("22", "NL40:V4.0", "dicom_tags"), ("", "", "partial"),
    ]
    # A raster whose zones all clip away stays, with none; values pass through as they are.
    assert out["annotations"][0]["model"] == ' "NL40\\ '
    assert out["annotations"][0]["sizes"] == {"640x480": {"ref_width": 640, "ref_height": 480, "zones": []}}
    sizes = out["annotations"][2]["sizes"]
    assert list(sizes) == ["1024x768", "640x480"]
    assert sizes["640x480"]["zones"] == [zone(BAND), zone(LABEL)]
    assert sizes["1024x768"]["zones"][0]["note"] == "ä\n"
    assert document(tmp_path, "other", "nonsense", pictures, drawn, NOW, heads, inner) == out


def test_v1_keys_by_combo_and_round_trips(spark, tmp_path):
    pictures = images(spark, {"combo": "016"}, {"combo": "22"}, {"combo": "9"}, {"combo": "22", "width": 1024, "height": 768})
    drawn = zones(spark, {(0, 0): [BAND, LABEL], (1, 0): [BAND], (2, 0): [LABEL], (3, 0): [(0, 0, 0, 5, "flat")]})
    heads, inner = layouts(spark, ("22", 640, 480, True, [BAND, LABEL]), ("5", 640, 480, False, [LABEL]))
    out = document(tmp_path, "v1", "v1", pictures, drawn, NOW, heads, inner)
    assert list(out) == ["generated_at", "annotations"]
    # Plain integers first in ascending order, then the rest as first seen; sizes without a zone are absent.
    assert list(out["annotations"]) == ["9", "22", "016"]
    assert out["annotations"]["22"] == {"640x480": {"ref_width": 640, "ref_height": 480, "zones": [zone(BAND), zone(LABEL)]}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(out))
    again, zones_again, rejects = E.read_layouts(spark, str(tmp_path / "in"))
    assert rejects.isEmpty() and not again.filter("promoted").count()
    assert listed(again, "combo", order=["layout_idx"]) == ["9", "22", "016"]
    promoted = again.withColumn("promoted", F.lit(True)).drop("file")
    back = document(tmp_path, "back", "v1", pictures.limit(0), drawn.limit(0), NOW, promoted, zones_again.drop("file"))
    assert back == out


def test_v1_needs_a_combo_on_every_annotated_file(spark):
    pictures = images(spark, {}, {"combo": "", "name": "loose.dcm"})
    with pytest.raises(ValueError, match="loose.dcm"):
        X.export_v1(pictures, zones(spark, {(1, 0): [BAND]}), NOW)
    assert X.export_v1(pictures, zones(spark, {(0, 0): [BAND]}), NOW).count() > 3


def counted(spark, *rows):
    return spark.createDataFrame([("g", c, n, i) for i, (c, n) in enumerate(rows)], "g string, combo string, files bigint, first bigint")


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("16", 3), ("22", 1)], "16"), ([("22", 2), ("16", 2)], "16"), ([("", 5), ("16", 1)], ""), ([("", 2), ("16", 2)], "16"),
        ([("016", 2), ("16", 2)], "016"), ([("16", 2), ("016", 2)], "16"),
    ],
)
def test_modal_combo(spark, rows, want):
    assert X.resolve_combo_id(counted(spark, *rows), ["g"]).head().combo_id == want


def test_rows_by_combo_report_mixed_devices(spark):
    pictures = images(spark, {}, {"model": "NL30"}, {"model": "NL30"}, {"combo": "3"})
    drawn = zones(spark, {(i, 0): [BAND] for i in range(4)})
    assert X.export_tables(pictures, drawn).rows.count() == 2
    rows = X.export_tables(pictures, drawn, group_by="combo").rows
    assert listed(rows, "combo_id", "model", "attributes_source", "file_count", "zone_count") == [
        ("16", "NL30", "mixed", 3, 1), ("3", "NL40", "dicom_tags", 1, 1),
    ]
    with pytest.raises(ValueError):
        X.export_tables(pictures, drawn, group_by="sop")


def test_row_order(spark):
    rows = spark.createDataFrame(
        [("", "a", 0), ("10", "b", 1), ("9", "B", 2), ("9", "a", 3), ("9", "A", 4)], "combo_id string, manufacturer string, first int"
    ).select("*", *[F.lit("").alias(c) for c in ("model", "sop_class", "software_version", "group_key")])
    assert [r.first for r in X.sort_export_rows(rows).collect()] == [4, 2, 3, 1, 0]
    assert [r.first for r in X.sort_export_rows(rows, locale=True).collect()] == [3, 4, 2, 1, 0]


def test_conflicts(spark):
    bare = dict.fromkeys(DEVICE, "")
    pictures = images(
        spark, {"name": "a"}, {"name": "b"}, {"name": "odd", "model": "NL30"}, {"combo": "", "model": "X"}, {"model": "unseen"},
        {"name": "c"}, {"name": "d"}, {"combo": "9", "name": "n"}, {"combo": "9", "name": "m", **bare}, {"combo": "7"},
    )
    drawn = zones(spark, {(i, 0): [BAND] for i in range(10) if i != 4})
    conflicts = X.combo_conflicts(pictures, drawn)
    shown = [(r.combo, r.files, r.shown_files) for r in X.sort_conflicts(conflicts).collect()]
    assert shown == [("9", 1, "m"), ("9", 1, "n"), ("16", 4, "a, b, c"), ("16", 1, "odd")]
    report = X.conflict_report(conflicts).orderBy(F.col("combo").cast("int"), "line", F.col("files").desc(), "first_file")
    label = " · ".join(MAKER.values())
    assert [r.text for r in report.collect()] == [
        "Combo 9 holds 2 different device combinations:", "  no device tags — 1 file: m", f"  {label} — 1 file: n",
        "Combo 16 holds 2 different device combinations:", f"  {label} — 4 files: a, b, c, and 1 more",
        f"  {label.replace('NL40 ', 'NL30 ')} — 1 file: odd",
    ]


FLAT = {
    "name": "Rows", "shape": "flat", "root": {"schema_version": 3, "none": None, "half": 0.5},
    "entry": {"combination_id": "combo_id", "image_width": "ref_width", "file_count": "file_count", "9": "size"},
    "entry_constants": {"combination_id": "x", "1": True}, "zones_field": "redaction_zones",
    "zone": {"x": "x", "y": "y", "width": "width", "height": "height"}, "zone_constants": {"label": "Redact"},
}


def test_custom_documents(spark, tmp_path):
    pictures = images(spark, {}, {"width": 1024, "height": 768}, {})
    drawn = zones(spark, {(0, 0): [BAND], (1, 0): [(37, 412, 1, 1, "")], (2, 0): [BAND]})
    flat = validate_export_schema(FLAT, "fixed")
    out = document(tmp_path, "flat", "custom:fixed", pictures, drawn, NOW, schemas=[flat])
    assert list(out) == ["schema_version", "none", "half", "generated_at", "annotations"]
    assert [list(a) for a in out["annotations"]] == [["1", "9", "combination_id", "image_width", "file_count", "redaction_zones"]] * 2
    assert [(a["9"], a["combination_id"], a["1"], a["file_count"]) for a in out["annotations"]] == [("1024x768", "x", True, 1), ("640x480", "x", True, 2)]
    assert out["annotations"][0]["redaction_zones"] == [{"x": 37, "y": 412, "width": 1, "height": 1, "label": "Redact"}]
    nested = validate_export_schema(
        {
            "name": "Nested", "entries_field": "devices", "sizes_field": "rasters", "zones_field": "boxes", "timestamp_field": "",
            "root": {"kind": "k"}, "entry": {"make": "manufacturer"}, "size": {"w": "ref_width", "n": "zone_count"}, "zone": {"left": "x", "label": "note"},
        },
        "n",
    )
    out = document(tmp_path, "nested", "custom:n", pictures, drawn, NOW, schemas=[flat, nested])
    assert out == {
        "kind": "k",
        "devices": [
            {
                "make": "Nordlicht Imaging",
                "rasters": {
                    "1024x768": {"w": 1024, "n": 1, "boxes": [{"left": 37, "label": ""}]},
                    "640x480": {"w": 640, "n": 1, "boxes": [{"left": 16, "label": "headline"}]},
                },
            }
        ],
    }
    with pytest.raises(ValueError, match="No schema given"):
        X.export("custom:gone", pictures, drawn, NOW, schemas=[flat])


OK = {"name": "x", "zone": {"x": "x"}}


@pytest.mark.parametrize(
    "given",
    [
        None, {"zone": {"x": "x"}}, {"name": "x"}, {**OK, "zone": {"x": "left"}}, {**OK, "entry": {"a": "patient_name"}},
        {**OK, "group_by": "sop"}, {**OK, "shape": "tree"}, {**OK, "entry": {"w": "ref_width"}},
        {**OK, "shape": "flat", "size": {"w": "ref_width"}}, {**OK, "root": {"annotations": 1}}, {**OK, "root": {"generated_at": 1}},
        {**OK, "root": {"a": {"b": 1}}}, {**OK, "zone": {" ": "x"}}, {**OK, "zone": ["x"]}, {**OK, "entry_constants": {"": 1}},
        {**OK, "entry": {"a": ["x"]}},
    ],
)
def test_bad_schemas_are_refused(given):
    with pytest.raises(ValueError):
        validate_export_schema(given)


def test_all_defects_are_reported_together():
    with pytest.raises(SchemaDefects) as found:
        validate_export_schema({"shape": "tree", "zone": {}, "entry": {"a": "patient", "": "size"}, "root": {"annotations": []}})
    parts = [d.split(":")[0] for d in found.value.defects]
    assert {"shape", "zone", "entry", "root", "name"} == set(parts) and len(parts) >= 6


def test_schema_defaults_and_files(spark, tmp_path):
    bare = validate_export_schema({**OK, "name": " Bare  " + "n" * 90})
    assert (bare.group_by, bare.shape, bare.entries_field, bare.zones_field, bare.timestamp_field) == ("attributes", "nested", "annotations", "zones", "generated_at")
    assert len(bare.name) == 60 and bare.id
    one = validate_export_schema(FLAT, "fixed")
    path = f"file:{tmp_path}/s"
    O.write_export_schemas(spark, path, [one, one], NOW)
    first, second = E.read_export_schemas(spark, path)
    assert first == one and second.id == "fixed-1" and second.entry == one.entry
    assert [s.id for s in E.read_export_schemas(spark, path, [one])] == ["fixed-1"]
    good = {"format": "any-schema", "version": 1, "schemas": [OK]}
    assert len(validate_schema_file(good)) == 1
    taken = validate_schema_file({**good, "schemas": [{**OK, "id": i} for i in ("a", "a-2", "a", "a")]})
    assert [t.id for t in taken] == ["a", "a-2", "a-3", "a-4"] or len({t.id for t in taken}) == 4
    for bad in ({**good, "format": "other"}, {**good, "version": 2}, {**good, "version": True}, {**good, "schemas": {}}, {**good, "schemas": [{}]}, None):
        with pytest.raises(ValueError):
            validate_schema_file(bad)


def test_export_tables_can_be_written(spark, tmp_path):
    tables = X.export_tables(images(spark, {}), zones(spark, {(0, 0): [BAND, LABEL]}))
    O.write_export_tables(str(tmp_path / "out"), tables)
    assert spark.read.parquet(str(tmp_path / "out" / "zones")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out" / "rows")).head().zone_count == 2
