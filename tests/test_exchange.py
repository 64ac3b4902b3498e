import json
from pathlib import Path

import pytest

from tables import LABEL, BAND, image_id, images, listed, zones
from zonespark import schemas as S
from zonespark.operators import templates as M
from zonespark.schemas import ZONE
from zonespark.sources import documents as O
from zonespark.sources import exchange as E

NOW = "2026-01-01T00:00:00.000Z"


def whole(folder):
    text = "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))
    value = json.loads(text)
    assert text == json.dumps(value, indent=2, ensure_ascii=False) + "\n"
    return value


def files(spark, **texts):
    rows = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in texts.items()]
    return spark.createDataFrame(rows, "path string, text string")


def zone(z=BAND, **change):
    return {**dict(zip(("x", "y", "width", "height", "note"), z)), **change}


def layout(*listed_zones, combo="16", size="640x480", **change):
    return {"annotations": {combo: {size: {"ref_width": 640, "ref_height": 480, "zones": list(listed_zones), **change}}}}


def test_layouts_keep_order_and_read_whole_floats(spark):
    text = '{"annotations":{"016":{"640x480":{"ref_width":640.0,"ref_height":480,"zones":[{"x":16,"y":4,"width":3.52e2,"height":36,"note":"a"}]}},' \
        '"9":{"640x480":{"ref_width":640,"ref_height":480,"zones":[]},"10x10":{"ref_width":10,"ref_height":10,"zones":[{"x":0,"y":0,"width":1,"height":1,"note":""}]}},' \
        '"10":{"640x480":{"ref_width":1,"ref_height":1,"zones":[]}},"10":{"8x8":{"ref_width":8,"ref_height":8,"zones":[{"x":1,"y":1,"width":1,"height":1,"note":""}]}}}}'
    heads, inner, rejects = E.parse_layouts(files(spark, a=text))
    assert rejects.isEmpty()
    # Integer keys first; of a repeated key the last value counts; rasters without zones are left out.
    assert listed(heads, "combo", "ref_width", order=["layout_idx"]) == [("9", 10), ("10", 8), ("016", 640)]
    assert listed(inner.filter("combo = '016'"), *ZONE) == [(16, 4, 352, 36, "a")]
    assert listed(heads, "promoted") == [False] * 3


@pytest.mark.parametrize(
    "bad, reason",
    [
        ("{}", "Not an annotations file"), ("nope", "Not an annotations file"), ('{"annotations":[1]}', "Not an annotations file"),
        (layout(combo="abc"), "Invalid combo ID"), (layout(combo="16 "), "Invalid combo ID"), ({"annotations": {"16": 5}}, "Invalid sizes"),
        (layout(size="640-480"), "Invalid size key"), (layout(zone(), ref_width=800), "disagree"), (layout(zone(), ref_width="640"), "disagree"),
        ({"annotations": {"16": {"640x480": {"ref_width": 640, "ref_height": 480}}}}, "Missing zones"),
        (layout(zone(), zones={"a": 1}), "Missing zones"), (layout(zone(width=900)), "outside"), (layout(zone(x=-1)), "outside"),
        (layout(zone(width=0)), "outside"), (layout(zone(x=1.5)), "Invalid rectangle"), (layout(zone(x="1")), "Invalid rectangle"),
        (layout(zone(note=5)), "Invalid rectangle"), (layout({"x": 0, "y": 0, "width": 1, "height": 1}), "Invalid rectangle"),
        (json.dumps(layout(zone())) + " junk", "Not an annotations file"), (json.dumps(layout(zone())) * 2, "Not an annotations file"),
        (json.dumps(layout(zone())) + "," + json.dumps(layout(zone())), "Not an annotations file"),
        (json.dumps(layout(zone())) + "] [{", "Not an annotations file"), (json.dumps(layout(zone())) + "} {", "Not an annotations file"),
        (layout(7), "Invalid rectangle"), (layout(None), "Invalid rectangle"), (layout(), "no zones"), ('{"annotations":{}}', "no zones"),
    ],
)
def test_bad_layout_files_are_refused_whole(spark, bad, reason):
    heads, inner, rejects = E.parse_layouts(files(spark, bad=bad, good=layout(zone(LABEL), combo="7")))
    assert [(r.path, reason in r.reason) for r in rejects.collect()] == [("bad", True)]
    assert listed(heads, "combo") == ["7"] and listed(inner, "note") == ["corner"]


def image(**change):
    return {
        "id": "a" * 64, "name": "s.dcm", "kind": "DICOM", "combo": "016", "width": 640, "height": 480, "frameCount": 2,
        "frames": {"1": [zone(LABEL)], "0": [zone(), zone(LABEL)]}, **change,
    }


def backup(*listed_images, **change):
    return {"format": "any-project", "version": 1, "images": list(listed_images), **change}


def test_backup(spark):
    rich = image(
        id="b" * 64, path="p/s.dcm", frameIndex=1, sample="4", filenameWidth=800, metadata={"manufacturer": "MAKER", "sopClass": "1.2", "bits": 16},
        display={"windowWidth": 0.5, "windowCenter": -3.5, "invert": 1}, combo="", frames={},
    )
    sources = spark.createDataFrame([("b" * 64,)], "image_id string")
    found, drawn, rejects = E.parse_backup(files(spark, a=backup(image(frameIndex=9), rich)), sources)
    assert rejects.isEmpty()
    a, b = found.orderBy("import_idx").collect()
    assert (a.combo, a.path, a.open_frame, a.has_source, a.invert, a.manufacturer) == ("016", "s.dcm", 0, False, False, "")
    assert (b.path, b.open_frame, b.has_source, b.invert, b.window_width, b.window_center) == ("p/s.dcm", 1, True, True, None, -3.5)
    assert (b.filename_width, b.sop_class, b.bits, b.sample) == (800, "1.2", 16, "4")
    assert listed(drawn, "frame_index", "ord", "note", order=["frame_index", "ord"]) == [(0, 0, "headline"), (0, 1, "corner"), (1, 0, "corner")]


@pytest.mark.parametrize(
    "bad, reason",
    [
        (backup(image(), format="other"), "Not a supported"), (backup(image(), version=2), "Not a supported"), (backup(images=5), "Not a supported"),
        (backup(image(id="A" * 64)), "identifier"), (backup(image(), image()), "identifier"), (backup(5), "identifier"),
        (backup(image(kind="JPG")), "image information"), (backup(image(name=5)), "image information"), (backup(image(width=0)), "image information"),
        (backup(image(frameCount=1.5)), "image information"), (backup(image(combo="x")), "combo"), (backup(image(combo=None)), "combo"),
        (backup(image(frames=[])), "Missing frame"), (backup(image(frames={"01": []})), "frame index"), (backup(image(frames={"2": []})), "frame index"),
        (json.dumps(backup(image())) + "x", "supported"), (json.dumps(backup(image())) * 2, "supported"),
        (json.dumps(backup(image())) + "] [", "supported"), (json.dumps(backup(image())) + "," + json.dumps(backup(image())), "supported"),
        (backup(image(frames={"0": 5})), "frame index"), (backup(image(frames={"0": [zone(width=1000)]})), "outside"),
        (backup(image(frames={"0": [zone(x=0.5)]})), "rectangle"),
    ],
)
def test_bad_backups_are_refused_whole(spark, bad, reason):
    found, drawn, rejects = E.parse_backup(files(spark, bad=bad, good=backup(image(id="c" * 64))))
    assert [(r.path, reason in r.reason) for r in rejects.collect()] == [("bad", True)]
    assert listed(found, "image_id") == ["c" * 64] and drawn.count() == 3


def test_backup_round_trip(spark, tmp_path):
    pictures = images(spark, {"frame_count": 2, "open_frame": 1, "filename_width": 5}, {"name": 'q"\\é', "kind": "PNG"})
    drawn = zones(spark, {(0, 0): [BAND, LABEL], (0, 1): [LABEL]})
    O.write_backup_document(str(tmp_path / "out"), pictures, drawn, NOW)
    value = whole(tmp_path / "out")
    assert value["format"] == "zonespark-project" and [list(i["frames"]) for i in value["images"]] == [["0", "1"], []]
    (tmp_path / "in.json").write_text(json.dumps(value))
    found, again, rejects = E.read_backup(spark, str(tmp_path / "in.json"), pictures.select("image_id"))
    assert rejects.isEmpty()
    columns = ["image_id", "import_idx", "name", "path", "combo", "width", "frame_count", "filename_width", "open_frame", "kind", "has_source", "software", "modality"]
    assert listed(found, *columns) == listed(pictures, *columns)
    assert listed(again, "image_id", "frame_index", "ord", *ZONE) == listed(drawn, "image_id", "frame_index", "ord", *ZONE)


def test_records_of_many_files_read_back(spark, tmp_path):
    many = [{"frame_count": 2, "name": f'n"{i}é\n', "filename_width": i or None, "combo": str(i % 3)} for i in range(40)]
    pictures = images(spark, *many)
    drawn = zones(spark, {(i, i % 2): [BAND, LABEL][: i % 3] for i in range(40)})
    # Small tables end in one part otherwise.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        O.write_backup(str(tmp_path / "out"), pictures, drawn, NOW)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(list((tmp_path / "out").glob("part-*"))) > 1
    found, again, rejects = E.read_backup(spark, str(tmp_path / "out"), pictures.select("image_id"))
    assert rejects.isEmpty()
    columns = ["image_id", "import_idx", "name", "path", "combo", "width", "frame_count", "filename_width", "open_frame", "kind", "has_source", "software", "modality", "bits"]
    assert listed(found, *columns) == listed(pictures, *columns)
    assert listed(again, "image_id", "frame_index", "ord", *ZONE) == listed(drawn, "image_id", "frame_index", "ord", *ZONE)
    heads = spark.createDataFrame([(f"t{i}", f"name {i:02}", "16", 640, 480, "2026") for i in range(30)], S.TEMPLATES)
    inner = spark.createDataFrame([(f"t{i}", 0, *BAND) for i in range(30)], S.TEMPLATE_ZONES)
    O.write_templates(str(tmp_path / "templates"), heads, inner, NOW)
    back, back_zones, rejects = E.read_templates(spark, str(tmp_path / "templates"))
    assert rejects.isEmpty() and listed(back, *heads.columns) == listed(heads, *heads.columns)
    assert listed(back_zones, *inner.columns) == listed(inner, *inner.columns)


def test_products_can_be_named(spark):
    given = files(spark, a=backup(image()), b=backup(image(id="d" * 64), format="zonespark-project"))
    assert E.parse_backup(given)[0].count() == 2
    found, _, rejects = E.parse_backup(given, products=["zonespark"])
    assert listed(found, "image_id") == ["d" * 64] and listed(rejects, "path") == ["a"]


def template(**change):
    return {"id": "t1", "name": " Head  er ", "combo": "16", "width": 640, "height": 480, "zones": [zone()], "createdAt": "2025", **change}


def templates(*listed_templates, **change):
    return {"format": "any-templates", "version": 1, "templates": list(listed_templates), **change}


def test_templates(spark, tmp_path):
    given = files(spark, a=templates(template(), template(name="two"), template(id="t2", combo="", createdAt=5), template(id=7, name="n" * 90)))
    found, inner, rejects = E.parse_templates(given, spark.createDataFrame([("t2",)], "template_id string"), NOW)
    assert rejects.isEmpty()
    ids = listed(found, "template_id")
    assert len(set(ids)) == 3 and "t1" in ids and "t2" not in ids
    assert listed(found, "name", "created_at") == [("Head er", "2025"), ("n" * 80, "2025"), ("two", "2025")]
    assert inner.count() == 3
    # Ids given to duplicates are the same when the job runs again.
    assert listed(E.parse_templates(given)[0], "template_id") == listed(E.parse_templates(given)[0], "template_id")
    O.write_templates_document(str(tmp_path / "out"), found, inner, NOW)
    value = whole(tmp_path / "out")
    assert [t["name"] for t in value["templates"]] == ["Head er", "n" * 80, "two"]
    (tmp_path / "in.json").write_text(json.dumps(value))
    back = E.read_templates(spark, str(tmp_path / "in.json"))
    columns = ("template_id", "name", "combo", "width", "created_at")
    assert listed(back[0], *columns) == listed(found, *columns)


@pytest.mark.parametrize(
    "bad, reason",
    [
        (json.dumps(templates(template())) + "}", "Not a template"), (json.dumps(templates(template())) * 2, "Not a template"),
        (templates(format="other"), "Not a template"), (templates(version=2), "Not a template"), (templates(template(name="  ")), "name"),
        (templates(template(width=0)), "raster"), (templates(template(combo="abc")), "combo"), (templates(template(zones=[])), "no zones"),
        (templates(template(zones=[zone(width=900)])), "outside"), (templates(template(zones=[zone(note=None)])), "rectangle"), (templates(4), "name"),
    ],
)
def test_bad_template_files_are_refused_whole(spark, bad, reason):
    found, _, rejects = E.parse_templates(files(spark, bad=bad, good=templates(template())))
    assert [(r.path, reason in r.reason) for r in rejects.collect()] == [("bad", True)]
    assert listed(found, "template_id") == ["t1"]


def test_template_from_a_frame_reads_back(spark, tmp_path):
    pictures = images(spark, {})
    chosen = spark.createDataFrame([(image_id(0), 0, "One")], "image_id string, frame_index int, name string")
    made, inner, _ = M.make_templates(zones(spark, {(0, 0): [(-5, 0, 20, 9, "clip")]}), pictures, chosen, NOW)
    O.write_templates_document(str(tmp_path / "out"), made, inner, NOW)
    value = whole(tmp_path / "out")["templates"][0]
    assert value["zones"] == [zone((0, 0, 15, 9, "clip"))] and value["createdAt"] == NOW


def test_a_folder_may_mix_records_and_documents(spark, tmp_path):
    from zonespark.sources.exchange import documents_in

    (tmp_path / "a b.json").write_text('{"r": 1}\n\n{"r": 2}\n')
    (tmp_path / "c.json").write_text('\n{\n  "d": 3\n}\n')
    (tmp_path / "d[1].json").write_text('{"r": 4}')
    (tmp_path / "e.json").write_text("")
    found = [r["text"] for r in documents_in(spark, str(tmp_path)).orderBy("path").collect()]
    assert found == ['{"r": 1}', '{"r": 2}', '\n{\n  "d": 3\n}\n', '{"r": 4}']


def test_rejects_of_backups_alone_rank_nothing(spark, monkeypatch):
    """backup_rejects gives what parse_backup refuses, without a position for every good image."""
    given = files(spark, bad=backup(image(combo="x1")), good=backup(image(id="c" * 64)), other="[]")
    want = sorted(E.parse_backup(given)[2].collect())
    monkeypatch.setattr(E, "with_global_rank", lambda *_: 1 / 0)
    assert sorted(E.backup_rejects(given).collect()) == want and {r.path for r in want} == {"bad", "other"}


def test_records_are_packed_and_written_without_a_copy(spark, tmp_path, monkeypatch):
    """records go from the tables to their files, which may be gzip files, and a record is judged by itself."""
    pictures = images(spark, {"frame_count": 2}, {}, {})
    drawn = zones(spark, {(0, 1): [BAND, LABEL], (1, 0): [(600, 0, 90, 9, "")], (2, 0): [LABEL]})
    monkeypatch.setattr(O, "materialise", lambda _: 1 / 0)
    O.write_backup(str(tmp_path / "plain"), pictures, drawn, NOW)
    O.write_backup(str(tmp_path / "packed"), pictures, drawn, NOW, "gzip")
    lines = [[r.value for r in spark.read.text(str(tmp_path / f)).collect()] for f in ("plain", "packed")]
    assert sorted(lines[0]) == sorted(lines[1]) and all(p.suffix == ".gz" for p in (tmp_path / "packed").glob("part-*"))
    found, again, rejects = E.read_backup(spark, str(tmp_path / "packed"))
    assert listed(found, "image_id", order=["import_idx"]) == [image_id(0), image_id(2)]
    assert listed(again, "image_id", "frame_index", "ord") == [(image_id(0), 1, 0), (image_id(0), 1, 1), (image_id(2), 0, 0)]
    assert [r.reason for r in rejects.collect()] == ["A rectangle lies outside the source image."]
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
