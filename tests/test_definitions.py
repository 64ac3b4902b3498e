import json

import pytest

from tables import listed
from test_export import FLAT, OK
from zonespark.export_schema import SchemaDefects, validate_export_schema
from zonespark.sources import exchange as E

GIVEN = [
    OK, FLAT, {}, [], 5, "x", None, {**OK, "name": " Bare  " + "n" * 90}, {**OK, "name": 5}, {**OK, "name": " \u00a0 "}, {**OK, "id": 7}, {**OK, "id": "own"},
    {**OK, "shape": "tree"}, {**OK, "shape": None}, {**OK, "shape": 3}, {**OK, "group_by": "combo"}, {**OK, "group_by": ["combo"]}, {**OK, "group_by": ""},
    {**OK, "zone": {}}, {**OK, "zone": []}, {**OK, "zone": None}, {**OK, "zone": {"a": "x", " ": "y"}}, {**OK, "zone": {"a": "size", "b": 4, "c": None}},
    {**OK, "entry": {"a": "size", "b": "ref_width", "c": "combo_id"}}, {**OK, "entry": {"a": "size"}, "shape": "flat"}, {**OK, "entry": {"a": "patient"}},
    {**OK, "size": {"a": "size"}}, {**OK, "size": {"a": "size"}, "shape": "flat"}, {**OK, "size": {"a": "x"}}, {**OK, "size": "no"},
    {**OK, "root": {"a": [1], "b": {"c": 1}, "d": None, "e": True, "f": 1.5}}, {**OK, "root": {"annotations": 1}}, {**OK, "root": {"generated_at": 1}},
    {**OK, "root": {"generated_at": 1}, "timestamp_field": " "}, {**OK, "root": {"generated_at": 1}, "timestamp_field": "when"}, {**OK, "root": {"": 1}},
    {**OK, "entries_field": " rows ", "root": {"rows": 1}}, {**OK, "entries_field": 5, "sizes_field": "", "zones_field": None, "timestamp_field": None},
    {**OK, "entry_constants": {"a": []}}, {**OK, "zone_constants": {"label": "Redact"}}, {**OK, "entry_constants": 1, "zone_constants": "x"},
    {"shape": "tree", "zone": {}, "entry": {"a": "patient", "": "size"}, "root": {"annotations": [1]}},
]


def test_columns_judge_like_the_validator(spark):
    rows = [(i, json.dumps(g)) for i, g in enumerate(GIVEN)] + [(900, "{"), (901, ""), (902, '{"a": 1} x'), (903, None)]
    schemas, defects = E.judge_definitions(spark.createDataFrame(rows, "place int, definition string"))
    good, bad = {r.place: r for r in schemas.collect()}, {r.place: r.defects for r in defects.collect()}
    assert set(good) | set(bad) == {i for i, _ in rows} and all(bad[i] == ["a schema should be an object"] for i in (900, 901, 902, 903))
    for i, given in enumerate(GIVEN):
        try:
            plain = validate_export_schema(given, "none").as_dict()
        except SchemaDefects as error:
            # Values are named as JSON writes them here and as Python does there, members in order of their keys here and as given there.
            assert sorted(d.split(", not ")[0] for d in bad[i]) == sorted(d.split(", not ")[0] for d in error.defects), i
            continue
        found = good[i].asDict()
        for name, value in plain.items():
            if name == "id":
                assert (found["own_id"] or "none") == value
            else:
                assert (json.loads(found[name]) if isinstance(value, dict) else found[name]) == value, (i, name)


def test_schema_records_and_documents(spark, tmp_path):
    def file(*schemas, **change):
        return {"format": "any-schema", "version": 1, "schemas": list(schemas), **change}

    one, two = {**OK, "id": "a"}, {**OK, "id": "b", "name": "Two"}
    (tmp_path / "a.json").write_text("\n".join(json.dumps(file(s)) for s in (one, two, one, {**OK, "zone": {}})))
    (tmp_path / "b.json").write_text(json.dumps(file(two, {**OK, "id": 5}, {**OK, "id": "c"}), indent=2))
    (tmp_path / "c.json").write_text(json.dumps(file(one, {**OK, "name": ""}), indent=2))
    (tmp_path / "d.json").write_text(json.dumps(file(one, version=2), indent=2))
    schemas, rejects = E.read_schemas(spark, str(tmp_path))
    ids = listed(schemas, "schema_id", order=["file", "pos"])
    assert len(set(ids)) == len(ids) == 6 and ids[:2] == ["a", "b"] and ids[-1] == "c" and all(len(i) == 32 for i in ids[2:5])
    assert sorted((r.path.split("/")[-1].split("#")[0], r.reason) for r in rejects.collect()) == [
        ("a.json", "zone: without a field no coordinate would be exported"), ("c.json", "name: a schema needs one"), ("d.json", "Not a schema file."),
    ]
    assert listed(E.read_schemas(spark, str(tmp_path), known=schemas.select("schema_id").limit(0))[0], "schema_id") == sorted(ids)
    assert "a" not in listed(E.read_schemas(spark, str(tmp_path), known=spark.createDataFrame([("a",)], "schema_id string"))[0], "schema_id")
    assert E.read_schemas(spark, str(tmp_path), products=["other"])[0].count() == 0
