import gzip
import json
import random

import pytest

from tables import images, listed, zones
from test_exchange import backup, image, template, templates, zone
from zonespark.plans.documents import in_order
from zonespark.schemas import ZONE
from zonespark.sources import documents as O
from zonespark.sources import exchange as E
from zonespark.sources import json_scan as J

STRINGS = ["", "a", '"', "\\", '\\\\"', "],[", "{", "}{", "é漢😀", "\n\t", "x" * 30, "[[", '",', "\\u0041"]


def value(rng, depth):
    kind = rng.randrange(8 if depth else 5)
    if kind < 5:
        return [rng.choice(STRINGS), rng.randrange(99), None, True, 1.5][kind]
    n = rng.randrange(4)
    return [value(rng, depth - 1) for _ in range(n)] if kind == 5 else {rng.choice(STRINGS) + str(i): value(rng, depth - 1) for i in range(n)}


def scanned(text: bytes, split: int, block: int):
    """(skeleton, elements) of a document, split by split, as the jobs put the pieces together."""
    def blocks(part):
        return (part[i : i + block] for i in range(0, len(part), block))

    state, depth, pieces = 0, 0, []
    for start in range(0, len(text), split):
        part = text[start : start + split]
        pieces += [(start, *p) for p in J.cut(blocks(part), state, depth, start)]
        state, change = J.outcomes(blocks(part))[state]
        depth += change
    skeleton, elements, opened, head = b"", [], None, None
    for _, at, kind, container, first, starts, ends, piece in sorted(pieces, key=lambda p: (p[1], p[2] != 1)):
        if kind == J._SKELETON:
            skeleton += piece
            if container is not None:
                opened = container
                skeleton += b'"%d":%d' % (opened, opened) if piece.endswith(b"{") else b"%d" % opened
        elif kind == J._ELEMENT:
            if starts:
                head = [opened, at, first, b"", 0]
            head[3] += piece
            head[4] = max(head[4], ends)
            if ends:
                elements.append(head)
    return skeleton, [(c, p.strip().decode()) for c, _, first, p, ends in elements if not (first and ends == J._CLOSED and not p.strip())]


@pytest.mark.parametrize("seed", range(60))
def test_a_document_is_cut_alike_wherever_the_splits_fall(seed):
    rng = random.Random(seed)
    document = {rng.choice(STRINGS) + str(i): value(rng, 4) for i in range(rng.randrange(1, 6))}
    text = json.dumps(document, indent=rng.choice([None, 0, 2]), ensure_ascii=rng.random() < 0.5).encode()
    whole = scanned(text, len(text), len(text))
    for split, block in ((1, 1), (2, 7), (7, 3), (13, 13), (50, 8), (rng.randrange(1, 40), rng.randrange(1, 40))):
        assert scanned(text, split, block) == whole
    skeleton, elements = json.loads(whole[0]), whole[1]
    assert list(skeleton) == list(document)
    for key, held in skeleton.items():
        if isinstance(document[key], list):
            assert [json.loads(t) for c, t in elements if c == held[0]] == document[key]
        elif isinstance(document[key], dict):
            (number,) = held
            members = [json.loads("{" + t + "}") for c, t in elements if c == held[number]]
            assert {k: v for m in members for k, v in m.items()} == document[key]
        else:
            assert held == document[key]


def parts(folder):
    return b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))


@pytest.fixture
def small_splits(monkeypatch):
    monkeypatch.setattr(J, "SPLIT", 777)
    monkeypatch.setattr(J, "_BLOCK", 100)


def test_a_written_document_reads_back_in_splits(spark, tmp_path, small_splits):
    many = [{"frame_count": 2, "name": f'n"{i}é\\\n]', "combo": str(i % 3)} for i in range(12)]
    pictures, drawn = images(spark, *many), zones(spark, {(i, i % 2): [(0, 0, 9, 9, '"]},{'), (1, 2, 3, 4, "é")][: i % 3] for i in range(12)})
    O.write_backup_document(str(tmp_path / "out"), pictures, drawn, "now")
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "in.json").write_bytes(parts(tmp_path / "out"))
    columns = ["image_id", "import_idx", "name", "path", "combo", "width", "frame_count", "open_frame", "kind", "software"]
    for path, one in ((tmp_path / "one", False), (tmp_path / "one" / "in.json", False), (tmp_path / "out", True)):
        found, again, rejects = E.read_backup(spark, str(path), one_document=one)
        assert rejects.isEmpty() and listed(found, *columns) == listed(pictures, *columns)
        assert listed(again, "image_id", "frame_index", "ord", *ZONE) == listed(drawn, "image_id", "frame_index", "ord", *ZONE)
    placed = J._placed(J.listed(spark, str(tmp_path / "one")).selectExpr("path AS document", "path", "0L AS base", "length"))
    assert placed.count() > 10 and placed.rdd.getNumPartitions() >= 1


def whole_and_scanned(spark, tmp_path, texts, parse, read):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in texts.items():
        (folder / name).write_text(text)
    given = spark.createDataFrame([(n, t) for n, t in texts.items()], "path string, text string")
    plain = {r.path: r.reason for r in parse(given)[-1].collect()}
    found = {r.path.split("/")[-1]: r.reason for r in read(spark, str(folder))[-1].collect()}
    assert found == plain
    return plain


def test_bad_documents_are_refused_for_the_same_reasons(spark, tmp_path, small_splits):
    good = json.dumps(backup(image(id="c" * 64)), indent=2)
    bad = [
        backup(image(), image()), backup(5), backup(image(kind="JPG")), backup(image(combo=None)), backup(image(frames={"0": [zone(x=0.5)]})),
        {**backup(image()), "version": 2}, {**backup(image()), "images": {}}, {**backup(image()), "images": {"a": 1}}, {**backup(image()), "images": 5},
        {k: v for k, v in backup(image()).items() if k != "images"}, [backup(image())], backup(),
    ]
    texts = {f"b{i:02}.json": json.dumps(b, indent=2) for i, b in enumerate(bad)}
    broken = [
        good + "x", good + good, good + "] [", good[:-1], good[:-40], good + "}", good.replace("[", "[,", 1), good.replace('"images": [', '"images": [ 1 2,', 1),
        good.replace('"kind"', "kind", 1), "{", "x", "[1,\n 2]", good.replace("}\n  ]", "},\n  ]", 1), good.replace('"name"', '"kind"', 1),
    ]
    texts |= {f"x{i:02}.json": b for i, b in enumerate(broken)} | {"good.json": good, "blank.json": " \n "}
    plain = whole_and_scanned(spark, tmp_path, texts, E.parse_backup, E.read_backup)
    assert set(texts) - set(plain) == {"good.json", "b11.json"}


def test_templates_and_layouts_are_scanned_alike(spark, tmp_path, small_splits):
    heads = {"a.json": templates(template(), template(id="t2", zones=[zone()] * 60)), "b.json": templates(template(name=" ")), "c.json": templates(), "d.json": templates(4)}
    texts = {n: json.dumps(t, indent=1) for n, t in heads.items()}
    assert set(whole_and_scanned(spark, tmp_path, texts, E.parse_templates, E.read_templates)) == {"b.json", "d.json"}
    found, inner, _ = E.read_templates(spark, str(tmp_path / "in"))
    assert listed(found, "template_id") == ["t1", "t2"] and inner.count() == 61

    def sizes(*keys, **change):
        return {k: {"ref_width": 640, "ref_height": 480, "zones": [zone()], **change} for k in keys}

    (tmp_path / "l").mkdir()
    files = {
        "a.json": {"annotations": {"16": sizes("640x480"), "9": sizes("640x480", zones=[zone()] * 50)}}, "b.json": {"annotations": {"x": sizes("640x480")}},
        "c.json": {"annotations": {}}, "d.json": {"annotations": []}, "e.json": {"annotations": {"1": 5}}, "f.json": {"other": {"1": sizes("640x480")}},
        "g.json": {"annotations": {"1": sizes("640x480", zones=[])}},
    }
    texts = {n: json.dumps(t, indent=2) for n, t in files.items()}
    texts["h.json"] = texts["a.json"].replace('"9": {', '"9": ,{', 1)
    plain = whole_and_scanned(spark, tmp_path / "l", texts, E.parse_layouts, E.read_layouts)
    assert set(texts) - set(plain) == {"a.json"}
    heads, inner, _ = E.read_layouts(spark, str(tmp_path / "l" / "in"))
    assert listed(heads, "combo", order=["layout_idx"]) == ["9", "16"] and inner.count() == 51


def test_records_are_read_in_splits(spark, tmp_path, small_splits):
    lines = [json.dumps(backup(image(id=f"{i:064x}", name="é" * (i % 40)))) for i in range(30)]
    (tmp_path / "a.json").write_text("\n\n".join(lines[:20]) + "\n")
    (tmp_path / "b c.json").write_text("\n  \n" + "\n".join(lines[20:]))
    (tmp_path / "d.json").write_text(json.dumps(backup(image(id="f" * 64)), indent=2))
    (tmp_path / "e.json").write_text("\n")
    (tmp_path / "f.json").write_text(json.dumps(backup(image(id="e" * 64))) + "\nbroken\n")
    found, _, rejects = E.read_backup(spark, str(tmp_path))
    assert listed(found, "image_id", order=["import_idx"])[:31] == [*(f"{i:064x}" for i in range(30)), "f" * 64]
    assert [r.path.split("/")[-1].split("#")[0] for r in rejects.collect()] == ["f.json"]


def test_stores_only_spark_reads_give_the_same(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text("\n".join(json.dumps(backup(image(id=f"{i:064x}"))) for i in range(3)))
    (tmp_path / "b.json").write_text(json.dumps(backup(image(id="b" * 64)), indent=2))
    ranged = listed(E.read_backup(spark, str(tmp_path))[0], "image_id", order=["import_idx"])
    monkeypatch.setattr(E, "reachable", lambda path: False)
    assert listed(E.read_backup(spark, str(tmp_path))[0], "image_id", order=["import_idx"]) == ranged and len(ranged) == 4


def test_splits_keep_all_tasks_busy(spark, tmp_path, monkeypatch):
    # Splits are rows of a few bytes, which AQE would put into one task.
    monkeypatch.setattr(J, "SPLIT", 16)
    (tmp_path / "records").write_text('{"images":[]}\n' * 100)
    files = J.listed(spark, str(tmp_path))
    assert J.records(files).rdd.getNumPartitions() == 8
    assert J.with_kinds(files).count() == 1
    assert J.records(files).count() == 100


def test_documents_are_written_in_parts(spark):
    from zonespark.plans.ordering import sorted_parts

    parts = sorted_parts(spark.range(100), "id").rdd.glom().collect()
    assert len(parts) == 8 and [row.id for part in parts for row in part] == list(range(100))


def test_packed_documents_are_the_same_document(spark, tmp_path, small_splits):
    """parts may be gzip files, and the rows that are sorted become the text that backup_document tells of."""
    many = [{"frame_count": 3, "name": f'n"{i}é', "filename_width": i or None} for i in range(9)]
    pictures = images(spark, *many)
    drawn = zones(spark, {(i, f): [(f, 0, 9, 9, '"]},{'), (1, 2, 3, 4, None), (1, 2, 3, 5, "é")][: i % 4] for i in range(9) for f in range(i % 3 + 1)})
    want = "".join(r["line"] + "\n" for r in in_order(O.backup_document(pictures, drawn, "now")).collect())
    O.write_backup_document(str(tmp_path / "plain"), pictures, drawn, "now")
    O.write_backup_document(str(tmp_path / "packed"), pictures, drawn, "now", "gzip")
    packed = b"".join(p.read_bytes() for p in sorted((tmp_path / "packed").glob("part-*.gz")))
    assert parts(tmp_path / "plain").decode() == want == gzip.decompress(packed).decode()
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "in.json.gz").write_bytes(packed)
    (tmp_path / "one" / "short.json.gz").write_bytes(packed[:-30])
    (tmp_path / "one" / "none.json.gz").write_bytes(b"not packed")
    for path, one in ((tmp_path / "packed", True), (tmp_path / "one", False)):
        found, again, rejects = E.read_backup(spark, str(path), one_document=one)
        assert {r.path.rsplit("/", 1)[-1] for r in rejects.collect()} == (set() if one else {"short.json.gz", "none.json.gz"})
        assert listed(found, "image_id", "import_idx", "name", "filename_width") == listed(pictures, "image_id", "import_idx", "name", "filename_width")
        noted = drawn.fillna("", ["note"])
        assert listed(again, "image_id", "frame_index", "ord", *ZONE) == listed(noted, "image_id", "frame_index", "ord", *ZONE)


def test_zones_of_a_document_are_read_without_ranks_or_exchanges(spark, tmp_path, monkeypatch):
    """the zones of a document come out of the table that was read once."""
    pictures, drawn = images(spark, *[{}] * 3), zones(spark, {(i, 0): [(0, 0, 9, 9, "")] for i in range(3)})
    O.write_backup_document(str(tmp_path / "out"), pictures, drawn, "now")
    monkeypatch.setattr(E, "with_global_rank", lambda *_: 1 / 0)
    again = E.read_backup(spark, str(tmp_path / "out"), one_document=True)[1]
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert listed(again, "image_id", "x") == listed(drawn, "image_id", "x")
