import json

import pytest
from pyspark.sql import functions as F

from tables import images, listed, zones
from zonespark.plans.documents import write_document_parts
from zonespark.sources import documents as O
from zonespark.sources import exchange as E
from zonespark.sources import json_scan as J
from zonespark.sources import ranged as R


def test_a_document_in_parts_reads_back_byte_for_byte(spark, tmp_path, monkeypatch):
    many = [{"name": f'n"{i}é\\\n]', "combo": str(i % 3)} for i in range(30)]
    pictures, drawn = images(spark, *many), zones(spark, {(i, 0): [(0, 0, 9, 9, '"]},{')] for i in range(0, 30, 2)})
    fragments = O.backup_document(pictures, drawn, "now")
    whole = "".join(r["line"] + "\n" for r in fragments.orderBy("place").collect()).encode()
    # Small tables end in one part otherwise.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_document_parts(fragments, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    parts = R.document_parts(str(tmp_path / "out"))
    assert len(parts) > 2 and [at for _, at, _ in parts][0] == 0 and all(b[1] == a[1] + a[2] for a, b in zip(parts, parts[1:]))
    path = str(tmp_path / "out")
    assert R.document_bytes(path, 0, 10**9) == whole and json.loads(whole)["format"] == "zonespark-project"
    for start, stop in ((5, 900), (parts[1][1] - 3, parts[2][1] + 4), (7, 7), (len(whole) - 1, len(whole) + 9)):
        assert R.document_bytes(path, start, stop) == whole[start:stop]
    monkeypatch.setattr(J, "SPLIT", 700)
    found, again, rejects = E.read_backup(spark, path, one_document=True)
    assert rejects.isEmpty() and listed(found, "name", order=["import_idx"]) == [i["name"] for i in many] and again.count() == 15
    with pytest.raises(FileExistsError):
        write_document_parts(fragments, path)


def test_a_failed_task_leaves_no_document(spark, tmp_path):
    lines = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("line"))
    with pytest.raises(Exception, match="broken"):
        R.write_parts(lines, str(tmp_path / "out"))
    assert not R.path_exists(str(tmp_path / "out" / R.MANIFEST))
    R.write_parts(spark.range(0, 100, 1, 4).select(F.col("id").cast("string").alias("line")), str(tmp_path / "out"))
    assert R.document_bytes(str(tmp_path / "out"), 0, 6) == b"0\n1\n2\n"
