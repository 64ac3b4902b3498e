import hashlib

import pytest

import dicom_files as D
from tables import listed
from zonespark.streaming import library as L
from zonespark.streaming.imports import import_batch, read_library, read_rejects


def png(n):
    return D.png(100 + n, 50, str(n).encode())


def image_id(n):
    return hashlib.sha256(png(n)).hexdigest()


def files(spark, *numbers, name="f"):
    return spark.createDataFrame([(f"/in/{name}{n}.png", bytearray(png(n))) for n in numbers], "path string, content binary")


def ids(spark, *numbers):
    return spark.createDataFrame([(image_id(n),) for n in numbers], "image_id string")


def numbers(spark, path):
    return listed(read_library(spark, path), "import_idx", "image_id", "has_source", order=["import_idx"])


def test_a_batch_opens_only_buckets_that_may_hold_its_contents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "_BUCKET", 3)  # So that runs have buckets by one or two digits.
    path = str(tmp_path)
    import_batch(files(spark, *range(20)), 0, path)
    import_batch(files(spark, *range(20, 28)), 1, path)
    library = L.Library(spark, path)
    assert len(library.buckets) > 10 and all(r["bucket"].startswith("x") for r in library.buckets)
    assert library.may_hold(ids(spark, *range(1000, 1040))) == []  # New contents: no bucket is opened.
    for n in (3, 21):
        run = "0-0-0" if n < 20 else "0-1-1"
        (found,) = library.may_hold(ids(spark, n))
        assert found[0] == run and image_id(n).startswith(found[1][1:])
    some = library.may_hold(ids(spark, 1, 2, 25, 2000))
    assert {r for r, _ in some} == {"0-0-0", "0-1-1"} and len(some) <= 3
    assert listed(library.known(ids(spark, 1, 2, 25, 2000)), "image_id") == sorted(image_id(n) for n in (1, 2, 25))
    # Of all directories of the library only that one is read.
    ((run, bucket),) = library.may_hold(ids(spark, 1))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = library.known(ids(spark, 1))._jdf.queryExecution().executedPlan().toString()
    (filters,) = [line for line in plan.splitlines() if "PartitionFilters" in line and "has_source" in line]
    assert f"= {run})" in filters and f"= {bucket})" in filters


def test_no_known_content_is_ever_missed(spark, tmp_path):
    path = str(tmp_path)
    library = L.Library(spark, path)
    rows = spark.range(20_000).selectExpr("sha2(cast(id as string), 256) AS image_id", "id AS import_idx")
    columns = [c.split() for c in L._IMAGES.split(",")]
    whole = rows.selectExpr(*[c if c in rows.columns else f"cast({'true' if c == 'has_source' else 'false' if c == 'again' else 'null'} as {k}) AS {c}" for c, k in columns])
    library.write_run(whole, L.Run(0, 0, 0), 19_999, 20_000)
    library = L.Library(spark, path)
    assert library.next_idx == 20_000 and library.known(rows.select("image_id")).count() == 20_000
    strangers = spark.range(20_000).selectExpr("sha2(concat('s', id), 256) AS image_id")
    assert library.known(strangers).count() == 0


@pytest.mark.parametrize("merged", [2, 100])
def test_batches_merge_and_nothing_changes(spark, tmp_path, monkeypatch, merged):
    monkeypatch.setattr(L, "MERGED", merged)
    path = str(tmp_path)
    expected = []
    for batch in range(4):
        import_batch(files(spark, *range(batch * 3, batch * 3 + 5)), batch, path)  # Two contents of each batch are known.
        fresh = [n for n in range(batch * 3, batch * 3 + 5) if image_id(n) not in {i for _, i, _ in expected}]
        expected += [(len(expected) + k, image_id(n), True) for k, n in enumerate(sorted(fresh, key=lambda n: f"/in/f{n}.png"))]
    assert numbers(spark, path) == expected
    library = L.Library(spark, path)
    assert (len(library.live) < 4) == (merged == 2)
    # A batch that runs again changes nothing, and a batch does not see those after it.
    import_batch(files(spark, *range(9, 14)), 3, path)
    assert numbers(spark, path) == expected
    assert len(listed(read_library(spark, path, 2), "image_id")) == 8
    gone = L.Library(spark, path).remove_covered()
    assert bool(gone) == (merged == 2) and numbers(spark, path) == expected and L.Library(spark, path).covered == []


def test_lost_sources_come_back_in_later_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "MERGED", 2)
    path = str(tmp_path)
    import_batch(files(spark, 1, 2), 0, path)
    # The library has lost the files of both images.
    held = L.Library(spark, path)._rows().drop("run", "bucket").collect()
    lost = spark.createDataFrame([{**r.asDict(), "has_source": False} for r in held], L._IMAGES)
    L.Library(spark, path).write_run(lost, L.Run(0, 0, 0), 1, 2)
    assert [s for _, _, s in numbers(spark, path)] == [False, False]
    import_batch(files(spark, 2, 3, name="g"), 1, path)
    assert numbers(spark, path) == [(0, image_id(1), False), (1, image_id(2), True), (2, image_id(3), True)]
    import_batch(files(spark, 2, 4, name="h"), 2, path)  # Merges the first two runs; the image is a duplicate now.
    import_batch(files(spark, 1), 3, path)
    assert [s for _, _, s in numbers(spark, path)] == [True] * 4
    assert [n for n, _, _ in numbers(spark, path)] == [0, 1, 2, 3]


def test_an_empty_batch_is_committed(spark, tmp_path):
    path = str(tmp_path)
    bad = spark.createDataFrame([("/in/x.dcm", bytearray(b"x")), ("/in/DICOMDIR", bytearray(b"x"))], "path string, content binary")
    import_batch(bad, 0, path)
    assert read_library(spark, path).count() == 0 and listed(read_rejects(spark, path), "path") == ["/in/x.dcm"]
    import_batch(files(spark, 1), 1, path)
    assert numbers(spark, path) == [(0, image_id(1), True)]


def test_arriving_files_are_spread_over_all_tasks(spark, monkeypatch):
    """The parts a stream reads follow the session's partitions, in three batches whatever their number."""
    from zonespark.catalog import files as C
    from zonespark.catalog.registry import Tables

    seen = []
    keep = C.materialise
    monkeypatch.setattr(C, "materialise", lambda df: seen.append(df.rdd.getNumPartitions()) or keep(df))
    monkeypatch.setattr(C, "import_stream", lambda files, *_, **__: type("Q", (), {"awaitTermination": lambda self: None})())
    spark.conf.set("spark.sql.shuffle.partitions", 30)
    try:
        C._streamed(Tables(spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert seen == [30]


def test_a_batch_stores_its_images_once(spark, tmp_path, monkeypatch):
    """what is said of an image is written when it is read and when it joins the library, and its name not beside its path."""
    from zonespark.operators import imports as N
    from zonespark.plans import ordering as O
    from zonespark.sources import images as S

    stored, keep, path = [], O.materialise, str(tmp_path)
    for module in (S, O):
        monkeypatch.setattr(module, "materialise", lambda df: stored.append(df.columns) or keep(df))
    import_batch(files(spark, 1, 2), 0, path)
    import_batch(files(spark, 2, 3, name="g"), 1, path)
    assert numbers(spark, path) == [(0, image_id(1), True), (1, image_id(2), True), (2, image_id(3), True)]
    wide = [c for c in stored if "manufacturer" in c]
    assert len(wide) == 2 and not any({"name", "stated", "outcome"} & set(c) for c in wide)
    # A file that is listed twice is taken as often, and all else is what import_outcomes says without its duplicates.
    library = spark.createDataFrame([("a", True), ("b", None)], "image_id string, has_source boolean")
    for rows in ([("a", "1"), ("b", "3"), ("b", "2"), ("c", "5"), ("c", "4")], [("c", "4"), ("c", "4"), ("b", "1"), ("d", "9")]):
        incoming = spark.createDataFrame(rows, "image_id string, path string")
        want = N.import_outcomes(library, incoming).filter("outcome <> 'duplicate'")
        assert listed(N.taken_files(library, incoming), "image_id", "path", "outcome") == listed(want, "image_id", "path", "outcome")


def test_rejects_of_a_stream_exchange_no_ids(spark, tmp_path, monkeypatch):
    """a batch asks for the buckets of its contents without exchanging their ids, and no content is exchanged to deal files out."""
    from zonespark.catalog import files as C
    from zonespark.catalog.registry import Tables

    path, asked = str(tmp_path), []
    bad = spark.createDataFrame([("/in/x.dcm", bytearray(b"x"))], "path string, content binary")
    import_batch(files(spark, 1, 2).unionByName(bad), 0, path)
    library = L.Library(spark, path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    frame = type(spark.range(1))
    distinct = frame.distinct
    monkeypatch.setattr(frame, "distinct", lambda df: asked.append(df._jdf.queryExecution().executedPlan().toString()) or distinct(df))
    try:
        assert len(library.may_hold(ids(spark, 1, 2, 3))) == 1 and listed(read_rejects(spark, path), "path") == ["/in/x.dcm"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    import re

    assert asked and not re.search(r"hashpartitioning\([^)]*image_id", asked[-1])
    stored = []
    monkeypatch.setattr(C, "materialise", lambda df: stored.append(df) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        C._streamed(Tables(spark, "/root/testdata/sf0.001"))
    plan = stored[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("unhex") < plan.index("RepartitionByExpression [o_orderkey")
