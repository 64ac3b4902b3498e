import hashlib
import io

import pytest

import dicom_files as D
from tables import listed
from test_files import tag_file, write
from zonespark.functions.identifying import IDENTIFYING_TAGS
from zonespark.sources import images as S
from zonespark.sources import ranged as R
from zonespark.sources.dicom_dictionary import DICTIONARY
from zonespark.sources.dicom_walk import PIXEL_DATA, read_elements

GIB = 1 << 30


class Counted(io.BytesIO):
    """An open file that remembers how much of it was read by range."""

    def __init__(self, data, size=None):
        super().__init__(data)
        self.all, self.full, self.asked = data, size or len(data), 0

    def size(self):
        return self.full

    def read_at(self, n, at):
        self.asked += n
        return self.all[at : at + n].ljust(min(n, self.full - at), b"\0")


@pytest.mark.parametrize("syntax", [D.EXPLICIT, D.IMPLICIT, D.BIG, D.DEFLATED])
def test_a_ranged_file_reads_like_its_bytes(syntax):
    for data in (D.dicom(syntax=syntax), D.png(3, 4), b"", b"short", tag_file(), D.dicom(syntax=syntax)[:-30]):
        ranged = R.RangedFile(Counted(data))
        assert len(ranged) == len(data) and ranged[:8] == data[:8] and ranged[3:10**9] == data[3:] and ranged[5:2] == b""
        assert ranged.sha256() == hashlib.sha256(data).hexdigest()
        assert S._dicom_facts(ranged) == S._dicom_facts(data)
        assert list(S._one_file(ranged, DICTIONARY)) == list(S._one_file(data, DICTIONARY))


def test_pixels_are_not_read_for_a_header():
    pixels = D.element(0x7FE00010, "OB", length=3 * GIB)
    head = D.dicom(pixels=pixels)
    handle = Counted(head, len(head) + 3 * GIB)
    found, problem = read_elements(R.RangedFile(handle), DICTIONARY, until=PIXEL_DATA)
    assert problem is None and found.number("00280011") == 640 and handle.asked <= 2 * R.PAGE
    handle = Counted(head, len(head) + 3 * GIB)
    rows = list(S._one_file(R.RangedFile(handle), DICTIONARY))
    assert {r[1]: r[4] for r in rows}["7fe00010"] == "Pixel data · 3,221,225,472 bytes" and handle.asked <= 4 * R.PAGE


def test_values_across_pages_are_whole():
    text = "x" * (3 * R.PAGE)
    data = D.dicom(D.element(0x00104000, "UT", text))
    values = {r[1]: r[4] for r in S._one_file(R.RangedFile(Counted(data)), DICTIONARY)}
    assert values["00104000"] == text and values["7fe00010"] == "Pixel data · 4 bytes"


def test_a_file_over_two_gigabytes_is_scanned(spark, tmp_path):
    head = D.dicom(pixels=D.element(0x7FE00010, "OB", length=2 * GIB + 64))
    (tmp_path / "big.dcm").write_bytes(head)
    with open(tmp_path / "big.dcm", "r+b") as f:
        f.truncate(len(head) + 2 * GIB + 64)  # A hole, which takes no room on the disk.
    write(tmp_path, a_dot_png=D.png(7, 9), cut_dot_dcm=head)
    images, rejects = S.scan_images(spark, str(tmp_path))
    assert listed(images, "name", "width", "kind", order=["name"]) == [("a.png", 7, "PNG"), ("big.dcm", 640, "DICOM")]
    assert listed(rejects, "error") == ["Not a readable DICOM Part 10 file or PNG."]
    digest = hashlib.sha256(head)
    for _ in range((2 * GIB + 64) // (1 << 20)):
        digest.update(bytes(1 << 20))
    digest.update(bytes(64))
    assert digest.hexdigest() in listed(images, "image_id")
    tags, warnings = S.scan_dicom_tags(spark, str(tmp_path))
    assert [r.value for r in tags.filter("hex = '7fe00010'").collect()] == ["Pixel data · 2,147,483,712 bytes"]
    assert [(r.file.split("/")[-1], r.partial) for r in warnings.collect()] == [("cut.dcm", True)]


def test_a_scan_is_planned_by_size_and_carries_no_content(spark, tmp_path):
    path = write(tmp_path, **{f"f{i}_dot_dcm": D.dicom(frames=str(i + 1)) for i in range(6)}, DICOMDIR=b"x", _dot_hidden=b"x", sub__g_dot_png=D.png())
    assert [p.rsplit("/", 1)[-1] for p, _ in R.files_below(path)] == [*(f"f{i}.dcm" for i in range(6)), "g.png"]
    files = [("a", 10), ("b", 5 * GIB), ("c", 10), ("d", 20), ("e", 100 << 20)]
    assert [p.paths for p in R.pack(files, 64 << 20)] == [["a"], ["b"], ["c", "d"], ["e"]] and R.pack([], 1)[0].paths == []
    frame = R.load(spark, R.ImageHeaders, path, partitionBytes=str(2 * R._OPENING))
    plan = frame._jdf.queryExecution().toString()
    assert "content" not in plan and frame.rdd.getNumPartitions() > 2 and frame.count() == 7


def test_files_that_cannot_be_read_are_rejects(spark, tmp_path):
    gone = spark.createDataFrame([(str(tmp_path / "gone.dcm"),), (write(tmp_path, a_dot_png=D.png()) + "/a.png",)], "path string")
    images, rejects = S.inspect_paths(gone)
    assert listed(images, "name") == ["a.png"] and listed(rejects, "error") == [S.UNREADABLE]
    assert list(S.file_tags(str(tmp_path / "gone.dcm"), None))[0][-1] == S.UNREADABLE
    with pytest.raises(Exception, match="does not exist"):
        S.scan_images(spark, str(tmp_path / "nowhere"))[0].count()
    empty = tmp_path / "empty"
    empty.mkdir()
    assert S.scan_images(spark, str(empty))[0].count() == 0


def test_stores_only_spark_reads_fall_back_to_whole_files(spark, tmp_path, monkeypatch):
    path = write(tmp_path, a_dot_dcm=D.dicom(), b_dot_png=D.png(), c_dot_dcm=b"broken")
    whole = [listed(t, *t.columns, order=["path"]) for t in S.scan_images(spark, path)]
    tags = listed(S.scan_dicom_tags(spark, path)[0], "hex", "value", order=["row_idx"])
    assert R.reachable(path) and R.reachable("file:///x") and not R.reachable("viewfs://store/in/x")
    monkeypatch.setattr(S, "reachable", lambda p: False)
    assert [listed(t, *t.columns, order=["path"]) for t in S.scan_images(spark, path)] == whole
    assert listed(S.scan_dicom_tags(spark, path)[0], "hex", "value", order=["row_idx"]) == tags


def test_a_brought_dictionary_reaches_the_tasks(spark, tmp_path):
    data = D.dicom(D.element(0x00181041, "", b"\x31\x30", implicit=True), syntax=D.IMPLICIT)
    path = write(tmp_path, a_dot_dcm=data)
    tags, _ = S.scan_dicom_tags(spark, path, {"00181041": ("DS", "ContrastBolusVolume")})
    assert {r.hex: (r.vr, r.name) for r in tags.collect()}["00181041"] == ("DS", "Contrast Bolus Volume")


def test_the_dictionary_knows_every_identifying_tag():
    assert not [t for t in IDENTIFYING_TAGS if t not in DICTIONARY] and len(IDENTIFYING_TAGS) == 216
    assert all(len(vr) == 2 and (vr.isupper() or vr in ("xs", "ox")) and keyword.isalnum() for vr, keyword in DICTIONARY.values())
    assert len({keyword for _, keyword in DICTIONARY.values()}) == len(DICTIONARY)
    texts = [t for t in IDENTIFYING_TAGS if DICTIONARY[t][0] in ("LO", "PN", "SH", "LT", "ST")]
    data = D.dicom(*[D.element(int(t, 16), "", b"ab", implicit=True) for t in texts], syntax=D.IMPLICIT)
    found = {r[1]: (r[2], r[3], r[4]) for r in S._one_file(data, DICTIONARY)}
    assert all(found[t] == (*DICTIONARY[t], "ab") for t in texts)


def test_archives_stand_for_their_files(spark, tmp_path):
    import zipfile

    from zonespark.sources.ranged import members_of, open_file, pack, write_archives

    png = bytes([0x89, 0x50, 0x4E, 0x47, 0x0D, 0x0A, 0x1A, 0x0A]) + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    rows = [(f"batch/{i}.png", png + str(i).encode()) for i in range(50)] + [("batch/.hidden.png", png), ("broken.dcm", b"no image")]
    folder = f"{tmp_path}/archives"
    write_archives(spark.createDataFrame(rows, "path string, content binary"), folder, each=4)
    with zipfile.ZipFile(f"{folder}/deflated.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("deep/é.png", png + b"x" * 100)
    (tmp_path / "archives" / "no.zip").write_bytes(b"no archive")
    # Many files are few files of the store.
    assert len(list((tmp_path / "archives").iterdir())) < len(rows) / 2
    expected = {path: hashlib.sha256(content).hexdigest() for path, content in rows[:50]} | {"deep/é.png": hashlib.sha256(png + b"x" * 100).hexdigest()}
    for files in (S.scan_images(spark, folder, archives=True), S.inspect_files(S.list_files(spark, folder, archives=True))):
        images, rejects = files
        assert {r.path.split("!/")[1]: r.image_id for r in images.collect()} == expected
        assert {r.width for r in images.collect()} == {640}
        assert sorted(r.path.split("/")[-1] for r in rejects.collect()) == ["broken.dcm", "no.zip"]
    # Without being asked for, an archive is a file that is no image.
    assert S.scan_images(spark, folder)[0].isEmpty()
    parts = [p for partition in pack([(f"{folder}/deflated.zip", 1 << 30)], 1 << 29, archives=True) for p in partition.paths]
    assert parts == [(f"{folder}/deflated.zip", i, 16) for i in range(16)]
    with open_file(f"{folder}/deflated.zip") as handle:
        assert [name for i in range(2) for name, _ in members_of(handle, "a", i, 2)] == ["a!/deep/é.png"]
