import struct

import pytest

import dicom_files as D
from tables import images, listed
from zonespark.operators import imports as I
from zonespark.operators import tags as T
from zonespark.sources import images as S
from zonespark.streaming.imports import read_library, stream_import


def write(folder, **files):
    for name, data in files.items():
        target = folder / name.replace("__", "/").replace("_dot_", ".")
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    return str(folder)


def tags_of(spark, data, **kw):
    files = spark.createDataFrame([("a.dcm", bytearray(data))], "path string, content binary")
    tags, warnings = S.read_tags(files, **kw)
    return tags.orderBy("row_idx").collect(), warnings.collect()


def test_folder_scan(spark, tmp_path):
    path = write(
        tmp_path, sub__combo016_800x600_s1_dot_dcm=D.dicom(frames="3 ", software=" V4 "), plain_dot_png=D.png(1024, 768),
        broken_dot_dcm=b"broken", DICOMDIR=b"x", _dot_hidden=b"x", none_dot_dcm=D.dicom(pixels=b""),
        zero_dot_dcm=D.dicom(width=0), half_dot_dcm=D.dicom(frames="1.5"), flat_dot_png=D.png(0, 5),
    )
    found, rejects = S.scan_images(spark, path)
    rows = {r.name: r for r in found.collect()}
    assert set(rows) == {"combo016_800x600_s1.dcm", "plain.png"}
    scan = rows["combo016_800x600_s1.dcm"]
    assert (scan.combo, scan.width, scan.height, scan.frame_count, scan.filename_width, scan.sample) == ("016", 640, 480, 3, 800, "1")
    assert (scan.software, scan.modality, scan.bits, scan.kind) == ("V4", "US", 8, "DICOM")
    assert (rows["plain.png"].width, rows["plain.png"].kind, rows["plain.png"].manufacturer) == (1024, "PNG", "")
    reasons = {r.path.split("/")[-1]: r.error for r in rejects.collect()}
    assert set(reasons) == {"broken.dcm", "none.dcm", "zero.dcm", "half.dcm", "flat.png"}
    assert reasons["none.dcm"] == "DICOM contains no supported image Pixel Data."
    assert reasons["broken.dcm"] == "Not a readable DICOM Part 10 file or PNG."


@pytest.mark.parametrize("syntax", [D.EXPLICIT, D.IMPLICIT, D.BIG, D.DEFLATED])
def test_transfer_syntaxes(spark, syntax):
    rows, warnings = tags_of(spark, D.dicom(syntax=syntax, width=1024))
    values = {r.hex: r.value for r in rows}
    assert (values["00280011"], values["00081090"]) == ("1024", "NL40") and not warnings
    files = spark.createDataFrame([("a.dcm", bytearray(D.dicom(syntax=syntax, width=1024)))], "path string, content binary")
    assert S.inspect_files(files)[0].head().width == 1024


def tag_file():
    e = D.element
    deep = D.item(e(0x00081155, "UI", "2.25.111") + e(0x00081140, "SQ", D.item(e(0x00081155, "UI", "2.25.222"))))
    return D.dicom(
        e(0x00080005, "CS", "ISO_IR 192"), e(0x00080018, "UI", "2.25.9"), e(0x00100010, "PN", "SYNTHETIC^Zoë"),
        e(0x00100030, "DA", ""), e(0x00110010, "LO", "TEST_CREATOR"), e(0x00111001, "LO", "private calibration"),
        e(0x00081110, "SQ", deep + D.item(e(0x00081155, "UI", "2.25.333"))), e(0x00280009, "AT", b"\x18\0\x63\0"),
        e(0x00280301, "CS", "YES"), after=e(0xFFFCFFFC, "OB", b"\1\2\3\4"),
    )


def test_tag_inventory(spark):
    rows, warnings = tags_of(spark, tag_file())
    by = {r.hex: r for r in rows}
    assert not warnings
    assert by["00100010"].value == "SYNTHETIC^Zoë" and by["00100010"].name == "Patient Name" and by["00100010"].phi
    assert by["00100030"].value == "" and by["00280009"].value == "(0018,0063)"
    assert (by["00110010"].keyword, by["00111001"].keyword, by["00111001"].value) == ("PrivateCreator", "PrivateTag", "private calibration")
    assert sum(r.private for r in rows) == 2 and sum(r.sequence for r in rows) == 2
    nested = next(r for r in rows if r.value == "2.25.222")
    assert nested.path == "Referenced Study Sequence [1] › Referenced Image Sequence [1]"
    assert [r.value for r in rows if r.hex == "00081155"] == ["2.25.222", "2.25.111", "2.25.333"]
    assert by["7fe00010"].value == "Pixel data · 4 bytes" and by["7fe00010"].binary and "fffcfffc" in by
    assert rows[0].hex == "00020010" and [r.row_idx for r in rows] == list(range(len(rows)))


def test_tag_search_and_counts(spark):
    files = spark.createDataFrame([("a.dcm", bytearray(tag_file()))], "path string, content binary")
    tags, _ = S.read_tags(files)
    for query in ("(0010,0010)", "00100010", "0010, 0010", "x00100010", "0x00100010", "patientname", "patient name", "ZOË"):
        assert [r.hex for r in T.search_tags(tags, query).orderBy("row_idx").collect()][0] == "00100010", query
    assert T.search_tags(tags, "calibration", "private").count() == 1
    assert T.search_tags(tags, "", "sequences").count() == 2
    assert listed(T.search_tags(tags, "2.25.333"), "path") == ["Referenced Study Sequence [2]"]
    assert T.search_tags(tags, "no matching tag").isEmpty()
    assert listed(T.search_tags(tags, "", "phi"), "hex") == [
        "00080018", "00081110", "00081140", "00081155", "00081155", "00081155", "00100010", "00100030",
    ]
    counts = T.tag_counts(tags).head()
    assert (counts["private"], counts["sequences"], counts["standard"]) == (2, 2, counts["all"] - 2)
    assert T.burned_in_flag(tags).head().declared == "yes"
    assert T.tag_page(tags, 1, 5).count() == 5


def test_burned_in_states(spark):
    rows = [("a", 2, "00280301", " yes "), ("a", 5, "00280301", "NO"), ("b", 1, "00280301", "No"), ("c", 1, "00280301", " "), ("d", 1, "00280301", "maybe"), ("e", 1, "00100010", "x")]
    tags = spark.createDataFrame(rows, "image_id string, row_idx bigint, hex string, value string")
    assert listed(T.burned_in_flag(tags), "image_id", "declared") == [
        ("a", "yes"), ("b", "no"), ("c", "empty"), ("d", "unrecognised"), ("e", "absent"),
    ]


def test_values_and_warnings(spark):
    e = D.element
    rows, warnings = tags_of(
        spark,
        D.dicom(
            e(0x00091001, "FD", struct.pack("<ddd", 0.1, 3.0, 1e-7)), e(0x00091002, "SL", struct.pack("<ii", -5, 7)),
            e(0x00091003, "UN", bytes(range(40))), e(0x00091004, "UL", b"\1\2"), e(0x00091005, "FL", struct.pack("<f", 0.1)),
            e(0x00080005, "CS", "UNSUPPORTED"), e(0x00100010, "PN", "TEST"),
        ),
    )
    by = {r.hex: r for r in rows}
    assert by["00091001"].value == "0.1 \\ 3 \\ 1e-7" and by["00091002"].value == "-5 \\ 7"
    assert by["00091003"].value.startswith("Binary data · 40 bytes\n00 01 02") and by["00091003"].value.endswith("1f …")
    assert by["00091004"].value == "[Unable to read this value]" and by["00091005"].value == "0.10000000149011612"
    assert by["00100010"].value == "[Undecoded text] 54 45 53 54"
    assert {w.warning.split(";")[0].split(".")[0] for w in warnings} == {
        "Character set UNSUPPORTED is not supported", "(0009,1004) contains an unreadable value",
    }


def test_sequences_of_unknown_length_and_compressed_pixels(spark):
    e = D.element
    inner = D.item(e(0x00081155, "UI", "2.25.5"), closed=False) + D.END
    pixels = struct.pack("<HH", 0x7FE0, 0x0010) + b"OB\0\0\xff\xff\xff\xff" + D.item(b"") + D.item(b"12345678") + D.END
    rows, warnings = tags_of(spark, D.dicom(e(0x00081110, "SQ", inner, length=0xFFFFFFFF), pixels=pixels))
    by = {r.hex: r for r in rows}
    assert by["00081155"].path == "Referenced Study Sequence [1]" and not warnings
    assert by["7fe00010"].value == "Encapsulated pixel data · 1 fragments · 8 bytes"


def test_partial_files_keep_what_was_read(spark):
    whole = D.dicom(D.element(0x00281050, "DS", "128"))
    rows, warnings = tags_of(spark, whole[:-40])
    assert "00080070" in {r.hex for r in rows} and "7fe00010" not in {r.hex for r in rows}
    assert [w.partial for w in warnings] == [True]
    rows, warnings = tags_of(spark, b"nothing")
    assert not rows and warnings[0].warning.startswith("Could not parse")


def test_a_caller_may_bring_the_whole_dictionary(spark):
    data = D.dicom(D.element(0x00181041, "", b"\x31\x30", implicit=True), syntax=D.IMPLICIT)
    rows, _ = tags_of(spark, data)
    assert {r.hex: r.keyword for r in rows}["00181041"] == "UnknownTag"
    rows, _ = tags_of(spark, data, dictionary={"00181041": ("DS", "ContrastBolusVolume")})
    found = {r.hex: r for r in rows}["00181041"]
    assert (found.name, found.vr, found.value) == ("Contrast Bolus Volume", "DS", "10")


def test_import_outcomes(spark):
    library = images(spark, {"image_id": "a"}, {"image_id": "b", "has_source": False, "import_idx": 7})
    incoming = spark.createDataFrame(
        [("a", "p1"), ("b", "p2"), ("b", "p3"), ("c", "p5"), ("c", "p4"), ("d", "p6")], "image_id string, path string"
    )
    after, outcomes = I.merge_import(library, incoming)
    assert listed(outcomes, "path", "outcome") == [
        ("p1", "duplicate"), ("p2", "reconnected"), ("p3", "duplicate"), ("p4", "added"), ("p5", "duplicate"), ("p6", "added"),
    ]
    assert listed(after, "image_id", "import_idx", "has_source", order=["import_idx"]) == [
        ("a", 0, True), ("b", 7, True), ("c", 8, True), ("d", 9, True),
    ]
    rejects = spark.createDataFrame([("x", "bad")], "path string, error string")
    assert listed(I.import_summary(outcomes, rejects), "outcome", "files") == [
        ("added", 2), ("duplicate", 3), ("failed", 1), ("reconnected", 1),
    ]


def test_stream_import(spark, tmp_path):
    inbox, library, state = tmp_path / "in", tmp_path / "library", tmp_path / "state"
    write(inbox, a_dot_dcm=D.dicom(), same_dot_dcm=D.dicom(), b_dot_png=D.png(), broken_dot_dcm=b"x", DICOMDIR=b"x")

    def run():
        stream = stream_import(spark, str(inbox), str(library), str(state), once=True)
        assert stream.awaitTermination(120) and stream.exception() is None
        return listed(read_library(spark, str(library)), "import_idx", "name", order=["import_idx"])

    assert run() == [(0, "a.dcm"), (1, "b.png")]
    write(inbox, c_dot_png=D.png(tail=b"other"), copy_dot_png=D.png())
    assert run() == [(0, "a.dcm"), (1, "b.png"), (2, "c.png")]
    assert run() == [(0, "a.dcm"), (1, "b.png"), (2, "c.png")]


def test_warnings_alone_are_those_of_the_tags(spark):
    """read_warnings goes through every file as read_tags does, and makes no row of a tag."""
    e = D.element
    bad = e(0x00280106, "US", b"abc\0\0\0\0\0\0"), e(0x00080005, "CS", "ISO 2022 IR 58"), e(0x00081080, "LO", "caf\xe9")
    utf8 = e(0x00080005, "CS", "ISO_IR 192"), e(0x00081080, "LO", b"caf\xe9")
    inner = D.item(e(0x00080100, "SH", b"\xff\xfe") + e(0x00081155, "UI", b"\xff\xfe")) + D.END
    contents = [
        D.dicom(), D.dicom(*bad), D.dicom(*utf8), D.dicom(*utf8, e(0x00081110, "SQ", inner, length=0xFFFFFFFF)), D.dicom(syntax=D.IMPLICIT),
        D.dicom(e(0x00280106, "US", b"abc "), e(0x00280107, "FD", b"abc ")), D.dicom(*utf8)[:-40], b"nothing", b"", D.png(),
    ]
    files = spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")
    want = S.read_tags(files)[1]
    found = S.read_warnings(files)
    assert found.columns == want.columns
    assert sorted(found.collect()) == sorted(want.collect()) and len({r.file for r in found.collect()}) >= 7
