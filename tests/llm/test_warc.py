import hashlib
import struct

import pytest
import zstandard
from odd import odd_pages, rows_of

from zonespark.llm.queries import QUERIES
from zonespark.llm.warc import archived, parse_record, read_archives, read_frames, record_bytes, skippable, train_dictionary, write_archives

SF = "/root/testdata/sf0.01"


def plain(pages):
    first = {}
    for i, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        other = first.get(data) if first.get(data) != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if other is None else "revisit", other))
    return sorted(out, key=repr)


def test_all_pages_come_back(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows_of(QUERIES["op10_warc_archive"](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == plain(pages)


def test_payloads_and_urls_survive_the_archive(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    write_archives(pages, f"{tmp_path}/w")
    back = {r["page_id"]: r for r in read_archives(spark, f"{tmp_path}/w").collect()}
    for p in pages.collect():
        assert (back[p["page_id"]]["payload"].decode(), back[p["page_id"]]["url"]) == (p["html"], p["url"])
    archive = max(tmp_path.glob("w/part-*"), key=lambda f: f.stat().st_size).read_bytes()
    magic, size = struct.unpack_from("<II", archive)
    assert magic == 0x184D2A5D and size > 1000
    # Any reader that knows the dictionary reads the whole file frame by frame.
    content = zstandard.ZstdDecompressor().decompress(archive[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    whole = reader.stream_reader(archive[8 + size :], read_across_frames=True).read()
    assert whole == b"".join(read_frames(archive)) and whole.count(b"WARC/1.1\r\n") >= 1


def test_odd_pages(spark):
    pages = odd_pages(spark)
    rows = [(r[0], r[1], r[2]) for r in pages.collect()]
    found = archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows_of(found) == plain(rows)
    assert rows_of(archived(pages.limit(0))) == []


def test_records_are_checked():
    payload, digest = b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest()
    good = record_bytes(7, "http://a/\r\nWARC-Type: evil", payload, digest, None, "1970-01-01T00:00:00Z")
    assert parse_record(good)["payload"] == payload and parse_record(good)["url"] == "http://a/%0D%0AWARC-Type: evil"
    visit = parse_record(record_bytes(8, None, payload, digest, 7, "1970-01-01T00:00:00Z"))
    assert (visit["record_type"], visit["refers_to"], visit["payload_bytes"], visit["payload"], visit["url"]) == ("revisit", 7, 200, None, None)
    for bad in (
        good[:-1], good + b"x", good.replace(b"xxx", b"xyx", 1), good.replace(b"Content-Length: 2", b"Content-Length: 3"), good[4:], b"",
        good.replace(b"response\r", b"metadata\r", 1), good.replace(b"<urn:page:7>", b"<urn:uuid:7>"),
    ):
        with pytest.raises((ValueError, KeyError)):
            parse_record(bad)


def test_damaged_archives_are_refused():
    data = train_dictionary([b"some text %d and more of the same kind of text" % i for i in range(2000)], 2048)
    writer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data), write_checksum=True)
    archive = skippable(data) + writer.compress(b"one") + skippable(b"") + writer.compress(b"two" * 30_000)
    assert list(read_frames(archive)) == [b"one", b"two" * 30_000]
    assert list(read_frames(skippable(zstandard.ZstdCompressor().compress(data)) + writer.compress(b"one"))) == [b"one"]
    assert list(read_frames(skippable(b""))) == list(read_frames(b"")) == []
    for bad in (archive[:-3], archive[:6], archive[: len(archive) // 2], archive[:-1] + bytes([archive[-1] ^ 1]), writer.compress(b"one")):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(read_frames(bad))


def test_too_little_to_learn_from_gives_no_dictionary():
    assert train_dictionary([], 1000) == train_dictionary([b"x"], 1000) == b""
