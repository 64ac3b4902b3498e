"""WARC archives compressed record by record with a shared Zstandard dictionary.

An archive starts with a skippable frame that holds the dictionary; after it, every record is one frame. Archives are
written by Spark's own text writer, whose commit protocol survives lost tasks: a row is a frame, and the separator
between rows is an empty skippable frame, which any Zstandard reader passes over.
"""

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonespark.llm.common import keep, pick, smallest_hashes
from zonespark.plans.ordering import shared_folder
from zonespark.shipping import ship_package

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"
#: Payloads of fewer bytes are never written as a revisit.
LEAST_REVISIT = 100


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary from sample payloads; empty where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


def skippable(content: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content


def _header_value(text: str) -> str:
    """A value that stays on its header line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit has the response's headers and no payload; its length is in them."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {_header_value(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    return "\r\n".join([*lines, "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _headers(head: bytes, first: bytes) -> dict[str, str]:
    start, *lines = head.split(b"\r\n")
    if not start.startswith(first):
        raise ValueError("the record does not start with its version")
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line has no colon")
        found[name.decode("ascii", "replace").strip().lower()] = value.decode("utf-8", "surrogatepass").strip()
    return found


def _page(identifier: str) -> int | None:
    if not identifier.startswith(f"<{RECORD_ID}") or not identifier.endswith(">"):
        raise ValueError("a record id of another kind")
    number = identifier[len(RECORD_ID) + 1 : -1]
    return int(number) if number else None


def parse_record(data: bytes) -> dict:
    """The checked content of one record: headers, lengths, and for responses the digest of the payload."""
    head, end, rest = data.partition(b"\r\n\r\n")
    if not end:
        raise ValueError("the record has no end of headers")
    headers = _headers(head, b"WARC/1.")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as its header says")
    http, end, payload = rest[:length].partition(b"\r\n\r\n")
    if not end:
        raise ValueError("the block has no end of headers")
    size = int(_headers(http, b"HTTP/1.")["content-length"])
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    kind, refers_to = headers["warc-type"], None
    if kind == "revisit":
        refers_to = _page(headers["warc-refers-to"])
        if payload:
            raise ValueError("a revisit has a payload")
    elif kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("the payload is not what its headers say")
    else:
        raise ValueError(f"a record of type {kind}")
    return {
        "page_id": _page(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": refers_to, "payload": payload if kind == "response" else None,
    }


def read_frames(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one per frame, with the dictionary of its leading skippable frame."""
    view, at, reader = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at >= 8 and struct.unpack_from("<I", view, at)[0] in SKIPPABLE:
            magic, size = struct.unpack_from("<II", view, at)
            if at + 8 + size > len(view):
                raise ValueError("a skippable frame is cut off")
            if at == 0 and magic == DICTIONARY_MAGIC and size:
                content = bytes(view[8 : 8 + size])
                if content[:4] == zstandard.FRAME_HEADER:
                    content = zstandard.ZstdDecompressor().decompress(content)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            at += 8 + size
            continue
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ValueError("a frame is cut off")
            chunk = view[at : at + 16384]
            parts.append(frame.decompress(chunk))
            at += len(chunk) - (len(frame.unused_data) if frame.eof else 0)
        yield b"".join(parts)


def write_archives(
    pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 3, max_samples: int = 400,
    max_sample_chars: int = 8192, dictionary_bytes: int = 65536,
) -> None:
    """Write every row of pages (page_id, url, html) as a record into archives in `folder`, one archive per partition.

    Of rows with equal payloads of 100 bytes or more, those with the smallest page_id are responses and the others
    revisit them; shorter payloads are all responses. A null html is an empty payload, a null url leaves its header out,
    and a null page_id is never the smallest. The dictionary is trained on the first `max_sample_chars` characters of
    at most `max_samples` pages, those with the smallest hashed ids; an archive without one has an empty dictionary.
    """
    spark = pages.sparkSession
    ship_package(spark)
    rows = pick(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    ids = pick(pages, "page_id").dropna().distinct()
    # Broadcast: at most max_samples ids.
    chosen = F.broadcast(smallest_hashes(ids, "page_id", max_samples))
    sampled = pick(pages, "page_id", "html").join(chosen, "page_id").groupBy("page_id").agg(
        F.min(F.substring("html", 1, max_sample_chars)).alias("html")
    )
    samples = sampled.filter("length(html) > 0").orderBy("page_id").collect()
    dictionary = train_dictionary([r["html"].encode() for r in samples], dictionary_bytes)
    light = rows.select("page_id", "digest", F.octet_length("payload").alias("size"))
    shared = keep(
        light.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
        .filter((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    ready = rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
        first = [skippable(zstandard.ZstdCompressor(level=9).compress(dictionary) if dictionary else b"")]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                frames = first
                first = []
                for r in batch.slice(at, 256).to_pylist():
                    payload = r["payload"]
                    frames.append(writer.compress(record_bytes(r["page_id"], r["url"], payload, r["digest"], r["refers_to"], date)))
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["value"])

    frames = ready.mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value"))
    frames.write.option("lineSep", EMPTY_FRAME).text(folder)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives in a folder: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    payload_bytes and payload_digest are those of the full payload, also for revisits. A frame, header or length that
    does not hold fails the job, as a damaged archive must not pass for a shorter one. Empty archives have no records.
    """
    ship_package(spark)
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    fields += [("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows = []
                for data in read_frames(archive.as_buffer()):
                    rows.append(parse_record(data))
                    if not with_payload:
                        rows[-1]["payload"] = None
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(read, schema)


def archived(pages: DataFrame) -> DataFrame:
    """Write pages into archives in the shared folder and read them back."""
    folder = f"{shared_folder(pages.sparkSession)}/zonespark-warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder, with_payload=False)
