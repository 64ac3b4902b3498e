"""SimHash near-duplicates: fingerprints linked at two or fewer differing bits, found by pigeonring filtering.

A fingerprint is a ring of three segments. If two fingerprints differ in at most two bits, some segment starts a chain
whose running difference stays within its share of the budget: none in the first segment, at most one in the first two
(2 * 2/3 rounded down), at most two in all three. So it is enough to look where one segment agrees and the next differs
in one place at most; the full distance is computed only there. Each fingerprint is filed once per chain start and
per place at which the second segment may differ, which makes the work grow with the number of fingerprints.
"""

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonespark.llm.common import keep, pick, word_blocks
from zonespark.llm.components import components
from zonespark.shipping import ship_package

DISTANCE = 2
#: First bit and length of the segments.
SEGMENTS = [(0, 22), (22, 21), (43, 21)]
SEED = 42
#: Files up to this size are compared member by member, larger ones by masks; both give the same components.
SMALL_FILE = 48


def _segment_mask(i: int) -> int:
    start, length = SEGMENTS[i % len(SEGMENTS)]
    return ((1 << length) - 1) << start


def _files() -> list[tuple[int, int | None, int]]:
    """(bits that agree, bit in which the members differ or None, bits left free) of every file a fingerprint is put in."""
    files = []
    for i in range(len(SEGMENTS)):
        agree, free = _segment_mask(i) | _segment_mask(i + 1), _segment_mask(i + 2)
        files.append((agree, None, free))
        start, length = SEGMENTS[(i + 1) % len(SEGMENTS)]
        files += [(agree & ~(1 << b), b, free) for b in range(start, start + length)]
    return files


FILES = _files()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the lower-cased word shingles of a UTF-8 text; 0 for a text without words."""
    counts, total, carried = np.zeros(64, np.int64), 0, []
    hashed = xxhash.xxh64_intdigest
    for words in word_blocks(text.lower()):
        words = carried + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = list(accumulate([len(w) + 1 for w in words]))
            starts = [0, *ends]
            n = len(words) - shingle + 1
            spans = zip(starts, ends[shingle - 1 :])
            hashes = np.fromiter((hashed(joined[s : e - 1], SEED) for s, e in spans), np.uint64, n)
            for part in range(0, n, 1 << 16):
                bits = np.unpackbits(hashes[part : part + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                counts += bits.sum(axis=0, dtype=np.int64)
            total += n
        carried = words[-(shingle - 1) :] if shingle > 1 else []
    if not total:
        return hashed(b" ".join(carried), SEED) if carried else 0
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _pairs_in_small(fp: np.ndarray, run: np.ndarray, size: np.ndarray, bit: np.ndarray) -> Iterator[tuple]:
    """Links inside small files, comparing members 1, 2, 3, … places apart."""
    for apart in range(1, int(size.max(initial=0))):
        here = np.flatnonzero(run[apart:] == run[:-apart])
        if not len(here):
            break
        a, b = fp[here], fp[here + apart]
        differ = a ^ b
        # A pair belongs in the file of the one bit in which the second segments differ, and in no other of its chain.
        own = np.where(bit[here] >= 0, (differ >> np.maximum(bit[here], 0).astype(np.uint64)) & np.uint64(1), np.uint64(1)) == 1
        linked = own & (differ != 0) & (np.bitwise_count(differ) <= DISTANCE)
        yield a[linked], b[linked]


def _stars_in_large(fp: np.ndarray, file: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of one large file tied to the smallest member they reach inside it, without comparing all pairs."""
    fp = np.unique(fp)
    _, bit, free = FILES[file]
    places = [b for b in range(64) if free >> b & 1]
    # Members that agree outside the masked bits differ in two bits at most, so whole groups are linked.
    masks = [1 << a | 1 << b for a, b in combinations(places, 2)] if bit is None else [1 << bit | 1 << b for b in places]
    label, changed = np.arange(len(fp)), True
    while changed:
        changed = False
        for mask in masks:
            _, group = np.unique(fp & np.uint64(~mask & (1 << 64) - 1), return_inverse=True)
            least = np.full(group.max() + 1, len(fp))
            np.minimum.at(least, group, label)
            new = np.minimum(label, least[group])
            if (new != label).any():
                changed, label = True, new
        label = label[label]
    tied = label != np.arange(len(fp))
    return fp[tied], fp[label[tied]]


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among fingerprints filed together. The rows come sorted by file and value; a file may span batches."""
    bits = np.array([-1 if b is None else b for _, b, _ in FILES])
    held: list[tuple[np.ndarray, ...]] = []

    def linked(file: np.ndarray, value: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], (file[1:] != file[:-1]) | (value[1:] != value[:-1])])
        run = np.cumsum(new) - 1
        size = np.bincount(run)[run]
        small = (size > 1) & (size <= SMALL_FILE)
        found = list(_pairs_in_small(fp[small], run[small], size[small], bits[file[small]]))
        for r in np.unique(run[size > SMALL_FILE]):
            first, last = np.searchsorted(run, [r, r + 1])
            found.append(_stars_in_large(fp[first:last], int(file[first])))
        for a, b in found:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        file, value = held[-1][:2]
        if (file[0], value[0]) == (file[-1], value[-1]) == (held[0][0][-1], held[0][1][-1]):
            continue  # Still inside one file.
        file, value, fp = (np.concatenate(c) for c in zip(*held))
        end = int(np.flatnonzero((file != file[-1]) | (value != value[-1]))[-1]) + 1
        yield from linked(file[:end], value[:end], fp[:end].view(np.uint64))
        held = [(file[end:], value[end:], fp[end:])]
    if held:
        file, value, fp = (np.concatenate(c) for c in zip(*held))
        yield from linked(file, value, fp.view(np.uint64))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(u, v) long: links that connect all distinct fingerprints (column fp) within the distance of each other.

    All links come out, but for files with very many members, where each member is tied to the smallest one it reaches.
    """
    ship_package(prints.sparkSession)
    masks = F.array(*[F.lit(_signed(agree)) for agree, _, _ in FILES])
    filed = (
        prints.select("fp").distinct()
        .select("fp", F.posexplode(masks).alias("file", "mask"))
        .select("file", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
    )
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = filed.repartition(parts, "file", "value").sortWithinPartitions("file", "value")
    return together.mapInArrow(_link_batches, "u long, v long")


def _grouped(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, fp, root (a fingerprint that stands for the group) and component_id of every row of docs."""
    ship_package(docs.sparkSession)
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    inputs = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(text_fingerprint(t.as_buffer().to_pybytes(), shingle)) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp"])

    prints = keep(inputs.mapInArrow(fingerprints, "doc_id long, text_hash long, fp long"))
    roots = components(fingerprint_links(prints))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = keep(
        least.join(roots, F.col("fp") == F.col("node"), "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    )
    ids = keep(classes.groupBy("root").agg(F.min("least").alias("component_id")))
    per_print = keep(classes.select("fp", "root").join(ids, "root").select("fp", "root", "component_id"))
    return prints.join(per_print, "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links, the document's own included. A null text counts as empty;
    texts without words have fingerprint zero and link like any other. Repeated rows come out repeated. A null doc_id
    is never the smallest; a component without any doc_id has a null id. An empty table gives an empty result.
    Texts of any length are read whole, in blocks. Columns other than doc_id and text are ignored.
    """
    return _grouped(docs, shingle).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each_group(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of docs that stay: of each group of near-duplicates the document with the smallest doc_id, once.

    Rows that repeat a doc_id and its text count as one document; of several texts under that doc_id the one with the
    smallest hash stays, and a document without an id only where none of its group has one. All columns are returned.
    """
    groups = _grouped(docs, shingle).withColumn("_row", F.struct("doc_id", "text_hash"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    first = keep(groups.groupBy("root").agg(F.min_by("_row", order).alias("_row")).select("_row.*"))
    names = docs.columns
    lowered = [c.lower() for c in names]
    at, text = (f"_{names.index(n) if n in names else lowered.index(n)}" for n in ("doc_id", "text"))
    rows = docs.toDF(*[f"_{i}" for i in range(len(names))])
    same = F.col(at).cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("text_hash"))
    return rows.join(first, same, "left_semi").dropDuplicates([at, text]).toDF(*names)
