"""Near copies: documents whose sets of word shingles are similar, found by wide SimHash fingerprints and a pigeonring.

A pair of similar sets differs in a known share of the bits of their fingerprints. The bits form a ring of segments; segments are
as long as it takes for few unrelated documents to agree in one, and as many as it takes for similar ones to agree in some. Where a
segment agrees, the differences along the chain of segments after it must stay within the share of the budget that belongs to the
length of the chain. Only then are the whole fingerprints compared, and of what is left the exact shingle sets.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonespark.llm.common import keep, pick, word_blocks
from zonespark.llm.components import components
from zonespark.shipping import ship_package

_SEED = 42
#: Words a task remembers the hash of, shingles added up at a time, and members of a file that the first look compares with one.
_REMEMBERED, _TOGETHER, _NEAR = 200_000, 1 << 13, 2048
#: Members up to which a file gives all its pairs at once, and those of a block of a fuller file.
_FEW, _MEMBERS = 32, 512
#: The same while groups are sought: unrelated texts seldom make a file fuller, and many copies of one text give few pairs each before
#: the links among them are known.
_UNRELATED = 5
# Odd constants that mix 64-bit words.
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Ring:
    """A ring of `segments` segments of `length` bits, for sets that are similar to at least a bound."""

    length: int
    segments: int
    #: Share of bits in which a pair at the bound differs, and the most differences of a pair that is looked at.
    share: float
    distance: int

    @property
    def words(self) -> int:
        return -(-self.length * self.segments // 64)

    @property
    def most(self) -> int:
        """The most differences of whole fingerprints, the bits beyond the ring included."""
        return self.distance + 64 * self.words - self.length * self.segments

    @property
    def chain(self) -> int:
        """Segments of the chain that go into 64 bits."""
        return min(64 // self.length, self.segments - 1)

    @staticmethod
    def of(documents: int, similarity: float, recall: float = 0.95, least_bits: int = 768) -> "Ring":
        """The ring for a number of documents: one in a few unrelated pairs per document agrees in a segment."""
        share = acos(2 * similarity / (1 + similarity)) / pi
        length = min(32, max(12, ceil(log2(max(documents, 1)))))
        segments = max(ceil(log(1 - recall) / log(1 - (1 - share) ** length)), ceil(least_bits / length))
        bits = length * segments
        return Ring(length, segments, share, ceil(bits * share + 2 * sqrt(bits * share * (1 - share))))

    def budgets(self) -> list[int]:
        """The most differences of a chain after 1, 2, … segments beyond the one that agrees."""
        return [int((i + 2) * self.distance / self.segments) for i in range(self.chain)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M2
    x = (x ^ x >> np.uint64(27)) * _M3
    return x ^ x >> np.uint64(31)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, _SEED)
        return h


def _spread(shingles: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Each shingle's hash as many 64-bit words, of bits that tell nothing of each other."""
    x = (shingles[:, None] ^ salts) * _M2
    return x ^ x >> np.uint64(32)


def shingle_set(text: bytes, shingle: int, hashes: dict[bytes, int]) -> np.ndarray:
    """The different shingles of a UTF-8 text, A-Z in lower case, as sorted 64-bit hashes; of a shorter text its whole word sequence."""
    known = hashes.__getitem__
    words = [np.fromiter(map(known, block), np.uint64, len(block)) for block in word_blocks(text.lower())]
    words = np.concatenate(words) if words else np.zeros(0, np.uint64)
    if not len(words):
        return words
    size = min(shingle, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        h = _mixed(h * _M1 + words[i : len(words) - size + 1 + i])
    return np.unique(h)


def fingerprint(shingles: np.ndarray, words: int) -> np.ndarray:
    """SimHash of `words` 64-bit words: a bit is set if it is set for more than half of the shingles."""
    counts = np.zeros(words * 64, np.int64)
    salts = _mixed(np.arange(1, words + 1, dtype=np.uint64) * _M1)
    for start in range(0, len(shingles), _TOGETHER):
        part = shingles[start : start + _TOGETHER]
        # Numbers of one bit, added in pairs until one is left: plane k holds bit k of every sum.
        planes = [_spread(part, salts)]
        while len(planes[0]) > 1:
            if len(planes[0]) % 2:
                planes = [np.concatenate([p, np.zeros((1, words), np.uint64)]) for p in planes]
            carry, added = np.zeros((len(planes[0]) // 2, words), np.uint64), []
            for p in planes:
                a, b = p[0::2], p[1::2]
                either = a ^ b
                added.append(either ^ carry)
                carry = a & b | carry & either
            planes = [*added, carry]
        for k, p in enumerate(planes):
            counts += np.unpackbits(p[0].astype(">u8").view(np.uint8)).astype(np.int64) << k
    return np.packbits(counts * 2 > len(shingles)).view(">u8").astype(np.uint64)


def _fingerprints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """doc_id, text_hash and print (64-bit words) of every row of docs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _WordHashes(), {}
        for batch in batches:
            prints = []
            for text_hash, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                if text_hash not in seen:
                    if len(seen) > 20_000:
                        seen.clear()
                    seen[text_hash] = fingerprint(shingle_set(text.as_buffer().to_pybytes(), shingle, hashes), words).tobytes()
                prints.append(seen[text_hash])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.binary())], ["doc_id", "text_hash", "print"])

    text = F.coalesce("text", F.lit(""))
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    return texts.mapInArrow(read, "doc_id long, text_hash long, print binary")


def _bits(prints: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(prints), "<u8").astype(">u8").view(np.uint8).reshape(len(prints), -1), axis=1)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of up to 64 bits as numbers."""
    wide = np.zeros((len(bits), 64), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(">u8")[:, 0].astype(np.uint64)


def _filed(prints: DataFrame, ring: Ring) -> DataFrame:
    """Every print under each of its segments: segment, value, chain (the bits after it), node."""
    length, chain = ring.length, ring.chain * ring.length

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                bits = _bits(part.column(1).to_pylist())[:, : length * ring.segments]
                round_ = np.concatenate([bits, bits[:, :chain]], axis=1)
                for s in range(ring.segments):
                    at = s * length
                    value = (_packed(bits[:, at : at + length]) >> np.uint64(64 - length)).astype(np.int64)
                    after = _packed(round_[:, at + length : at + length + chain]).view(np.int64)
                    columns = [pa.array(np.full(part.num_rows, s, np.int32)), pa.array(value), pa.array(after), part.column(0)]
                    yield pa.RecordBatch.from_arrays(columns, ["segment", "value", "chain", "node"])

    return prints.select("node", "print").mapInArrow(file, "segment int, value long, chain long, node long")


def _within(differ: np.ndarray, ring: Ring) -> np.ndarray:
    """Whether chains that differ in these bits stay within their budgets."""
    good = np.ones(differ.shape, bool)
    for i, budget in enumerate(ring.budgets()):
        good &= np.bitwise_count(differ & np.uint64((1 << 64) - (1 << 64 - (i + 1) * ring.length))) <= budget
    return good


def _first_look(chain: np.ndarray, node: np.ndarray, run: np.ndarray, ring: Ring, few: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of a file whose chains stay within their budgets: all of a small file, of others for each row the nearest before it.

    Rows are sorted by file (run) and chain. All files are gone through at once: rows 1, 2, 3, … places apart, as long as there are any in one file.
    """
    new = np.concatenate([[True], run[1:] != run[:-1]])
    number = np.cumsum(new) - 1
    before = np.arange(len(run)) - np.flatnonzero(new)[number]
    small = (np.bincount(number) <= few)[number]
    least, nearest = np.full(len(node), 65, np.int64), np.full(len(node), -1, np.int64)
    one, other = [], []
    here = np.flatnonzero(before >= 1)
    for apart in range(1, _NEAR + 1):
        here = here[before[here] >= apart]
        if not len(here):
            break
        differ = chain[here] ^ chain[here - apart]
        good = _within(differ, ring)
        at, far = here[good], np.bitwise_count(differ[good]).astype(np.int64)
        one.append(at[small[at]])
        other.append(at[small[at]] - apart)
        better = ~small[at] & (far < least[at])
        least[at[better]] = far[better]
        nearest[at[better]] = at[better] - apart
    found = np.flatnonzero(nearest >= 0)
    return node[np.concatenate([*one, found])], node[np.concatenate([*other, nearest[found]])]


def _candidates(filed: DataFrame, ring: Ring, few: int = _FEW) -> DataFrame:
    """u and v of nodes whose chains agree, u above v, and in rows without them the segment and value of files that gave only their nearest pairs.

    Files of up to `few` members give all their pairs.
    """
    names = ["u", "v", "segment", "value"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def met() -> Iterator[pa.RecordBatch]:
            segment, value, chain, node = (np.concatenate(c) for c in zip(*held))
            new = np.concatenate([[True], (segment[1:] != segment[:-1]) | (value[1:] != value[:-1])])
            run = np.cumsum(new)
            one, other = _first_look(chain.view(np.uint64), node, run, ring, few)
            # A pair that agrees in several segments is told once per batch.
            pairs = np.unique(np.stack([np.maximum(one, other), np.minimum(one, other)], 1), axis=0)
            if len(pairs):
                nothing = [pa.nulls(len(pairs), kind) for kind in (pa.int32(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *nothing], names)
            full = np.flatnonzero(new)[np.bincount(run)[1:] > few]
            if len(full):
                nothing = pa.nulls(len(full), pa.int64())
                yield pa.RecordBatch.from_arrays([nothing, nothing, pa.array(segment[full]), pa.array(value[full])], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            segment, value = columns[:2]
            # The last file of a batch may go on in the next.
            inside = np.flatnonzero((segment != segment[-1]) | (value != value[-1]))
            if not len(inside) and held and (held[-1][0][-1], held[-1][1][-1]) == (segment[-1], value[-1]):
                held.append(columns)
                continue
            end = int(inside[-1]) + 1 if len(inside) else 0
            held.append(tuple(c[:end] for c in columns))
            if sum(len(h[0]) for h in held):
                yield from met()
            held[:] = [tuple(c[end:] for c in columns)]
        if held and len(held[0][0]):
            yield from met()

    parts = int(filed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = filed.repartition(parts, "segment", "value").sortWithinPartitions("segment", "value", "chain", "node")
    return together.mapInArrow(compare, "u long, v long, segment int, value long").distinct()


def _blocks(filed: DataFrame, full: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of the full files (segment, value) that hold more than one group, dealt so that every two blocks meet once (low, high)."""
    members = filed.join(full, ["segment", "value"], "left_semi").join(roots, "node", "left")
    members = keep(members.withColumn("root", F.coalesce("root", "node")))
    mixed = members.groupBy("segment", "value").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    blocks = mixed.filter("low <> high").select("segment", "value", F.ceil(F.col("n") / _MEMBERS).cast("int").alias("blocks"))
    dealt = members.join(blocks, ["segment", "value"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    return met.select("segment", "value", low, high, "block", "chain", "node", "root")


def _meetings(group: pa.Table, ring: Ring) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a group of blocks of pairs of different groups whose chains agree."""
    low, high, block, chain, node, root = (group.column(c).to_numpy() for c in ("low", "high", "block", "chain", "node", "root"))
    chain, one, other = chain.view(np.uint64), np.flatnonzero(block == low), np.flatnonzero(block == high)
    for start in range(0, len(one), 256):
        part = one[start : start + 256]
        good = (root[part][:, None] != root[other]) & _within(chain[part][:, None] ^ chain[other], ring)
        if low[0] == high[0]:
            good &= node[part][:, None] < node[other]
        at, to = np.nonzero(good)
        yield part[at], other[to]


def _across(filed: DataFrame, full: DataFrame, roots: DataFrame, ring: Ring) -> DataFrame:
    """(u, v) of nodes of different groups whose chains agree, of all members of the full files (segment, value).

    Members that links join already need no further link. The others are dealt to blocks, and every two blocks meet in a group of
    their own, so no task holds a file.
    """

    def compare(group: pa.Table) -> pa.Table:
        node, pairs = group.column("node").to_numpy(), [np.zeros((0, 2), np.int64)]
        for at, to in _meetings(group, ring):
            u, v = node[at], node[to]
            pairs.append(np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1), axis=0))
        pairs = np.concatenate(pairs)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    return _blocks(filed, full, roots).groupBy("segment", "value", "low", "high").applyInArrow(compare, "u long, v long").distinct()


def _first_segment(differ: np.ndarray, ring: Ring) -> np.ndarray:
    """The first segment in which pairs of fingerprints that differ in these words agree, chain included."""
    bits = np.unpackbits(differ.astype(">u8").view(np.uint8), axis=1)[:, : ring.length * ring.segments]
    masks = bits.reshape(len(bits), ring.segments, ring.length).sum(axis=2, dtype=np.int64)
    good, after = masks == 0, np.zeros(masks.shape, np.int64)
    for i, budget in enumerate(ring.budgets()):
        after += np.roll(masks, -1 - i, axis=1)
        good &= after <= budget
    return np.argmax(good, axis=1)


def _near_meetings(group: pa.Table, ring: Ring) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of _meetings whose whole fingerprints differ within the distance. Of all files a pair meets in, only the first tells it."""
    segment = group.column("segment")[0].as_py()
    prints = np.frombuffer(b"".join(group.column("print").to_pylist()), np.uint64).reshape(group.num_rows, -1)
    for at, to in _meetings(group, ring):
        for start in range(0, len(at), 4096):
            one, other = at[start : start + 4096], to[start : start + 4096]
            differ = prints[one] ^ prints[other]
            near = np.flatnonzero(np.bitwise_count(differ).sum(axis=1) <= ring.most)
            near = near[_first_segment(differ[near], ring) == segment]
            if len(near):
                yield one[near], other[near]


def _links_across(filed: DataFrame, full: DataFrame, roots: DataFrame, nodes: DataFrame, ring: Ring, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v) of similar texts that join the groups which meet in full files, as many as it takes to join them.

    All pairs that _across would give are looked at, but where their members lie: a crowd of texts just below the bound has pairs by the
    square of its size, and neither they nor their shingles travel. What travels is a member once per file and block it meets.
    """
    by, names = ["segment", "value", "low", "high"], ["segment", "value", "low", "high", "block", "chain", "node", "root", "print"]

    def wanted(group: pa.Table) -> pa.Table:
        met = [np.zeros(0, np.int64), *(np.concatenate(pair) for pair in _near_meetings(group, ring))]
        return group.take(pa.array(np.unique(np.concatenate(met)))).select(names)

    def link(group: pa.Table) -> pa.Table:
        node, root, found = group.column("node").to_pylist(), group.column("root").to_pylist(), []
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group.column("shingles")]
        above: dict[int, int] = {}

        def top(r: int) -> int:
            while r in above:
                above[r] = r = above.get(above[r], above[r])
            return r

        for at, to in _near_meetings(group, ring):
            for i, j in zip(at.tolist(), to.tolist()):
                one, other = top(root[i]), top(root[j])
                if one != other and _alike(sets[i], sets[j], similarity):
                    above[max(one, other)] = min(one, other)
                    found.append((max(node[i], node[j]), min(node[i], node[j])))
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    met = _blocks(filed, full, roots).join(nodes.select("node", "print"), "node").select(*names)
    schema = "segment int, value long, low int, high int, block int, chain long, node long, root long, print binary"
    members = keep(met.groupBy(*by).applyInArrow(wanted, schema))
    sets = _sets(members.select("node").distinct(), docs, shingle)
    return members.join(sets, "node").groupBy(*by).applyInArrow(link, "u long, v long").distinct()


def _near(pairs: DataFrame, prints: DataFrame, ring: Ring) -> DataFrame:
    """The pairs whose whole fingerprints differ within the distance, and by how much (far)."""
    prints = prints.select("node", "print")
    both = pairs.join(prints.withColumnsRenamed({"node": "u", "print": "one"}), "u").join(prints.withColumnsRenamed({"node": "v", "print": "other"}), "v")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, other = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
                far = np.bitwise_count(one ^ other).sum(axis=1).astype(np.int64)
                good = pa.array(np.flatnonzero(far <= ring.most))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good), pa.array(far).take(good)], ["u", "v", "far"])

    return both.select("u", "v", "one", "other").mapInArrow(differ, "u long, v long, far long")


def _sets(wanted: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """node and shingles of the texts whose hashes are wanted (node)."""
    # Written, so that its size is known before the join is planned: texts travel only where the list is too long to be sent out.
    wanted = keep(wanted)
    text = F.coalesce("text", F.lit(""))
    texts = pick(docs, "text").select(F.xxhash64(text).alias("node"), text.cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_buffer().to_pybytes(), shingle, hashes).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    # Copies of a text are read once each where they lie, and one of their equal sets goes on.
    return keep(texts.join(wanted, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(cut, "node long, shingles binary"))


def _alike(one: np.ndarray, other: np.ndarray, similarity: float) -> bool:
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return shared >= similarity * (len(one) + len(other) - shared)


def _similar(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs of text hashes (u, v) whose texts have shingle sets at least as similar as the bound."""
    sets = _sets(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), docs, shingle)
    both = pairs.join(sets.withColumnsRenamed({"node": "u", "shingles": "one"}), "u").join(sets.withColumnsRenamed({"node": "v", "shingles": "other"}), "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (one, other) in enumerate(zip(batch.column(2), batch.column(3))):
                if _alike(np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64), similarity):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(good, pa.int64())) for i in (0, 1)], ["u", "v"])

    return both.select("u", "v", "one", "other").mapInArrow(compare, "u long, v long")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v) that no links join yet."""
    both = pairs
    for c in ("u", "v"):
        both = both.join(roots.withColumnsRenamed({"node": c, "root": f"_{c}"}), c, "left")
    return both.filter(F.coalesce("_u", "u") != F.coalesce("_v", "v")).select("u", "v")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links (u, v). Only the groups that they join are gone through again, each as one node."""
    ends = links
    for c in ("u", "v"):
        ends = ends.join(roots.withColumnsRenamed({"node": c, "root": f"_{c}"}), c, "left")
    merged = components(ends.select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v")))
    below = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left")
    return keep(below.select("node", F.coalesce("_top", "root").alias("root")).unionByName(merged))


def near_copy_groups(docs: DataFrame, nodes: DataFrame, ring: Ring, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of texts that links of similar texts join; roots and texts without a link are not listed. Nodes have node and print.

    Every text is first held against its nearest candidate. Of all other candidates, those that the links found join already
    can change nothing; the rest are compared each.
    """
    filed = _filed(nodes, ring)
    found = keep(_candidates(filed, ring, _UNRELATED))
    near = keep(_near(found.filter("u IS NOT NULL").select("u", "v"), nodes, ring))
    first = near.groupBy("u").agg(F.min_by("v", F.struct("far", "v")).alias("v"))
    links = keep(_similar(first, docs, shingle, similarity))
    roots = components(links)
    rest = keep(_apart(near.select("u", "v").join(first, ["u", "v"], "left_anti"), roots))
    more = keep(_similar(rest, docs, shingle, similarity))
    if not more.isEmpty():
        roots = _joined(roots, more)
    full = keep(found.filter("u IS NULL").select("segment", "value"))
    if full.isEmpty():
        return roots
    more = keep(_links_across(filed, full, roots, nodes, ring, docs, shingle, similarity))
    return roots if more.isEmpty() else _joined(roots, more)


def _row_key(doc_id: Column, text_hash: Column) -> dict[str, Column]:
    return {"_key": F.coalesce(doc_id, F.lit(0)), "_none": doc_id.isNull(), "_hash": text_hash}


def first_of_near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of docs (doc_id, text, …) that stay: of each group of near copies the document with the smallest doc_id, once.

    Two documents are near copies if the sets of their word shingles have a Jaccard similarity of at least `similarity`; groups are
    the documents connected by links found. A null text counts as empty; texts without words are copies of each other; a text
    shorter than a shingle is one shingle. Rows that repeat a doc_id and its text count as one document; of several texts under
    one doc_id the one with the smallest hash stays, and a document without an id only where none of its group has one. All columns are
    returned; an empty table stays empty. Texts of any length are read whole. Candidates meet within files of equal segments. Files of many members
    give their nearest pairs first; then all their members that are not in one group by then are compared with each other.
    """
    ship_package(docs.sparkSession)
    ring = Ring.of(docs.count(), similarity)
    prints = keep(_fingerprints(docs, shingle, ring.words))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    nodes = keep(prints.groupBy(F.col("text_hash").alias("node")).agg(F.min(order).alias("first"), F.first("print").alias("print")))
    roots = near_copy_groups(docs, nodes, ring, shingle, similarity)
    grouped = nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    stay = grouped.groupBy("root").agg(F.min_by("node", F.struct("first", "node")).alias("node")).select("node")
    nodes = keep(nodes.join(stay, "node", "left_semi"))
    first = nodes.select(F.col("first.doc_id").alias("doc_id"), F.col("node").alias("text_hash"))
    names = docs.columns
    lowered = [c.lower() for c in names]
    at, text = (f"_{names.index(n) if n in names else lowered.index(n)}" for n in ("doc_id", "text"))
    rows = docs.toDF(*[f"_{i}" for i in range(len(names))])
    # Ids without nulls, so that the rows of a document lie together and in order after the join, whether it is there once or more often:
    # texts travel once, and as much at every size, which a broadcast of a short list would not.
    key = ["_key", "_none", "_hash"]
    keyed = rows.withColumns(_row_key(F.col(at).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit("")))))
    stay = first.select(*[c.alias(name) for name, c in _row_key(F.col("doc_id"), F.col("text_hash")).items()])
    return keyed.join(stay.hint("merge"), key, "left_semi").dropDuplicates(key).select(*rows.columns).toDF(*names)
