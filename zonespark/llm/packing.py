"""Packing along a space-filling curve: similar documents end up in the same training sequences.

Each document's tokens are hashed into a vector, the vector is projected to a few dimensions, and the place of that
point on a Hilbert curve orders the corpus. Range partitions of the curve are cut into sequences of full length.
"""

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonespark.llm.common import keep, pick, word_blocks
from zonespark.shipping import ship_package

#: Dimensions of the curve and bits of each; together they fit a positive long.
DIMENSIONS, BITS = 4, 15
#: Dimensions of a hashed document vector.
HASHED = 256
#: Entries of each of the two halves of a worker's memory of runs.
REMEMBERED = 250_000
#: Texts read at once.
GROUP_BYTES = 2 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatter integers evenly over 64 bits."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _directions() -> np.ndarray:
    """HASHED x DIMENSIONS matrix with orthonormal columns, the same everywhere."""
    random = np.random.Generator(np.random.PCG64(20))
    return np.linalg.qr(random.standard_normal((HASHED, DIMENSIONS)))[0]


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with `bits` bits per dimension.

    The coordinates are turned, from the highest bit down, into the frame of the sub-cube they lie in; reading the
    resulting Gray code across dimensions gives the place.
    """
    x = [points[:, d].astype(np.int64) for d in range(points.shape[1])]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for d in range(n):
            inside = (x[d] & bit) != 0
            exchanged = np.where(inside, 0, (x[0] ^ x[d]) & below)
            flipped = np.where(inside, x[0] ^ below, x[0])
            x[0] = flipped ^ exchanged
            if d:
                x[d] = x[d] ^ exchanged
    for d in range(1, n):
        x[d] = x[d] ^ x[d - 1]
    turned = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turned = np.where((x[n - 1] >> level) & 1, turned ^ ((1 << level) - 1), turned)
    x = [c ^ turned for c in x]
    key = np.zeros(len(points), np.int64)
    for level in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | (c >> level) & 1
    return key


# The shape of vocabularies that lower-case a text and split letters from marks, as their files state it.
_LOWERING = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks that may end a word and form one run; an apostrophe may not, as it starts runs of its own.
_MARKS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Letters of Latin-1 that have no plain case or are written as compatibility forms.
_ODD_LETTERS = "ªµº"


def _shown_bytes() -> dict[int, int]:
    """How byte-level vocabularies write bytes: visible Latin-1 characters as they are, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + n for n, b in enumerate(hidden)}


class _Remembered:
    """A bounded memory: what was used among the last REMEMBERED new entries, or the REMEMBERED before, is known."""

    def __init__(self):
        self.young, self.old = {}, {}

    def put(self, key, value):
        if len(self.young) >= REMEMBERED:
            self.young, self.old = {}, self.young
        self.young[key] = value
        return value


class _Words:
    """Token ids of words as little-endian unsigned 32-bit bytes; the runs that words are made of are remembered."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.runs = tokenizer, tokenizer.model, _Remembered()
        form = json.loads(tokenizer.to_str())
        steps = [x["type"] for x in (form.get("normalizer") or {}).get("normalizers", [])]
        first = ((form.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.lowering = steps == _LOWERING and (first.get("pattern") or {}).get("Regex") == _SPLIT
        self.shown = _shown_bytes()

    def _run(self, run: bytes, read) -> bytes:
        """The ids of a run, from memory or by reading it; very long ones are not worth the memory."""
        if len(run) > 64:
            return read(run)
        found = self.runs.young.get(run)
        if found is None:
            found = self.runs.old.get(run)
            found = self.runs.put(run, read(run) if found is None else found)
        return found

    def _merged(self, run: bytes) -> bytes:
        """Ids of one run of lower-case letters or of marks, straight from the vocabulary's merges."""
        shown = run.decode("latin-1")
        shown = shown if run.isascii() else shown.translate(self.shown)
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def _encoded(self, word: bytes) -> bytes:
        """Ids of a word as the tokenizer gives them."""
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _split(self, word: bytes) -> tuple[bytes, bytes] | None:
        """A word as letters, in lower case, and marks, if it is plainly that and the vocabulary reads it so."""
        letters = word.rstrip(_MARKS)
        if letters.isalpha():
            return letters.lower(), word[len(letters) :]
        text = letters.decode("utf-8", "replace")
        # Letters of Latin-1 are single characters whatever the normal form, and have single lower-case ones.
        if text.isalpha() and max(text) <= "ÿ" and not any(c in text for c in _ODD_LETTERS):
            return text.lower().encode(), word[len(letters) :]
        return None

    def ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        found = []
        for word in words:
            parts = self._split(word) if self.lowering else None
            if parts is None:
                found.append(self._run(word, self._encoded))
            elif parts[1]:
                found.append(self._run(parts[0], self._merged) + self._run(parts[1], self._merged))
            else:
                found.append(self._run(parts[0], self._merged))
        return found


@lru_cache(maxsize=2)
def _words(name: str) -> _Words:
    """One memory per Python worker, so that a later task goes on with what an earlier one has read."""
    return _Words(_tokenizer(name))


def _tokenizer(name: str):
    import os

    from tokenizers import Tokenizer

    if os.path.sep in name:
        return Tokenizer.from_file(name)
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path(name))


def document_ids(text: bytes, words: _Words, end_id: int) -> bytes:
    """The ids of a whole document, its end id last. The vocabulary drops white space, so words are read one by one."""
    parts = [b"".join(words.ids(block)) for block in word_blocks(text)]
    return b"".join([*parts, np.array([end_id], "<u4").tobytes()])


def documents_ids(texts: pa.StringArray, words: _Words, end_id: int) -> list[bytes]:
    """document_ids of many texts at once: every different word is read once, and its ids are laid out by index."""
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    read = words.ids(coded.dictionary.cast(pa.binary()).to_pylist())
    pool = np.frombuffer(b"".join([*read, np.array([end_id], "<u4").tobytes()]), "<u4")
    sizes = np.array([*(len(r) // 4 for r in read), 1])
    # An end id follows the words of each document.
    counts = split.value_lengths().to_numpy()
    ends = np.cumsum(counts)
    order = np.insert(coded.indices.to_numpy(), ends, len(read))
    lengths = sizes[order]
    last = np.cumsum(lengths)
    first = (np.cumsum(sizes) - sizes)[order]
    laid = pool[np.repeat(first - (last - lengths), lengths) + np.arange(last[-1])]
    stops = last[ends + np.arange(len(counts))]
    return [part.tobytes() for part in np.split(laid, stops[:-1])]


def _grouped(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Consecutive rows in groups of up to GROUP_BYTES of text; a longer text is a group of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + GROUP_BYTES, "right")), start + 1)
        yield start, stop
        start = stop


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, row, key (place on the curve), doc_tokens and ids (little-endian unsigned 32-bit) of every row, written."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, directions = _words(tokenizer), _directions()
        hashed = _mix(np.arange(max(words.tokenizer.get_vocab_size(), end_id + 1)))
        buckets, signs = (hashed % np.uint64(HASHED)).astype(np.int64), np.where(hashed >> np.uint64(63), 1.0, -1.0)
        for batch in batches:
            for start, stop in _grouped(batch.column(2)):
                part = batch.slice(start, stop - start)
                if stop - start == 1:
                    ids = [document_ids(part.column(2)[0].as_buffer().to_pybytes(), words, end_id)]
                else:
                    ids = documents_ids(part.column(2), words, end_id)
                vectors = np.zeros((len(ids), HASHED))
                for n, found in enumerate(ids):
                    places = np.frombuffer(found, "<u4")
                    vectors[n] = np.bincount(buckets[places], signs[places], HASHED)
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                # Coordinates of unit vectors lie between -1 and 1.
                cells = ((vectors @ directions + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
                columns = [part.column(0), part.column(1), pa.array(hilbert_key(cells)), pa.array([len(i) // 4 for i in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], ["doc_id", "row", "key", "doc_tokens", "ids"])

    texts = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return keep(texts.mapInArrow(tokenise, "doc_id long, row long, key long, doc_tokens long, ids binary"))


Piece = tuple[int | None, int, bytes, int]


def _fill(pieces: Iterator[Piece], capacities: Iterator[int]) -> Iterator[list[Piece]]:
    """Lay documents one after the other into sequences of the given capacities, cutting where one is full."""
    held, room = [], next(capacities)
    for doc_id, start, ids, total in pieces:
        at = 0
        while at < len(ids):
            taken = ids[at : at + 4 * room]
            held.append((doc_id, start + at // 4, taken, total))
            at, room = at + len(taken), room - len(taken) // 4
            if not room:
                yield held
                held, room = [], next(capacities, 0)
    if held:
        yield held


def _repeat(capacity: int) -> Iterator[int]:
    while True:
        yield capacity


def pack_documents(
    docs: DataFrame, length: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, partitions: int | None = None
) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ids are little-endian unsigned 32-bit. Sequences have exactly `length` ids; what is left at the end of a range of the
    curve is cut into sequences whose lengths are powers of two, so that none needs padding. `tokenizer` is a file or
    the name of a public one, found where the task runs. A null or empty text is its end id alone; repeated rows are
    packed each; an empty table gives no pieces. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    if length & (length - 1):
        raise ValueError("the length of sequences must be a power of two")
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def stream() -> Iterator[Piece]:
            for batch in batches:
                for doc_id, tokens, ids in zip(*(batch.column(n) for n in ("doc_id", "doc_tokens", "ids"))):
                    yield doc_id.as_py(), 0, ids.as_py(), tokens.as_py()

        rows: list[tuple] = []

        def put(sequence: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for doc_id, start, ids, total in sequence:
                rows.append((doc_id, start, len(ids) // 4, ids, total, number, offset))
                offset += len(ids) // 4
            number += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for sequence in _fill(stream(), _repeat(length)):
            left = sum(len(p[2]) // 4 for p in sequence)
            if left == length:
                put(sequence)
            else:
                for short in _fill(iter(sequence), iter([1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1])):
                    put(short)
            if len(rows) >= 4096:
                yield flush()
        if rows:
            yield flush()

    curve = tokenised(docs, tokenizer, end_id).repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row")
    return curve.select("doc_id", "doc_tokens", "ids").mapInArrow(
        pack, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
