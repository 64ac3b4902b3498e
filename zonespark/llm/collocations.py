"""Phrase collocation mining by partitioning (SON): complete mining of shards, then one exact count of what they found.

Documents are dealt over a few shards of equal share. A phrase that occurs `support` times in a language occurs in some shard at
least as often as that shard's share of the support demands, so the union of the phrases that reach the lowered
support in some shard holds every phrase sought. A shard is mined by as many tasks as its documents fill: first all pairs of words,
then longer phrases of which every pair is frequent. The union is then counted over all documents, by the phrases themselves.

While shards are mined a phrase is a 64-bit hash, and what one pass over the texts tells the next is a bitmap of hashes, of bounded
size. Phrases that share a hash or a bit can only be counted in vain: the last count is exact, and decides.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonespark.llm.common import keep, pick, split_blocks
from zonespark.shipping import ship_package

LONGEST = 4
NO_LANGUAGE = "und"
_BREAK = b"."
# The characters that end a piece become a full stop, which no word can hold; a tab separates words like a space.
_MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".........." + b" ")
#: Words a task counts at a time, and different words it remembers.
_STEP, _REMEMBERED = 1 << 19, 1 << 18
#: Bits of a word's number, a group's and a shard's in a key.
_WORD_BITS, _GROUP_BITS, _SHARD_BITS = 26, 11, 8
# Odd constants that mix 64-bit numbers.
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

Bitmaps = dict[int, np.ndarray]


def _with(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The hash of what h stands for and one value more."""
    x = (h ^ value) * _M1 + _M3
    x = (x ^ x >> np.uint64(30)) * _M2
    x = (x ^ x >> np.uint64(27)) * _M3
    return x ^ x >> np.uint64(31)


def _hash(text: bytes) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(text))


def bitmap(hashes: DataFrame, largest: int = 1 << 28) -> np.ndarray:
    """Bits of the hashes in the column `h`, `largest` (a power of two) at most, set by Spark and sent here 4 KB at a time."""
    size = min(largest, max(1 << 20, 1 << (64 * hashes.count()).bit_length()))
    at = hashes.select(F.col("h").bitwiseAND(F.lit(size - 1)).alias("at"))
    parts = at.groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for row in parts.collect():
        bits[row["part"] * 4096 : (row["part"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _key(hashes: np.ndarray, shards: np.ndarray | None = None) -> np.ndarray:
    """What a phrase is counted by: its hash, with the shard in the highest bits. Bitmaps go by the lowest, whatever the shard."""
    short = hashes >> np.uint64(_SHARD_BITS)
    return short if shards is None else short | shards << np.uint64(64 - _SHARD_BITS)


def held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class _Ids(dict):
    """A number for every word, from 1; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_BREAK: 0})
        self.words = [_BREAK]
        self._hashes = np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number

    def hashes(self) -> np.ndarray:
        new = self.words[len(self._hashes) :]
        self._hashes = np.concatenate([self._hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))])
        return self._hashes


class Texts:
    """A stream of texts as numbers of words, handed on a step at a time."""

    def __init__(self):
        self.ids, self.groups = _Ids(), {}
        self._tokens, self._of, self._waiting = [], [], 0

    def steps(self, texts: Iterator[tuple[tuple, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words, the group of each, whether it is new) of texts with their groups. Words carried over from the step before are not new."""
        for group, text in texts:
            if group not in self.groups and len(self.groups) == 1 << _GROUP_BITS:
                yield from self._step()
                self.groups = {}
            g = self.groups.setdefault(group, len(self.groups))
            self._put(np.zeros(1, np.int64), g)
            for block in split_blocks(text):
                words = block.lower().translate(_MARKS).replace(_BREAK, b" . ").split()
                self._put(np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)), g)
                if self._waiting >= _STEP:
                    # The text may go on: the next step starts with its last words, so that no phrase is torn.
                    again = [self.ids.words[i] for i in np.concatenate(self._tokens)[-(LONGEST - 1) :]]
                    yield from self._step()
                    self._put(np.array([self.ids[w] for w in again], np.int64), -1 - g)
            self._put(np.zeros(1, np.int64), g)
        yield from self._step()

    def _put(self, tokens: np.ndarray, g: int) -> None:
        self._tokens.append(tokens)
        self._of.append(np.full(len(tokens), g, np.int32))
        self._waiting += len(tokens)

    def _step(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self._waiting:
            tokens, of = np.concatenate(self._tokens), np.concatenate(self._of)
            self._tokens, self._of, self._waiting = [], [], 0
            yield tokens, np.where(of >= 0, of, -1 - of).astype(np.int64), of >= 0
            if len(self.ids.words) > _REMEMBERED:
                self.ids = _Ids()

    def shards(self) -> np.ndarray:
        return np.array([s for s, _ in self.groups], np.uint64)

    def language_hashes(self) -> np.ndarray:
        return np.array([_hash(lang.encode()) for _, lang in self.groups], np.uint64)


def _counts(words: bool, hashes: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    of_words = pa.array(np.full(len(hashes), words))
    return pa.RecordBatch.from_arrays([of_words, pa.array(hashes.view(np.int64)), pa.array(times)], ["word", "h", "times"])


def _pairs(stream: Texts, tokens: np.ndarray, g: np.ndarray, new: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Words by language and pairs by shard and language, as hashes with their counts."""
    word_hash, of_language = stream.ids.hashes(), stream.language_hashes()
    real = (tokens > 0) & new
    key, times = np.unique(tokens[real] << _GROUP_BITS | g[real], return_counts=True)
    yield _counts(True, _key(_with(of_language[key & (1 << _GROUP_BITS) - 1], word_hash[key >> _GROUP_BITS])), times)
    pair = (tokens[:-1] > 0) & (tokens[1:] > 0) & new[1:]
    key = (tokens[:-1][pair] << _WORD_BITS | tokens[1:][pair]) << _GROUP_BITS | g[1:][pair]
    key, times = np.unique(key, return_counts=True)
    both, of = key >> _GROUP_BITS, key & (1 << _GROUP_BITS) - 1
    h = _with(_with(of_language[of], word_hash[both >> _WORD_BITS]), word_hash[both & (1 << _WORD_BITS) - 1])
    yield _counts(False, _key(h, stream.shards()[of]), times)


def _numbered(dense: np.ndarray, last: np.ndarray, g: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(where each different phrase stands first, its number at every place), by the number of all words but the last, and the last."""
    key = dense << _WORD_BITS | last
    _, first, number = np.unique(key if g is None else key << _GROUP_BITS | g, return_index=True, return_inverse=True)
    return first, number


def _longer(known: Bitmaps, stream: Texts, tokens: np.ndarray, g: np.ndarray, new: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Phrases of 3 and 4 words of which every pair is frequent in some shard, as hashes with their counts."""
    word_hash = stream.ids.hashes()
    at = np.flatnonzero((tokens[:-1] > 0) & (tokens[1:] > 0))
    h = _with(_with(stream.language_hashes()[g[at]], word_hash[tokens[at]]), word_hash[tokens[at + 1]])
    good = held(known[2], _key(h))
    at, h = at[good], h[good]
    dense = _numbered(tokens[at], tokens[at + 1], g[at])[1]
    pair = np.zeros(len(tokens) + LONGEST, bool)
    pair[at] = True
    for n in range(3, LONGEST + 1):
        more = pair[at + n - 2]
        at, h, dense = at[more], h[more], dense[more]
        if not len(at):
            return
        h = _with(h, word_hash[tokens[at + n - 1]])
        first, dense = _numbered(dense, tokens[at + n - 1], None)
        times = np.bincount(dense[new[at + n - 1]], minlength=len(first))
        out = first[times > 0]
        yield _counts(False, _key(h[out], stream.shards()[g[at[out]]]), times[times > 0])


def _exact(known: Bitmaps, stream: Texts, tokens: np.ndarray, g: np.ndarray, new: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Words and phrases that may be frequent, by language, with their counts; and a row without a phrase that counts all words."""
    word_hash = stream.ids.hashes()
    words, langs = pa.array(stream.ids.words, pa.string()), pa.array([lang for _, lang in stream.groups], pa.string())

    def rows(of: np.ndarray, parts: list[np.ndarray], times: np.ndarray) -> pa.RecordBatch:
        taken = [words.take(pa.array(p)) for p in parts]
        phrases = pc.binary_join_element_wise(*taken, " ") if len(taken) > 1 else taken[0]
        return pa.RecordBatch.from_arrays([langs.take(pa.array(of)), phrases, pa.array(times)], ["lang", "phrase", "times"])

    real = (tokens > 0) & new
    totals = np.bincount(g[real], minlength=len(langs))
    yield pa.RecordBatch.from_arrays([langs, pa.nulls(len(langs), pa.string()), pa.array(totals)], ["lang", "phrase", "times"])
    key, times = np.unique(tokens[real] << _GROUP_BITS | g[real], return_counts=True)
    of, word = key & (1 << _GROUP_BITS) - 1, key >> _GROUP_BITS
    good = held(known[1], _key(_with(stream.language_hashes()[of], word_hash[word])))
    yield rows(of[good], [word[good]], times[good])

    at = np.flatnonzero((tokens[:-1] > 0) & (tokens[1:] > 0))
    # A phrase is sought if it was frequent in any shard, whichever shard it stands in here.
    h, dense = _with(stream.language_hashes()[g[at]], word_hash[tokens[at]]), tokens[at]
    for n in range(2, LONGEST + 1):
        h = _with(h, word_hash[tokens[at + n - 1]])
        good = held(known[min(n, 3)], _key(h))
        at, h, dense = at[good], h[good], dense[good]
        first, dense = _numbered(dense, tokens[at + n - 1], g[at] if n == 2 else None)
        times = np.bincount(dense[new[at + n - 1]], minlength=len(first))
        out = np.flatnonzero(times)
        start = at[first[out]]
        yield rows(g[start], [tokens[start + i] for i in range(n)], times[out])
        # One word more is only worth a look where the phrase that starts a word later is sought as well.
        on = np.zeros(len(tokens) + 1, bool)
        on[at] = True
        more = on[at + 1]
        at, h, dense = at[more], h[more], dense[more]
        if not len(at):
            return


def _counted(docs: DataFrame, count, known: Bitmaps, schema: str, keys: list[str]) -> DataFrame:
    """What a pass over all documents counts, added up by the keys."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Texts()
        texts = (
            ((shard, lang), text.as_buffer().to_pybytes())
            for batch in batches for shard, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
        )
        for step in stream.steps(texts):
            yield from count(sent.value, stream, *step) if known else count(stream, *step)

    return docs.mapInArrow(read, schema).groupBy(*keys).agg(F.sum("times").alias("times"))


def frequent_phrases(docs: DataFrame, support: int = 30, shards: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, totals) of docs (lang, text): lang, phrase and the exact number of times; totals has lang and n, the number of words.

    phrases holds exactly those of 2 to 4 words that occur `support` times or more in their language, words at least all words in them.
    """
    if not 0 < shards <= 1 << _SHARD_BITS:
        raise ValueError("There can be up to 256 shards.")
    ship_package(docs.sparkSession)
    texts = pick(docs, "doc_id", "lang", "text").select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"),
        F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    hashed = "word boolean, h long, times long"
    # The support of a shard, as its share of the whole, rounded up; words are added up over all shards.
    local = -(-support // shards)
    short = keep(_counted(texts, _pairs, {}, hashed, ["word", "h"]).filter(f"times >= CASE WHEN word THEN {support} ELSE {local} END"))
    known = {1: bitmap(short.filter("word")), 2: bitmap(short.filter("NOT word"))}
    longer = keep(_counted(texts, _longer, {2: known[2]}, hashed, ["word", "h"]).filter(f"times >= {local}"))
    known[3] = bitmap(longer)
    exact = keep(_counted(texts, _exact, known, "lang string, phrase string, times long", ["lang", "phrase"]))
    found = exact.filter(F.col("phrase").isNotNull() & (F.col("times") >= support))
    several = F.instr("phrase", " ") > 0
    totals = exact.filter("phrase IS NULL").select("lang", F.col("times").alias("n"))
    return found.filter(several), found.filter(~several), totals


def collocations(docs: DataFrame, support: int = 30, shards: int = 4, top: int = 2000) -> DataFrame:
    """The `top` phrases of 2 to 4 words of each language: lang, rank, phrase, a, l, r, n, score.

    docs has the columns doc_id, lang and text; others are ignored. Words are lower-cased (A-Z) and stand between spaces, tabs and the
    marks `.,;:!?` and line ends, which no phrase spans. A null text counts as empty, a null lang as `und`; repeated rows count each time; an empty
    table gives an empty result. Texts of any length are read whole, in blocks. A phrase that stands inside a longer one nearly as
    frequent (80 %) is left to the longer one. The score is that of the lowest of its cuts, 2,000,000 * a / (l + r) rounded down, ties
    to the cut nearest the start; ranks go by score, then a, both descending, then the phrase in byte order.
    """
    phrases, words, totals = frequent_phrases(docs, support, shards)
    split = phrases.withColumn("w", F.split("phrase", " ")).withColumn("m", F.size("w"))
    # If a longer phrase holds a shorter one nearly as often, so does every phrase between them: one word more is enough.
    inner = split.filter("m > 2").select(
        "lang", F.explode(F.array(F.expr("slice(w, 1, m - 1)"), F.expr("slice(w, 2, m - 1)"))).alias("w"), F.col("times").alias("f")
    )
    held = inner.groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("f").alias("f"))
    free = split.join(held, ["lang", "phrase"], "left").filter("f IS NULL OR 100 * f < 80 * times")
    cuts = free.withColumn("k", F.explode(F.expr("sequence(1, m - 1)"))).select(
        "lang", "phrase", F.col("times").alias("a"), "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"),
        F.array_join(F.expr("slice(w, k + 1, m - k)"), " ").alias("right"),
    )
    counts = phrases.unionByName(words)
    sides = cuts
    for side, name in (("left", "l"), ("right", "r")):
        sides = sides.join(counts.select("lang", F.col("phrase").alias(side), F.col("times").alias(name)), ["lang", side])
    score = F.expr("cast((cast(2000000 as decimal(38,0)) * a) div (l + r) as long)")
    lowest = sides.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # First the best of each part of a language, so that no task sorts a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
