"""Secret scans: three fixed patterns, and password guess-cost dynamic programming on credential-context values.

The value that stands after a credential word is cut into words, dates, repeats, sequences, keyboard walks and
brute-force characters so that the product of their guesses is smallest. A value that even the cheapest cut leaves
hard to guess is a secret, whatever characters it is made of; a placeholder or an ordinary word is not.

Ordinary words are those of a ranked list counted over all documents; any other letters cost what brute force costs.
"""

import hashlib
import re
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import inf, isfinite, log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonespark.llm.common import pick
from zonespark.shipping import ship_package

# The patterns of the base kinds with the least length of what they must find.
KINDS = ["assign", "access", "hex", "guess"]
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A match of [0-9a-f]+ is a whole run, so asking for the length inside finds the same runs.
_HEX = re.compile(r"[0-9a-f]{16,}")

#: What announces a credential, and the value after it.
_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)"""
    r"""["']?\x20{0,8}(?:[:=]|=>|:=)\x20{0,8}["']?([^\s"']{6,})""",
    re.IGNORECASE | re.ASCII,
)
_CLOSING = ".,;:!?)]}>"

#: Words that passwords are made of, the most used first.
WORDS = (
    "password pass admin root user test guest login welcome master secret token key changeme default example sample "
    "qwerty letmein monkey dragon football baseball soccer hockey shadow sunshine princess superman batman trustno "
    "iloveyou love money michael jordan jennifer thomas robert daniel andrew charlie george hunter killer pepper "
    "ginger summer winter spring autumn january february march april june july august september october november "
    "december monday tuesday wednesday thursday friday saturday sunday hello world computer internet server system "
    "network database oracle mysql linux windows google apple orange banana cheese chocolate coffee cookie flower "
    "freedom access account bank business change company correct horse battery staple debug demo develop dummy "
    "family father mother brother sister friend forever game garden green black white yellow purple silver golden "
    "happy house island jackson jessica justin lovely magic matrix mustang nothing pass office phone placeholder "
    "please private public random redacted river school security service star starwars street temp thunder tiger "
    "value whatever your yankees here null none true false insert replace dein passwort geheim mot contrasena clave "
    "everything something anything everyone someone always never"
).split()
_KEYBOARDS = ["`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik9ol0p"]
_LEET = str.maketrans("4@8(3610!|7$52", "aabcegloiitssz"[:14])
_DATE = re.compile(
    r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])"
    r"[-/._]?(?:19|20)\d\d|(?:19|20)\d\d"
)
_LETTERS = re.compile(r"[a-z]{3,16}|[A-Z][a-z]{2,15}|[A-Z]{3,16}")
#: The words that are counted: whole runs of letters, read in lower case.
_COUNTED = re.compile(r"(?<![a-z])[a-z]{3,16}(?![a-z])")


@dataclass(frozen=True)
class GuessCosts:
    """Guesses, as powers of ten, per kind of segment."""

    words: dict[str, float]
    #: Any other run of letters written like a word, if such runs are to have a price of their own and not brute force.
    unknown_word: float = inf
    date: float = 4.2
    #: Each further segment also has to be found.
    joint: float = 0.3
    longest: int = field(default=0)

    @staticmethod
    def ranked(words: list[str]) -> "GuessCosts":
        ranks: dict[str, float] = {}
        for n, w in enumerate(words):
            ranks.setdefault(w.lower(), log10(n + 2))
        return GuessCosts(ranks, longest=max(map(len, ranks), default=0))


DEFAULT_COSTS = GuessCosts.ranked(WORDS)


def _alphabet(c: str) -> float:
    if c.isdigit():
        return 1.0
    return log10(26) if c.isalpha() and c.isascii() else log10(33)


def _runs(value: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, cost) of repeated parts, sequences such as abcd or 9876, and keyboard walks."""
    n = len(value)
    for unit in (1, 2, 3, 4):
        start = 0
        while start < n - unit:
            end = start + unit
            while end < n and value[end] == value[end - unit]:
                end += 1
            if end - start >= 3 * unit or unit > 1 and end - start >= 2 * unit:
                yield start, end, sum(map(_alphabet, value[start : start + unit])) + log10((end - start) // unit + 1)
                start = end - unit + 1
            else:
                start += 1
    start = 0
    while start < n - 2:
        step, end = ord(value[start + 1]) - ord(value[start]), start + 2
        if step in (1, -1):
            while end < n and ord(value[end]) - ord(value[end - 1]) == step:
                end += 1
            if end - start >= 3:
                yield start, end, 1.0 + log10(2 * (end - start))
        start = max(start + 1, end - 1) if step in (1, -1) else start + 1
    lowered = value.lower()
    for row in _KEYBOARDS:
        for keys in (row, row[::-1]):
            start = 0
            while start < n - 2:
                at, end = keys.find(lowered[start]), start + 1
                while at >= 0 and end < n and end - start + at < len(keys) and lowered[end : end + 1] == keys[at + end - start]:
                    end += 1
                if end - start >= 4:
                    yield start, end, 2.0 + log10(end - start)
                start = end if end - start >= 4 else start + 1


def guess_cost(value: str, costs: GuessCosts = DEFAULT_COSTS) -> float:
    """log10 of the guesses of the cheapest segmentation of a value; 0 for an empty one."""
    n = len(value)
    lowered = value.lower()
    lowered = lowered if len(lowered) == n else value
    plain = lowered.translate(_LEET)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for start in range(n):
        for end in range(start + 3, min(n, start + costs.longest) + 1):
            for form, extra in ((lowered, 0.0), (plain, 0.5)):
                cost = costs.words.get(form[start:end])
                if cost is not None:
                    cased = 0.0 if value[start:end] == lowered[start:end] else 0.3
                    ends[end].append((start, cost + extra + cased))
                    break
    if isfinite(costs.unknown_word):
        for match in _LETTERS.finditer(value):
            ends[match.end()].append((match.start(), costs.unknown_word))
    for match in _DATE.finditer(value):
        ends[match.end()].append((match.start(), costs.date))
    for start, end, cost in _runs(value):
        ends[end].append((start, cost))
    best = [0.0] * (n + 1)
    for end in range(1, n + 1):
        least = best[end - 1] + _alphabet(value[end - 1])
        for start, cost in ends[end]:
            least = min(least, best[start] + cost + (costs.joint if start else 0.0))
        best[end] = least
    return best[n]


def counted_words(docs: DataFrame, least_docs: int = 5, most_words: int = 100_000) -> list[str]:
    """Words of the column text by the number of documents they stand in, the most frequent first.

    All documents are counted. Values in a credential context do not count, so a secret that is often repeated there
    makes no word of itself, and neither do words of fewer than `least_docs` documents. The list is as long as a large
    dictionary at most, since a word of a higher rank costs about as much as its letters.
    """
    ship_package(docs.sparkSession)
    texts = pick(docs, "text").filter("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "docs"])

        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(set(_COUNTED.findall(_CONTEXT.sub(" ", text.as_py()).lower())))
                if len(found) > 500_000:
                    yield counted()
                    found.clear()
        yield counted()

    words = texts.mapInArrow(count, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    return [r["word"] for r in words.filter(F.col("docs") >= least_docs).orderBy(F.desc("docs"), "word").limit(most_words).collect()]


def document_costs(docs: DataFrame) -> GuessCosts:
    """Guess costs by the words of the documents and those that passwords are made of, each by its better rank."""
    ranked = GuessCosts.ranked(counted_words(docs)).words
    both = {w: min(c for c in (ranked.get(w), DEFAULT_COSTS.words.get(w)) if c is not None) for w in ranked | DEFAULT_COSTS.words}
    return GuessCosts(both, longest=max(map(len, both)))


def find_spans(text: str, min_cost: float, costs: GuessCosts = DEFAULT_COSTS) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets of a text, in order; kind is a place in KINDS, ends are exclusive."""
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    spans.sort()
    base = list(spans)
    for m in _CONTEXT.finditer(text):
        value = m[1].rstrip(_CLOSING)
        start, end = m.start(1), m.start(1) + len(value)
        if len(value) >= 6 and not any(s <= start and end <= e for s, _, e in base) and guess_cost(value, costs) >= min_cost:
            insort(spans, (start, 3, end))
    return spans


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, min_cost: float = 9.0, words: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans.

    Spans are kind:start:end in code points of the whole text, by start and then by kind. The first three kinds are
    fixed patterns; `guess` marks a value in a credential context that takes at least 10**min_cost guesses and lies in
    no span of the other kinds. `words` replaces the ranked words of the segmentation, which are counted over docs. A null text counts as empty and
    has no spans; repeated rows come out repeated; an empty table gives an empty result; columns other than doc_id and
    text are ignored.
    """
    ship_package(docs.sparkSession)
    costs = document_costs(docs) if words is None else GuessCosts.ranked(words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                spans = find_spans(text.as_py(), min_cost, costs)
                base = _written([s for s in spans if s[1] < 3])
                kinds = [k for _, k, _ in spans]
                rows.append((*map(kinds.count, range(4)), hashlib.sha256(base.encode()).hexdigest(), _written(spans)))
            columns = list(zip(*rows)) if rows else [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    return texts.mapInArrow(scan, schema)


def masked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """A text with every span, or run of overlapping spans, replaced by the mark."""
    parts, done = [], 0
    for start, _, end in spans:
        if start >= done:
            parts += [text[done:start], mark]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def without_secrets(docs: DataFrame, min_cost: float = 9.0, mark: str = "[secret]") -> DataFrame:
    """docs with every found span of the column text replaced; all rows and columns stay, null texts stay null.

    A column n_chars, if there is one, is set to the new length where the text changed.
    """
    ship_package(docs.sparkSession)
    names = docs.columns
    at = names.index("text") if "text" in names else [c.lower() for c in names].index("text")
    length = names.index("n_chars") if "n_chars" in names else None
    costs = document_costs(docs)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = list(batch.columns), batch.column(at).to_pylist()
            spans = [find_spans(t, min_cost, costs) if t else [] for t in texts]
            texts = [masked(t, s, mark) if s else t for t, s in zip(texts, spans)]
            columns[at] = pa.array(texts, pa.string())
            if length is not None:
                old = columns[length].to_pylist()
                sizes = [len(t) if s else n for t, s, n in zip(texts, spans, old)]
                columns[length] = pa.array(sizes, columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    places = docs.toDF(*[f"_{i}" for i in range(len(names))])
    return places.mapInArrow(clean, places.schema).toDF(*names)
