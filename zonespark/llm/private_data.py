"""Personal data: four fixed patterns, and a character-level bidirectional LSTM with CRF transitions for other ways to write the same.

The network learns in numpy from the spans that the patterns find in a bounded sample of documents, as they stand and rewritten
the way people evade patterns: `a [at] b.org`, numbers without their plus or with other separators. Overlapping windows are decoded
to tag probabilities; where windows overlap these are averaged, those from the middle of a window counting most, and one path over the
whole run of windows decides. A span that the path finds is added where it is sure enough, has the digits or parts of its
kind, and meets no span of the patterns. Only windows with a digit or an at sign are decoded, as no kind goes without.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonespark.llm import sequence_tagger as tagger
from zonespark.llm.common import keep, pick, smallest_hashes
from zonespark.shipping import ship_package

# The kinds in their order, and the patterns of the base kinds. They find what the plain patterns find, but
# never look at a character twice: a run of digits is entered at its start only, and addresses are sought from their at sign.
BASE = ["email", "ip", "card", "phone"]
ADDED = [f"{kind}_like" for kind in BASE]
KINDS = BASE + ADDED
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Length of a window, and how far one starts after the other.
WINDOW, STRIDE = 64, 32
_TRIGGER = re.compile(r"[0-9@]+")
_WRITTEN_AT = re.compile(r"[\[(]at[\])]", re.IGNORECASE)
#: Windows read at once; texts held at once; characters from which on a run is cut in two, or decoded by itself.
_TOGETHER, _ROWS, _SECTION, _LONG_RUN = 256, 512, 1 << 16, 2048
_TAGS = 1 + 2 * len(BASE)
_SPANS = "array<struct<kind: string, start: long, `end`: long>>"

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _bytes_of(parts: list[str]) -> bool:
    stripped = [p.lstrip("0") for p in parts]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in stripped)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1  # No address reaches over an at sign.
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base kinds, by kind and then start; ends are exclusive."""
    spans = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        spans += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _bytes_of(m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans.append((2, m.start(), m.end()))
        if "+" in text:
            spans += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return spans


def _windows(text: str) -> list[int]:
    """Where the windows begin that hold a digit or an at sign, in order."""
    cells: set[int] = set()
    for pattern in (_TRIGGER, _WRITTEN_AT):
        for m in pattern.finditer(text):
            cells.update(range(max(m.start() // STRIDE - 1, 0), (m.end() - 1) // STRIDE + 1))
    return [c * STRIDE for c in sorted(cells)]


def _tags(length: int, spans: list[Span], start: int) -> np.ndarray:
    """Tags of a window: 0 outside, 1 + 2 * kind where a span begins and one more inside it. Of overlapping spans the first kind counts."""
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        a, b, begun = max(a - start, 0), min(b - start, length), a >= start
        if a < b and not tags[a:b].any():
            tags[a:b] = 2 + 2 * kind
            if begun:
                tags[a] = 1 + 2 * kind
    return tags


_ALLOWED = np.ones((_TAGS, _TAGS), bool)
_ALLOWED[:, 2::2] = False
for _kind in range(len(BASE)):
    _ALLOWED[[1 + 2 * _kind, 2 + 2 * _kind], 2 + 2 * _kind] = True
_STARTS = np.array([t == 0 or t % 2 == 1 for t in range(_TAGS)])


def rewritten(kind: int, text: str, rng: np.random.Generator) -> str:
    """A span of a base kind as it might be written to pass a pattern."""
    def one(*ways: str) -> str:
        return ways[rng.integers(len(ways))]

    digits = "".join(_DIGIT.findall(text))
    if kind == 0:
        name, _, host = text.partition("@")
        dot = one(".", " [dot] ", "[.]", " (dot) ") if rng.random() < 0.5 else "."
        return name + one(" [at] ", "[at]", " (at) ", " @ ", "(at)", "[@]") + host.replace(".", dot)
    if kind == 1:
        return text.replace(".", one("[.]", "(.)", " . ", "[dot]"))
    if kind == 2:
        size = int(rng.integers(3, 6))
        return one(".", "_", "/", "  ", " - ").join(digits[i : i + size] for i in range(0, len(digits), size))
    area, rest = digits[-10:-7] or "30", digits[-7:]
    country = one("00", "00 ", "") + (digits[:-10] or "1") if rng.random() < 0.5 else ""
    gap = one(" ", "-", ".", "/")
    return (country + gap if country else "") + one(f"({area}) ", area + gap) + rest[:3] + gap + rest[3:]


def _renamed(text: str, rng: np.random.Generator) -> str:
    """A text with other letters and digits in the same places."""
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    return "".join(
        letters[rng.integers(26)] if "a" <= c <= "z" else digits[rng.integers(10)] if "0" <= c <= "9" else c for c in text
    )


def _examples(rows: list, examples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """About as many windows with their tags, from labelled pieces of text (text, spans): as they stand, renamed, and rewritten."""
    rng = np.random.default_rng(seed)
    x, y = [], []

    def add(text: str, spans: list[Span], near: int) -> None:
        # Windows are cut anywhere around a place, through spans as well.
        start = int(rng.integers(max(0, near - WINDOW + 8), max(near - 7, 1)))
        start = max(0, min(start, len(text) - WINDOW // 2))
        x.append(tagger.symbols(text[start : start + WINDOW], WINDOW))
        y.append(_tags(WINDOW, spans, start))

    labelled = [(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in rows]
    with_span, plain = [r for r in labelled if r[1]], [r for r in labelled if not r[1]]
    for i in range(examples):
        if plain and i % 4 == 0:
            text, _ = plain[i // 4 % len(plain)]
            add(_renamed(text, rng) if i % 8 else text, [], int(rng.integers(0, len(text) + 1)))
            continue
        text, spans = with_span[i % len(with_span)]
        k, a, b = spans[rng.integers(len(spans))]
        if i % 4 == 1 or len(spans) > 1:
            add(text, spans, (a + b) // 2)
            continue
        new = _renamed(text[a:b], rng) if k != 1 else text[a:b]
        new = rewritten(k, new, rng) if i % 4 == 2 else new
        add(text[:a] + new + text[b:], [(k, a, a + len(new))], a + len(new) // 2)
    return np.stack(x), np.stack(y)


def labelled_pieces(docs: DataFrame, max_documents: int, max_pieces: int) -> list:
    """(text, spans) of a bounded sample: pieces around digits and at signs, with the spans that the patterns find in them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for text in batch.column(0).to_pylist():
                spans, rows = base_spans(text), []
                for start in _windows(text)[::2]:
                    first, last = max(0, start - STRIDE), start + WINDOW + STRIDE
                    whole = [(k, a - first, b - first) for k, a, b in spans if first <= a and b <= last]
                    if len(whole) == sum(a < last and b > first for _, a, b in spans):
                        rows.append((text[first:last], [{"kind": k, "start": a, "end": b} for k, a, b in whole]))
                if rows:
                    pieces, found = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(found, kind)], ["text", "spans"])

    texts = pick(docs, "text").filter("text is not null").select("text", F.xxhash64("text").alias("h"))
    # Only hashes are sorted; the texts of the sample, at most max_documents, are all that travels.
    few = keep(smallest_hashes(texts.select("h").distinct(), "h", max_documents))
    sample = texts.join(F.broadcast(few), "h", "left_semi").dropDuplicates(["h"]).select("text")
    pieces = keep(sample.mapInArrow(cut, "text string, spans array<struct<kind: long, start: long, `end`: long>>"))
    numbered = pieces.withColumn("h", F.xxhash64("text"))
    some = [
        keep(smallest_hashes(numbered.filter(which), "h", bound)).select("text", "spans")
        for which, bound in (("size(spans) > 0", max_pieces), ("size(spans) = 0", max_pieces // 2))
    ]
    return [row for part in some for row in part.orderBy("text").collect()]


def train(docs: DataFrame, max_documents: int = 20_000, max_pieces: int = 600, examples: int = 1800, seed: int = 7) -> tagger.Model | None:
    """The network, trained on the labelled spans of a bounded sample of docs (text); None if the sample has no span."""
    ship_package(docs.sparkSession)
    rows = labelled_pieces(docs, max_documents, max_pieces)
    if not any(r["spans"] for r in rows):
        return None
    return tagger.train(*_examples(rows, examples, seed), _TAGS, seed=seed)


def _plausible(kind: int, text: str) -> bool:
    """Whether a decoded span has what its kind needs, however it is written."""
    digits = "".join(_DIGIT.findall(text))
    if kind == 0:
        joined = re.sub(r"\s*[\[(]\s*(?:dot|\.)\s*[\])]\s*", ".", text, flags=re.IGNORECASE)
        joined = re.sub(r"\s*[\[(]\s*(?:at|@)\s*[\])]\s*|\s+@\s+", "@", joined, flags=re.IGNORECASE)
        return next(_emails(joined), None) == (0, len(joined))
    if kind == 1:
        parts = re.split(r"[^0-9]+", text)
        return len(parts) == 4 and all(parts) and _bytes_of(parts)
    if re.search(r"[A-Za-z]", text):
        return False
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and len(re.findall(r"[^0-9]+", text)) >= 2


_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]


class _Run:
    """Overlapping windows of one text: where they begin, and the weighted sums of each character's tag probabilities."""

    def __init__(self, place: int, start: int, sums: np.ndarray, weights: np.ndarray):
        self.place, self.start, self.last = place, start, start
        self.sums, self.weights = [sums], [weights]
        self.length = len(sums)

    def add(self, sums: np.ndarray) -> None:
        shared = WINDOW - STRIDE
        self.sums[-1][-shared:] += sums[:shared]
        self.weights[-1][-shared:] += _WEIGHT[:shared]
        self.sums.append(sums[shared:].copy())
        self.weights.append(_WEIGHT[shared:].copy())
        self.last, self.length = self.last + STRIDE, self.length + STRIDE

    def chances(self, text: str) -> np.ndarray:
        size = min(self.length, len(text) - self.start)
        return np.concatenate(self.sums)[:size] / np.concatenate(self.weights)[:size]

    def cut(self) -> "_Run":
        """Shorten the run to the place near its end that most likely lies outside any span, and return the rest as a run."""
        sums, weights = np.concatenate(self.sums), np.concatenate(self.weights)
        near = self.length - 3 * WINDOW
        at = near + int((sums[near : near + WINDOW, 0] / weights[near : near + WINDOW, 0]).argmax())
        rest = _Run(self.place, self.start + at, sums[at:], weights[at:])
        rest.last = self.last
        self.sums, self.weights, self.length = [sums[:at]], [weights[:at]], at
        return rest


def _runs(model: tagger.Model, texts: list[str]) -> Iterator[_Run]:
    """The runs of overlapping windows of some texts, each of at most _SECTION characters and a few. Windows are read many at a time."""
    every = ((place, start) for place, text in enumerate(texts) for start in _windows(text))
    run = None
    while some := list(islice(every, _TOGETHER)):
        read = tagger.marginals(model, np.stack([tagger.symbols(texts[p][s : s + WINDOW], WINDOW) for p, s in some]))
        for (place, start), sums in zip(some, read * _WEIGHT):
            if run is not None and run.place == place and run.last + STRIDE == start:
                run.add(sums)
                if run.length >= _SECTION:
                    rest = run.cut()
                    yield run
                    run = rest
            else:
                if run is not None:
                    yield run
                run = _Run(place, start, sums.copy(), _WEIGHT.copy())
    if run is not None:
        yield run


def added_spans(model: tagger.Model, texts: list[str], base: list[list[Span]], min_confidence: float) -> list[list[Span]]:
    """For each text, the spans the network adds to its base spans: (kind, start, end) with kinds counted on after the base."""
    found: list[list[Span]] = [[] for _ in texts]
    busy: dict[int, tuple[list[int], list[int]]] = {}

    def free(place: int, a: int, b: int) -> bool:
        if place not in busy:
            ordered = sorted((s, e) for _, s, e in base[place])
            busy[place] = [s for s, _ in ordered], list(accumulate((e for _, e in ordered), max))
        starts, ends = busy[place]
        i = bisect_left(starts, b)
        return i == 0 or ends[i - 1] <= a

    def judge(runs: list[tuple[_Run, np.ndarray]]) -> None:
        for (run, chances), path in zip(runs, tagger.best_paths([c for _, c in runs], _ALLOWED, _STARTS)):
            for begin in np.flatnonzero(path % 2 == 1):
                kind = int(path[begin] - 1) // 2
                end = begin + 1
                while end < len(path) and path[end] == path[begin] + 1:
                    end += 1
                sure = float(chances[np.arange(begin, end), path[begin:end]].mean())
                a, text = run.start + int(begin), texts[run.place]
                b = run.start + int(end)
                if sure >= min_confidence and free(run.place, a, b) and _plausible(kind, text[a:b]):
                    found[run.place].append((len(BASE) + kind, a, b))

    held: list[tuple[_Run, np.ndarray]] = []
    for run in _runs(model, texts):
        chances = run.chances(texts[run.place])
        if len(chances) > _LONG_RUN:
            judge([(run, chances)])
            continue
        held.append((run, chances))
        if len(held) == _TOGETHER:
            judge(held)
            held = []
    judge(held)
    return [sorted(spans) for spans in found]


def find_private(docs: DataFrame, model: tagger.Model | None, min_confidence: float = 0.9) -> DataFrame:
    """doc_id and found, an array of (kind, start, end), of every row of docs (doc_id, text).

    Spans are in code points of the whole text, ends exclusive, by kind in the order of KINDS and then by start. Those of the base
    kinds are always there; a model adds others. A null text counts as empty and has no spans; repeated rows come out repeated, null ids stay null; an empty table
    gives an empty result; other columns are ignored. Texts of any length are read whole, window by window.
    """
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, _ROWS) for i in range(0, batch.num_rows, _ROWS)):
                texts = part.column(1).to_pylist()
                base = [base_spans(t) for t in texts]
                more = added_spans(sent.value, texts, base, min_confidence) if sent.value is not None else [[]] * len(texts)
                rows = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in [*one, *two]] for one, two in zip(base, more)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, spans)], ["doc_id", "found"])

    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(scan, f"doc_id long, found {_SPANS}")


def private_data(docs: DataFrame, max_documents: int = 20_000, max_pieces: int = 600, min_confidence: float = 0.9) -> DataFrame:
    """find_private with a network trained on docs itself. The bounds are those of the sample it is trained on."""
    return find_private(docs, train(docs, max_documents, max_pieces), min_confidence)
