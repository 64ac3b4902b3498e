"""Quality classifier by co-training: one view of the text, one of its metadata.

Each view has a logistic regression of its own. Over several rounds each names the unlabelled documents it is surest
about, and the other learns from them. Both are then calibrated on labelled documents held out from the start, and a
weighted sum of the two calibrated log-odds scores every document.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonespark.llm.common import pick, smallest_hashes, word_blocks
from zonespark.shipping import ship_package

#: Kinds of bytes that the text view counts in pairs; the last two are the bytes of characters beyond ASCII.
KINDS = [
    b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".", b",;:", b"!?",
    b"|", b"#*$%&<>", b"\"'`()[]{}", b"-_/\\@+=~^", b"",
]
N_KINDS = len(KINDS) + 2
SOURCES, LANGUAGES = 32, 8


def _kind_table() -> np.ndarray:
    table = np.full(256, len(KINDS) - 1)
    for n, members in enumerate(KINDS):
        table[list(members)] = n
    table[0x80:0xC0], table[0xC0:] = len(KINDS), len(KINDS) + 1
    return table


def text_features(text: bytes, table: np.ndarray) -> np.ndarray:
    """Shares of pairs of byte kinds, and how much of the text repeats itself. Zeros for an empty text."""
    pairs = np.zeros(N_KINDS * N_KINDS)
    for at in range(0, len(text), 1 << 20):
        kinds = table[np.frombuffer(text[at : at + (1 << 20) + 1], np.uint8)]
        pairs += np.bincount(kinds[:-1] * N_KINDS + kinds[1:], minlength=len(pairs))
    words, again, different, letters = 0, 0, set(), 0
    for block in word_blocks(text):
        words += len(block)
        again += sum(a == b for a, b in zip(block, block[1:]))
        letters += sum(map(len, block))
        different.update(map(hash, block))
    lines = [line for line in text.split(b"\n") if line.strip()]
    n = max(words, 1)
    more = [len(different) / n, again / n, np.log1p(words) / 10, letters / n / 20, (len(lines) - len(set(lines))) / max(len(lines), 1)]
    return np.concatenate([np.sqrt(pairs / max(pairs.sum(), 1)), more]).astype(np.float32)


def _bucket(value: str | None, buckets: int) -> int:
    return 0 if value is None else 1 + xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) % (buckets - 1)


def metadata_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    found = np.zeros(SOURCES + LANGUAGES + 2, np.float32)
    found[_bucket(source, SOURCES)] = 1
    found[SOURCES + _bucket(lang, LANGUAGES)] = 1
    found[-2:] = (0, 1) if n_chars is None else (np.log1p(max(n_chars, 0)) / 10, 0)
    return found


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 8) -> np.ndarray:
    """Weights of a logistic regression, the constant last, by Newton steps on penalised likelihood."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Classifier:
    """Weights of both views, of their combination, and the score from which a document is kept."""

    text: np.ndarray
    metadata: np.ndarray
    combination: np.ndarray
    keep_from: float

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.stack([_odds(text, self.text), _odds(metadata, self.metadata)], axis=1)
        return _logistic(own[:, 0]), _logistic(own[:, 1]), _logistic(_odds(own, self.combination))


def _calibrated(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The weights, scaled and shifted so that their chances hold on (x, y)."""
    scale, shift = fit_logistic(_odds(x, w)[:, None], y, penalty=1e-3)
    fitted = w * max(scale, 1e-3)
    fitted[-1] += shift
    return fitted


def co_train(
    views: tuple[np.ndarray, np.ndarray], labels: np.ndarray, held: np.ndarray, rounds: int = 4, share: float = 0.1,
    confidence: float = 0.97, lost: float = 0.002,
) -> Classifier | None:
    """Fit both views; labels are 1, 0 or -1 for unlabelled. None if either label is missing.

    Per round each view hands the other at most `share` of the unlabelled documents, only those it is confident of. A
    document is kept from one half up, or from lower if more than the share `lost` of the held-out good ones would go.
    """
    known, out = (labels >= 0) & ~held, (labels >= 0) & held
    if any(len(set(labels[part])) < 2 for part in (known, out)):
        return None
    given = [np.where(known, labels, -1), np.where(known, labels, -1)]
    for turn in range(rounds + 1):
        weights = []
        for x, y in zip(views, given):
            w = fit_logistic(x[y >= 0], y[y >= 0])
            weights.append(_calibrated(x[out], labels[out], w))
        if turn == rounds:
            break
        for view in (0, 1):
            p = _logistic(_odds(views[view], weights[view]))
            free = np.flatnonzero((labels < 0) & (given[1 - view] < 0))
            sure = np.maximum(p, 1 - p)[free]
            chosen = free[np.argsort(-sure, kind="stable")[: int(share * (labels < 0).sum()) + 1]]
            chosen = chosen[np.maximum(p, 1 - p)[chosen] >= confidence]
            given[1 - view][chosen] = (p[chosen] >= 0.5).astype(int)
    odds = np.stack([_odds(x, w) for x, w in zip(views, weights)], axis=1)
    combination = fit_logistic(odds[out], labels[out], penalty=1e-3)
    good = np.sort(_logistic(_odds(odds[out & (labels == 1)], combination)))
    return Classifier(*weights, combination, float(min(0.5, good[int(lost * len(good))])))


def _feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_view and metadata_view (both as 32-bit floats) of docs (doc_id, text, source, lang, n_chars)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _kind_table()
        for batch in batches:
            texts = [text_features(t.as_buffer().to_pybytes(), table).tobytes() for t in batch.column(1)]
            others = [metadata_features(*r).tobytes() for r in zip(*(batch.column(n).to_pylist() for n in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), pa.array(others, pa.binary())], names)

    names = ["doc_id", "text_view", "metadata_view"]
    return docs.mapInArrow(features, "doc_id long, text_view binary, metadata_view binary")


def _inputs(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text", "source", "lang", "n_chars").select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"),
        F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"),
    )


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, max_unlabelled: int = 6000) -> Classifier | None:
    """Co-train on at most max_labelled labelled and max_unlabelled other documents, those with the smallest hashed ids."""
    rated = pick(labels, "doc_id", "quality").dropna().groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = smallest_hashes(rated, "doc_id", max_labelled)
    ids = pick(docs, "doc_id").select(F.col("doc_id").cast("long")).dropna()
    unrated = ids.join(rated, "doc_id", "left_anti").distinct()
    other = smallest_hashes(unrated, "doc_id", max_unlabelled).withColumn("quality", F.lit(-1))
    # Broadcast: both samples have a bound.
    chosen = F.broadcast(known.unionByName(other.withColumn("quality", F.col("quality").cast(known.schema["quality"].dataType))))
    rows = _feature_rows(_inputs(docs).join(chosen.select("doc_id"), "doc_id", "left_semi")).groupBy("doc_id").agg(
        F.min("text_view").alias("text_view"), F.min("metadata_view").alias("metadata_view")
    ).join(chosen, "doc_id").select(
        "text_view", "metadata_view", F.col("quality").cast("int"), (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(3)) == 0).alias("held")
    ).collect()
    if not rows:
        return None
    views = tuple(np.stack([np.frombuffer(r[n], np.float32) for r in rows]) for n in (0, 1))
    quality = np.array([r["quality"] for r in rows])
    return co_train(views, np.where(quality < 0, -1, (quality > 0).astype(int)), np.array([r["held"] for r in rows]))


def score_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, max_unlabelled: int = 6000) -> DataFrame:
    """One row per row of docs: doc_id, text_score, metadata_score, score (chance of good quality) and kept.

    The classifier is fitted on bounded samples; every document is scored over its whole text. Null texts count as empty,
    null metadata as a value of its own. If labels lack either class, all scores are one half and all documents are kept.
    Repeated rows come out repeated, and count once in the samples; an empty table gives an empty result; columns other
    than doc_id, text, source, lang and n_chars are ignored.
    """
    ship_package(docs.sparkSession)
    classifier = train(docs, labels, max_labelled, max_unlabelled)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _kind_table()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if classifier is None:
                    found = [np.full(part.num_rows, 0.5)] * 3
                    kept = np.ones(part.num_rows, bool)
                else:
                    texts = np.stack([text_features(t.as_buffer().to_pybytes(), table) for t in part.column(1)])
                    others = np.stack([metadata_features(*r) for r in zip(*(part.column(n).to_pylist() for n in (2, 3, 4)))])
                    found = classifier.scores(texts, others)
                    kept = found[2] >= classifier.keep_from
                columns = [part.column(0), *[pa.array(np.round(f, 6)) for f in found], pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_score", "metadata_score", "score", "kept"])

    return _inputs(docs).mapInArrow(score, "doc_id long, text_score double, metadata_score double, score double, kept boolean")
