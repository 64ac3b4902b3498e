import re
from collections import Counter
from functools import partial

import numpy as np
import pytest
from odd import odd_documents, rows_of

from zonespark.llm import collocations as C
from zonespark.llm.common import pick


def plain_counts(rows):
    """(phrases by language and length, words by language) by looking at every phrase of every piece."""
    counts = {}
    for lang, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang or "und", Counter())[tuple(words[i : i + k])] += 1
    return counts


def plain_collocations(rows, support, top):
    out = []
    for lang, counts in plain_counts(rows).items():
        found = []
        phrases = {p: f for p, f in counts.items() if len(p) > 1 and f >= support}
        for p, a in phrases.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * f >= 80 * a and inside(q) for q, f in phrases.items()):
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        n = sum(f for p, f in counts.items() if len(p) == 1)
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


TEXTS = [
    "New York City is big. New York City is old, New York is a state", "new york city! is it\tNew  York; City",
    "a b a b a b a b a b", "a b c d a b c d\na b c d e", "É b É b é b", "", None, "one.two.three", "x " * 50, "a b\x00c d\x1fe a b\x00c",
]


@pytest.mark.parametrize("support,shards,top", [(2, 3, 100), (3, 8, 4), (1, 2, 1000)])
def test_phrases_are_those_of_a_plain_count(spark, support, shards, top):
    rows = [(i, ("en", None, "de")[i % 3], t) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = sorted(map(tuple, C.collocations(docs, support, shards, top).collect()))
    assert found == plain_collocations([r[1:] for r in rows], support, top)


def test_steps_of_any_size_count_the_same(monkeypatch):
    text = ("the cat sat on the mat, the cat sat. " * 40 + "one two three four five six seven " * 30).encode()
    whole = _counts([("en", text), ("de", text[:500])])
    monkeypatch.setattr(C, "_STEP", 7)
    monkeypatch.setattr(C, "split_blocks", lambda t: _blocks(t, 60))
    monkeypatch.setattr(C, "_REMEMBERED", 3)
    assert _counts([("en", text), ("de", text[:500])]) == whole



def _blocks(text, size):
    start = 0
    while len(text) - start > size:
        gap = text.find(b" ", start + size)
        if gap < 0:
            break
        yield text[start:gap]
        start = gap
    yield text[start:]


def _counts(texts):
    """What each of the three passes counts, with every phrase sought."""
    total, everything = Counter(), {n: np.full(1 << 10, 255, np.uint8) for n in (1, 2, 3)}
    for count in (C._pairs, partial(C._longer, everything), partial(C._exact, everything)):
        stream = C.Texts()
        for step in stream.steps(((i, lang), text) for i, (lang, text) in enumerate(texts)):
            for batch in count(stream, *step):
                for r in batch.to_pylist():
                    total[r.get("word"), r.get("h"), r.get("lang"), r.get("phrase")] += r["times"]
    return total


def test_bits_are_those_of_the_hashes(spark):
    hashes = np.random.default_rng(1).integers(0, 2**64, 3000, np.uint64)
    bits = C.bitmap(spark.createDataFrame([(int(h),) for h in hashes.view(np.int64)], "h long"))
    assert C.held(bits, hashes).all()
    assert C.held(bits, np.random.default_rng(2).integers(0, 2**64, 3000, np.uint64)).sum() < 60


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    # A bitmap too small to tell anything: every phrase passes, and the exact count decides.
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(TEXTS * 2)], "doc_id long, lang string, text string")
    whole = sorted(map(tuple, C.collocations(docs, 2, 3, 100).collect()))
    smaller = C.bitmap
    monkeypatch.setattr(C, "bitmap", lambda hashes: smaller(hashes) | 255)
    assert sorted(map(tuple, C.collocations(docs, 2, 3, 100).collect())) == whole


def test_every_phrase_reaches_the_support_of_some_shard(spark):
    # Ten documents with the phrase once each: no shard of eight holds many of them.
    docs = spark.createDataFrame([(i, "en", f"u{i} left right v{i}") for i in range(10)], "doc_id long, lang string, text string")
    assert [tuple(r)[:2] for r in C.frequent_phrases(docs, 10, 8)[0].select("phrase", "times").collect()] == [("left right", 10)]


def test_odd_documents(spark):
    docs = odd_documents(spark)
    found = rows_of(C.collocations(docs, 2, 4, 50))
    plain = plain_collocations([(r["lang"], r["text"]) for r in pick(docs, "lang", "text").collect()], 2, 50)
    assert found == sorted(plain, key=repr)
    assert C.collocations(docs.limit(0), 2).collect() == []
