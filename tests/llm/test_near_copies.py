import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd import odd_documents

from zonespark.llm import near_copies as N
from zonespark.llm.common import pick

SF = "/root/testdata/sf0.01"


def plain_shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def similarities(texts):
    """Of all pairs that share a shingle."""
    sets = {d: plain_shingles(t) for d, t in texts.items()}
    holding, shared = defaultdict(list), Counter()
    for d, s in sets.items():
        for h in s:
            holding[h].append(d)
    for ids in holding.values():
        shared.update((a, b) for i, a in enumerate(ids) for b in ids[i + 1 :])
    found = {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items()}
    empty = [d for d, s in sets.items() if not s]
    return found | {(empty[0], d): 1.0 for d in empty[1:]}


def plain_groups(texts, similarity=0.8):
    """The smallest id that each text reaches over pairs similar enough."""
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), s in similarities(texts).items():
        if s >= similarity:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d in texts}


def edited(words, share, rng):
    return [f"new{rng.random()}" if rng.random() < share else w for w in words]


def planted(rng, originals, copies):
    """Documents with near copies of their own, by ids that tell the original."""
    texts = {}
    for i in range(originals):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 500))]
        for k in range(copies):
            texts[i * 1000 + k] = " ".join(words if k == 0 else edited(words, rng.choice([0.0, 0.004, 0.01, 0.018]), rng))
    return texts


def kept_ids(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"] for r in N.first_of_near_copies(docs).collect()}


def test_fingerprints_are_majorities():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 64, 1000):
        shingles = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        salts = N._mixed(np.arange(1, 4, dtype=np.uint64) * N._M1)
        bits = np.unpackbits(N._spread(shingles, salts).astype(">u8").view(np.uint8).reshape(len(shingles), -1), axis=1)
        plain = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(shingles)).view(">u8").astype(np.uint64)
        assert (N.fingerprint(shingles, 3) == plain).all()
    assert not N.fingerprint(np.zeros(0, np.uint64), 3).any()


def test_parts_of_long_texts_add_up(monkeypatch):
    shingles = np.unique(np.random.default_rng(3).integers(0, 2**63, 5000).astype(np.uint64))
    whole = N.fingerprint(shingles, 5)
    monkeypatch.setattr(N, "_TOGETHER", 77)
    assert (N.fingerprint(shingles, 5) == whole).all()


def test_shingle_sets_are_those_of_the_words():
    hashes = N._WordHashes()
    for text in ("", " \t\n", "One two", "a b c d e f a b c d e f", "É b\x0bc\x0cd e F g", "x " * 100):
        assert len(N.shingle_set(text.encode(), 5, hashes)) == len(plain_shingles(text))
    assert (N.shingle_set(b"a B c", 5, hashes) == N.shingle_set(b"A  b\nC", 5, hashes)).all()
    assert len(np.intersect1d(N.shingle_set(b"a b c d e f", 5, hashes), N.shingle_set(b"a b c d e g", 5, hashes))) == 1


@pytest.mark.parametrize("documents", [1, 1000, 300_000, 20_000_000, 10**10])
def test_rings_find_pairs_at_the_bound_and_few_others(documents):
    ring = N.Ring.of(documents, 0.8)
    rng = np.random.default_rng(1)
    bits = ring.length * ring.segments
    differ = rng.random((2000, bits)) < ring.share
    masks = differ.reshape(2000, ring.segments, ring.length).sum(axis=2)
    budgets = ring.budgets()
    met = np.zeros(2000, bool)
    for s in range(ring.segments):
        chain = np.cumsum([masks[:, (s + 1 + i) % ring.segments] for i in range(ring.chain)], axis=0)
        met |= (masks[:, s] == 0) & np.all([chain[i] <= budgets[i] for i in range(ring.chain)], axis=0)
    assert (met & (masks.sum(axis=1) <= ring.distance)).mean() > 0.88
    assert 2.0 ** -ring.length * documents <= 1.01 or ring.length == 32


def test_all_near_copies_of_the_given_documents_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    kept = {r["doc_id"] for r in N.first_of_near_copies(docs).collect()}
    pairs = [p for p, s in similarities(texts).items() if s >= 0.8]
    different = [p for p in pairs if plain_shingles(texts[p[0]]) != plain_shingles(texts[p[1]])]
    assert len(different) >= 10
    for some in (pairs, different):
        assert sum(a in kept and b in kept for a, b in some) <= 0.1 * len(some)
    # No group goes altogether, and what resembles nothing stays.
    groups = plain_groups(texts)
    assert set(groups.values()) <= kept and all(groups[d] != d for d in set(texts) - kept)


def test_planted_copies_go_and_their_originals_stay(spark):
    texts = planted(random.Random(5), 120, 4)
    sure = [p for p, s in similarities(texts).items() if s >= 0.8]
    kept = kept_ids(spark, texts)
    assert len(sure) > 300 and sum(a in kept and b in kept for a, b in sure) <= 0.02 * len(sure)
    assert set(plain_groups(texts).values()) <= kept


def test_a_crowd_of_near_copies_leaves_one(spark, monkeypatch):
    monkeypatch.setattr(N, "_NEAR", 8)
    rng = random.Random(7)
    words = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = {i: " ".join(edited(words, 0.004, rng)) for i in range(400)} | {1000 + i: " ".join(f"z{rng.randrange(3000)}" for _ in range(80)) for i in range(50)}
    kept = kept_ids(spark, texts)
    assert {d for d in kept if d >= 1000} == set(range(1000, 1050)) and 0 in kept and len(kept) <= 52


def test_full_files_lose_no_pair(spark):
    """A member of a full file meets all others of other groups, not only the nearest of those before it."""
    ring = N.Ring.of(10**6, 0.8)
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    # 1,200 members around one chain, two blocks of them, and a small file.
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 24), replace=False))) for _ in range(1200)]
    rows = [(0, 7, int((base ^ f).view(np.int64)), i) for i, f in enumerate(flips)]
    rows += [(1, 9, int((base ^ f).view(np.int64)), 5000 + i) for i, f in enumerate(flips[:20])]
    filed = spark.createDataFrame(rows, "segment int, value long, chain long, node long").repartition(3)
    found = N._candidates(filed, ring).collect()
    full = [(r["segment"], r["value"]) for r in found if r["u"] is None]
    assert full == [(0, 7)]
    roots = spark.createDataFrame([(i, i % 2) for i in range(2, 1200)], "node long, root long")
    across = N._across(filed, spark.createDataFrame(full, "segment int, value long"), roots, ring)
    chains = np.array([r[2] for r in rows], np.int64).view(np.uint64)
    good = N._within(chains[:, None] ^ chains, ring)
    want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(good[:1200, :1200]))) if i > j and i % 2 != j % 2}
    nearest = {(r["u"], r["v"]) for r in found if r["u"] is not None}
    assert {(r["u"], r["v"]) for r in across.collect()} == want and len(want - nearest) > 1000
    small = {(5000 + i, 5000 + j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(good[1200:, 1200:]))) if i > j}
    assert {p for p in nearest if p[0] >= 5000} == small


def test_a_crowd_gives_few_candidates_before_its_links_are_known(spark, monkeypatch):
    """Candidates of copies grow with their number, and files that were not compared whole lose no pair of different groups."""
    rng, told = random.Random(13), []
    words = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = {i: " ".join(edited(words, 0.01, rng)) for i in range(300)} | {1000 + i: " ".join(f"z{rng.randrange(3000)}" for _ in range(80)) for i in range(50)}
    seen = N._candidates

    def counted(*args):
        found = N.keep(seen(*args))
        told.append((found.filter("u IS NOT NULL").count(), seen(*args[:2]).filter("u IS NOT NULL").count()))
        return found

    monkeypatch.setattr(N, "_candidates", counted)
    groups = plain_groups(texts)
    assert set(groups.values()) <= kept_ids(spark, texts)
    few, all_of_small = told[0]
    assert few < 0.5 * all_of_small


def test_a_crowd_below_the_bound_gives_no_rows_by_its_square(spark, monkeypatch):
    """Texts that resemble each other almost enough are all compared, but as members of files, not as rows of pairs."""
    rng, told = random.Random(17), []
    words = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts = {i: " ".join(edited(words, rng.choice([0.004, 0.014, 0.018]), rng)) for i in range(400)}
    for name in ("_near", "_similar"):
        def counted(pairs, *rest, seen=getattr(N, name)):
            pairs = N.keep(pairs)
            told.append(pairs.count())
            return seen(pairs, *rest)

        monkeypatch.setattr(N, name, counted)
    groups = plain_groups(texts)
    assert set(groups.values()) <= kept_ids(spark, texts) and sum(told) < 0.25 * 400 * 399 / 2


def test_links_across_full_files_are_those_of_all_their_pairs(spark):
    rng = random.Random(19)
    words = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts = {i: " ".join(edited(words, rng.choice([0.004, 0.014, 0.018]), rng)) for i in range(120)}
    docs, ring = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), N.Ring.of(1000, 0.8)
    nodes = N.keep(N._fingerprints(docs, 5, ring.words).select(N.F.col("text_hash").alias("node"), "print").dropDuplicates(["node"]))
    filed = N.keep(N._filed(nodes, ring))
    full = filed.groupBy("segment", "value").count().filter("count > 5").select("segment", "value")
    none = spark.createDataFrame([], "node long, root long")
    pairs = N._near(N._across(filed, full, none, ring), nodes, ring).select("u", "v")
    links = N.keep(N._links_across(filed, full, none, nodes, ring, docs, 5, 0.8))
    want = dict(N.components(N._similar(pairs, docs, 5, 0.8)).collect())
    assert len(want) > 20 and dict(N.components(links).collect()) == want == dict(N._joined(none, links).collect())
    # No more links than members of files.
    assert links.count() < filed.join(full, ["segment", "value"], "left_semi").count()


def test_texts_travel_once_to_those_that_stay(spark):
    docs = spark.createDataFrame([(i // 2, f"text {i // 2} of many") for i in range(40)] + [(None, None), (None, "")], "doc_id long, text string")
    found = N.first_of_near_copies(docs)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in found.collect()) == [*((False, i) for i in range(20)), (True, None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    texts = [line for line in plan.split("Initial Plan")[-1].splitlines() if "Exchange hashpartitioning" in line]
    # One exchange of the documents and one of the list of those that stay.
    assert len(texts) == 2


def test_odd_documents(spark):
    docs = odd_documents(spark)
    found = N.first_of_near_copies(docs)
    assert found.columns == docs.columns
    rows = pick(found, "doc_id", "text", "source").collect()
    # Rows 1, 1 and 5 are one text; null, empty and blank texts are copies of each other, the row with an id first.
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows) == [(False, 1), (False, 2), (False, 4), (False, 7), (True, None)]
    assert N.first_of_near_copies(docs.limit(0)).collect() == []
