import re
from collections import Counter
from math import floor, log

import numpy as np
from odd import odd_documents, rows_of

from zonespark.llm import ranked_search as R
from zonespark.llm.common import pick

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return _TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, top=10):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: floor(1000 * log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    asked = {}
    for item, text in dict.fromkeys(items):
        asked.setdefault(item, Counter()).update(plain_terms(text))
    out = []
    for item, terms in asked.items():
        found = []
        for d, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // words
            score = sum(k * weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in terms.items() if c[t])
            if score > 0:
                found.append((-score, d is None, d))
        for rank, (score, _, d) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:top], 1):
            out.append((item, rank, d, -score))
    return sorted(out, key=repr)


def _vectors(rng, documents, vocabulary, longest):
    rows = []
    for _ in range(documents):
        terms = np.unique(rng.zipf(1.4, rng.integers(1, longest)) % vocabulary)
        rows.append((terms.astype(np.int32), rng.integers(1, 6, len(terms))))
    return rows


def _tree(rows, m):
    starts = np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])])
    return R.Tree(np.arange(len(rows)), m, starts, np.concatenate([t for t, _ in rows]), np.concatenate([f for _, f in rows]).astype(np.int64))


def _nodes(node):
    yield node
    for child in node.children:
        yield from _nodes(child)


def test_bounds_hold_for_every_document_below_a_node():
    rng = np.random.default_rng(3)
    rows = _vectors(rng, 700, 60, 30)
    rows += [rows[0]] * 100  # One path that many share.
    m = rng.integers(25, 400, len(rows))
    tree = _tree(rows, m)
    leaves = [n for n in _nodes(tree.root) if not n.children]
    assert sorted(i for n in leaves for i in range(n.first, n.last)) == list(range(len(rows)))
    for _ in range(20):
        terms = np.unique(rng.integers(0, 70, 8)).astype(np.int32)
        item = R.Item(1, terms, rng.integers(0, 5000, len(terms)))
        scores = {}
        for leaf in leaves:
            for i, s in zip(range(leaf.first, leaf.last), item.scores(tree, leaf)):
                scores[i] = int(s)
        for i, s in scores.items():
            t, f = rows[tree.ids[i]]
            at = {int(a): int(b) for a, b in zip(t, f)}
            assert s == sum(int(w) * ((10**9 * at[k]) // (1000 * at[k] + 8 * int(m[tree.ids[i]]))) for k, w in zip(terms.tolist(), item.weights) if k in at)
        for node in _nodes(tree.root):
            assert item.bound(node) >= max(scores[i] for i in range(node.first, node.last))
        opened = item.search(tree, 10)
        want = sorted((-s, int(tree.ids[i])) for i, s in scores.items() if s > 0)[:10]
        assert item.best == want and opened <= len(leaves)


def test_branches_that_cannot_win_are_not_opened():
    rng = np.random.default_rng(4)
    rows = _vectors(rng, 5000, 400, 40)
    tree = _tree(rows, np.full(len(rows), 100))
    item = R.Item(1, np.array([5, 17, 390], np.int32), np.array([10, 3000, 9000]))
    leaves = sum(not n.children for n in _nodes(tree.root))
    assert item.search(tree, 10) < leaves / 2


def test_chains_and_equal_paths_make_bounded_trees():
    chain = [(np.arange(i + 1, dtype=np.int32), np.ones(i + 1, np.int64)) for i in range(1500)]
    same = [(np.arange(3, dtype=np.int32), np.ones(3, np.int64))] * 1500
    for rows in (chain, same):
        tree = _tree(rows, np.full(len(rows), 100))
        assert max(n.last - n.first for n in _nodes(tree.root) if not n.children) <= R._LEAF
        item = R.Item(1, np.array([2], np.int32), np.array([7]))
        item.search(tree, 10)
        assert [d for _, d in item.best] == ([*range(2, 12)] if rows is chain else [*range(10)])


def test_odd_documents_and_items(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame(
        [(1, "Two four LOREM nowhere"), (1, "Two four LOREM nowhere"), (2, None), (3, ""), (None, "id x x"), (4, "dolor " * 3000), (5, "漢字 É é"), (1, "two")],
        "item_id long, text string",
    )
    plain = plain_search([(r[0], r[1]) for r in pick(docs, "doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert rows_of(R.ranked_search(docs, items)) == plain and any(r[0] is None for r in plain)
    assert R.ranked_search(docs.limit(0), items).collect() == [] == R.ranked_search(docs, items.limit(0)).collect()


def test_items_in_blocks_find_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(12)
    monkeypatch.setattr(R, "_ASKED", 100)
    plain = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert rows_of(R.ranked_search(docs, items)) == plain
