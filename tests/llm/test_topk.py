from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pyarrow as pa
from odd import rows_of

from zonespark.llm.queries import QUERIES
from zonespark.llm.topk import LENGTHS, _Best, scaled, segments, top_k


def plain(rows, every=50, k=5):
    """All queries against all rows in whole numbers."""
    ready = [
        (i, [floor(256 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)
    ]
    out = []
    for q in sorted({i for i, _ in ready if i % every == 0}):
        own = min(v for i, v in ready if i == q)
        scores = sorted({(-sum(a * b for a, b in zip(own, v)), i) for i, v in ready if i != q})
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return out


def test_random_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 24))
    rows = [(i, (centres[i % 4] + 0.3 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(700)]
    # Ties: equal vectors under several ids.
    rows += [(1000 + i, rows[i][1]) for i in range(0, 200, 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block in (2048, 3):
        assert rows_of(top_k(table, block=block)) == sorted(plain(rows), key=repr)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, -0.25]), (50, [0.001, 1.0]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (2, [0.5, -0.25]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]),
        (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, []), (100, [1.0, 2.0, 3.0] * 20), (8, [1.0] * 70), (None, None), (150, [0.5]), (150, [0.25]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "*", "1 AS EMBEDDING_", "'x' AS rank", "2 AS score", "3 AS query_id"
    )
    assert rows_of(top_k(table)) == sorted(plain(rows), key=repr)
    assert rows_of(top_k(table.limit(0))) == []
    assert rows_of(top_k(table.filter("vec_id = 50"))) == []


def test_values_beyond_the_exact_range_of_doubles(spark):
    rows = [(i, [float(2**20 + i), 3.0 * 2 ** (i // 3), -1.0]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert max(s for _, _, _, s in plain(rows)) > 2**53
    assert rows_of(top_k(table)) == sorted(plain(rows), key=repr)


def test_finer_segments_bound_inner_products_closer():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 64)) * 256, rng.normal(size=(50, 64)) * 256
    exact, last = x @ y.T, np.inf
    for length in LENGTHS:
        bound = segments(x, length) @ segments(y, length).T
        assert (bound >= exact - 1e-6).all() and bound.mean() < last
        last = bound.mean()


def test_bounds_rule_candidates_out_before_they_are_scored(monkeypatch):
    from zonespark.llm import topk

    scored = []
    monkeypatch.setattr(topk, "exact_scores", lambda q, c, f=topk.exact_scores: scored.append(len(c)) or f(q, c))
    near, far = np.full((10, 16), 100.0), np.full((500, 16), -100.0)
    best = _Best(np.array([50]), near[:1], 5)
    best.add(np.arange(1, 11), near)
    best.add(np.arange(100, 600), far)
    assert scored == [10] and best.found.tolist() == [1, 2, 3, 4, 5]


def test_scaling_floors_and_pads():
    found = scaled(pa.array([[0.5, -0.001], [], [1.0]], pa.list_(pa.float64())))
    assert found.shape == (3, 16) and found[0, :2].tolist() == [128, -1] and found[2, 0] == 256 and not found[1].any()


def test_recall_on_the_table_is_whole(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows_of(QUERIES["op7_segment_topk"](spark, sf)) == sorted(plain(rows), key=repr)
