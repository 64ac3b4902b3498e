import numpy as np
from odd import odd_documents, rows_of

from zonespark.llm.cotraining import _kind_table, co_train, fit_logistic, metadata_features, score_quality, text_features
from zonespark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    """Labels of every third document are withheld from the training and predicted."""
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    held = dict(labels.filter("doc_id % 3 = 0").select("doc_id", "quality").collect())
    rows = {r["doc_id"]: r for r in score_quality(docs, labels.filter("doc_id % 3 <> 0")).collect()}
    good = [rows[d] for d, q in held.items() if q]
    bad = [rows[d] for d, q in held.items() if not q]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.8 * len(bad)


def test_every_document_is_scored(spark):
    rows = QUERIES["op8_cotrained_quality"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert all(0 <= r[c] <= 1 for r in rows for c in ("text_score", "metadata_score", "score"))


def test_views_teach_each_other():
    """Either view alone tells the label; with few labels, what one view is sure of sharpens the other."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 3000)
    first = rng.normal(size=(3000, 30)) + 2.0 * (y[:, None] - 0.5) * (np.arange(30) < 6)
    second = rng.normal(size=(3000, 40)) + 1.2 * (y[:, None] - 0.5) * (np.arange(40) < 10)
    labels = np.where(np.arange(3000) < 60, y, -1)
    held = (np.arange(3000) % 3 == 0) & (labels >= 0)
    def accuracy(rounds):
        c = co_train((first, second), labels, held, rounds=rounds, confidence=0.9)
        return [float(((s >= 0.5) == y)[labels < 0].mean()) for s in c.scores(first, second)]
    alone, taught = accuracy(0), accuracy(4)
    assert taught[1] > alone[1] and taught[2] >= 0.93


def test_one_label_only_gives_no_classifier():
    x = np.ones((10, 2))
    assert co_train((x, x), np.ones(10, int), np.arange(10) % 2 == 0) is None
    w = fit_logistic(np.array([[0.0], [1.0], [2.0], [3.0]]), np.array([0, 0, 1, 1]))
    assert w[0] > 0


def test_features():
    table = _kind_table()
    assert text_features(b"", table).shape == text_features("aB1 é!".encode(), table).shape
    assert not text_features(b"", table).any()
    repeated, varied = text_features(b"x y " * 50, table), text_features(b" ".join(b"w%d" % i for i in range(100)), table)
    assert repeated[-5] < varied[-5]
    long = b"ab " * 700_000
    assert np.allclose(text_features(long, table)[:256], text_features(b"ab " * 1000, table)[:256], atol=1e-2)
    assert metadata_features(None, None, None).sum() == 3 and not np.array_equal(metadata_features("a", "en", 5), metadata_features("b", "en", 5))


def test_odd_documents(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 0), (4, None)], "doc_id long, quality int").selectExpr("*", "1 AS text_view")
    rows = score_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(r["kept"] and r["score"] == 0.5 for r in rows)
    assert rows_of(score_quality(docs.limit(0), labels)) == []
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    both = table.unionByName(spark.createDataFrame([tuple(r)[:5] for r in docs.collect()], table.schema))
    assert score_quality(both, spark.read.parquet(f"{SF}/labels.parquet")).count() == table.count() + docs.count()
