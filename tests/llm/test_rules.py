import re
from collections import Counter

from odd import odd_documents, rows_of
from pyspark.sql import functions as F

from zonespark.llm.quality_rules import (
    Rule, Threshold, _best_threshold, kept_documents, labelled_sample, learn_rules, quality_rules, with_statistics,
)
from zonespark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


def test_statistics_and_verdicts_of_all_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    rows = QUERIES["op5_quality_rules"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert own == plain_statistics(docs[r["doc_id"]]), r["doc_id"]
        assert r["base_failed"] == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert not (r["base_failed"] and r["kept"])
    judged = [(labels[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    good, bad = [k for q, k in judged if q], [k for q, k in judged if not q]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_statistics_of_awkward_texts(spark):
    texts = [
        None, "", " ", "a", "a b", "a b c", "a a a", "a a a a", "a b c a b c", "a b a b a", "x\ny\nx\n\n \nx", "x\r\nx\r\n", "\x0b\x0ca\x0b", "é漢 \U0001f600 ß",
        "a b c d e f a b c x y d e f", "#*$%&|<> !?", "\xa0 a b", "a b c d " * 300,
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    for r in with_statistics(table).collect():
        own = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert own == plain_statistics(texts[r["n"]]), texts[r["n"]]


def rows(values, held=False):
    base = dict.fromkeys(["words", "word_length", "symbols_per_word", "marks_per_word", "capital_share", "duplicate_lines", "repeat_share", "distinct_share"], 1.0)
    return [base | v | {"held": held} for v in values]


def test_a_conjunction_is_found_and_ordered():
    values = [
        {"symbols_per_word": s, "capital_share": c, "reject": int(s > 0.5 and c > 0.5 or s > 0.9)}
        for s in (x / 20 for x in range(21)) for c in (x / 20 for x in range(21))
    ]
    rules = learn_rules(rows(values) + rows(values, held=True))
    judged = [any(r.covers(v) for r in rules) for v in rows(values)]
    assert judged == [bool(v["reject"]) for v in values]
    assert len(rules) == 2


def test_thresholds_have_the_most_gain_of_all():
    from math import log2

    values = rows([{"words": float(i % 7), "word_length": float(i % 5), "reject": int(i % 7 > 4)} for i in range(70)])
    best = _best_threshold(values, {"words": [0.5, 2.5, 4.5], "word_length": [1.5, 3.5]})
    def gain(t):
        covered = [v["reject"] for v in values if t.holds(v)]
        p0 = sum(v["reject"] for v in values) / len(values)
        return sum(covered) * (log2(sum(covered) / len(covered)) - log2(p0)) if sum(covered) else 0
    every = [Threshold(f, above, c) for f, cs in (("words", [0.5, 2.5, 4.5]), ("word_length", [1.5, 3.5])) for c in cs for above in (True, False)]
    assert gain(best) == max(map(gain, every)) and best == Threshold("words", True, 4.5)


def test_noise_gives_no_rule_and_expressions_say_what_rules_say(spark):
    noise = [{"words": float(i * 7919 % 101), "reject": int(i * 104729 % 7 == 0)} for i in range(400)]
    assert learn_rules(rows(noise[:200]) + rows(noise[200:], held=True)) == []
    rule = Rule([Threshold("words", True, 3.0), Threshold("symbols_per_word", False, 0.5)])
    table = spark.createDataFrame([("a b c d",), ("a b",), ("# # # #",)], "text string")
    assert [r[0] for r in with_statistics(table).select(rule.expression()).collect()] == [True, False, False]
    assert str(rule) == "words >= 3 and symbols_per_word < 0.5"


def test_main_path_is_native_and_filters_do_not_repeat_the_statistics(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    for df in (quality_rules(docs, labels), kept_documents(docs, labels)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|Exchange", plan)
        # Each costly array is computed once and read by name above.
        assert plan.count("split(") <= 3


def test_odd_documents(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    found = quality_rules(docs, labels).collect()
    assert len(found) == docs.count()
    assert {r["doc_id"]: r["n_words"] for r in found}[4] == 120_000
    assert all(r["base_failed"] and not r["kept"] for r in found)
    empty = labels.limit(0)
    long = docs.withColumn("text", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: i.cast("string"))))
    assert kept_documents(long, empty).columns == long.columns and rows_of(kept_documents(long, empty)) == rows_of(long)
    assert rows_of(quality_rules(docs.limit(0), labels)) == rows_of(kept_documents(docs.limit(0), labels)) == []


def test_the_sample_has_its_bound(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    assert len(labelled_sample(docs.unionByName(docs), labels, 40)) <= 40
