import re
from collections import Counter, defaultdict
from math import log

import pytest
from odd import odd_pages, rows_of

from zonespark.llm.queries import QUERIES
from zonespark.llm.url_filter import ALPHABET, CONTEXT, RULES, UrlRule, best_threshold, filter_urls

SF = "/root/testdata/sf0.01"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def plain_text(url):
    text = re.sub("[0-9]", "0", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or ""))
    return re.sub(r"[^a-z0/.\-_?=&#:%+]", "~", text)


def plain_model(texts):
    """Chance of a character after a context, interpolated over all orders."""
    counts = [defaultdict(Counter) for _ in range(CONTEXT + 1)]
    for text in texts:
        padded = "^" * CONTEXT + text
        for i in range(CONTEXT, len(padded)):
            for n in range(CONTEXT + 1):
                counts[n][padded[i - n : i]][padded[i]] += 1

    def chance(context, c):
        p = 1 / len(ALPHABET)
        for n in range(CONTEXT + 1):
            seen = counts[n][context[len(context) - n :]]
            if seen:
                p = (seen[c] + len(seen) * p) / (seen.total() + len(seen))
        return p

    return chance


def plain_scores(pages, rules):
    judged = [(i, u, plain_rule(*plain_parts(u), rules)) for i, u in pages]
    models = [
        plain_model([plain_text(u) for i, u, r in judged if r and r.verdict == v and not (i is not None and i % 5 == 0)]) for v in ("block", "allow")
    ]
    def score(url):
        text = plain_text(url)
        padded = "^" * CONTEXT + text
        ratios = [log(models[0](padded[i - CONTEXT : i], padded[i]) / models[1](padded[i - CONTEXT : i], padded[i])) for i in range(CONTEXT, len(padded))]
        return sum(ratios) / len(ratios) if ratios else 0.0
    return [score(u) for _, u in pages]


def test_all_pages_against_plain_models(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()]
    found = {r["page_id"]: r for r in filter_urls(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    scores = dict(zip([i for i, _ in pages], plain_scores(pages, RULES)))
    cells = defaultdict(lambda: [0, 0])
    for i, url in pages:
        rule = plain_rule(*plain_parts(url), RULES)
        assert (found[i]["host"], found[i]["path"]) == plain_parts(url)
        assert found[i]["rule"] == (str(rule) if rule else None)
        assert found[i]["score"] == pytest.approx(scores[i], abs=2e-6)
        if rule:
            assert found[i]["verdict"] == rule.verdict
            if i % 5 == 0:
                cells[round(found[i]["score"], 2)][rule.verdict == "block"] += 1
    threshold = best_threshold([(s, a, b) for s, (a, b) in cells.items()])
    for i, _ in pages:
        if found[i]["rule"] is None:
            assert found[i]["verdict"] == ("block" if found[i]["score"] > threshold else "allow")
    assert {r["verdict"] for r in found.values() if r["rule"] is None} == {"block", "allow"}
    columns = QUERIES["op9_url_filter"](spark, SF).columns
    assert columns == ["page_id", "host", "path", "rule", "verdict"]


@pytest.mark.parametrize("url", [
    "http://NET", "http://net/", "x://a.net/en/", "http://example.net/en/1", "http://a.example.net/en", "http://anexample.net/en/x", "http://example.com/de/?q",
    "http://Sub.EXAMPLE.com/de/x#y", "http://org?x=/fr/", "http://a.org/fr/", "http://a.org#/fr/", "a://b://net/", "://net/x", "net/", "", None, "http://É.net/ß",
    "http://a.net?x", "http://user@host.net:80/p", "http://x\ny.net/a\nb?c",
])
def test_parts_and_rules_of_single_urls(spark, url):
    row = filter_urls(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    host, path = plain_parts(url)
    rule = plain_rule(host, path, RULES)
    assert (row["host"], row["path"], row["rule"]) == (host, path, str(rule) if rule else None)
    assert row["verdict"] == (rule.verdict if rule else "allow")


def test_the_longest_rule_wins(spark):
    rules = [UrlRule("block", "a.com", "/"), UrlRule("allow", "b.a.com", "/"), UrlRule("block", "b.a.com", "/x/y")]
    pages = spark.createDataFrame([(1, "h://a.com/"), (2, "h://c.b.a.com/x"), (3, "h://b.a.com/x/yz")], "page_id long, url string")
    assert [r["verdict"] for r in filter_urls(pages, rules).orderBy("page_id").collect()] == ["block", "allow", "block"]


def test_threshold_is_the_best_of_all_and_in_the_widest_gap():
    cells = [(-1.0, 5, 0), (-0.5, 4, 1), (0.2, 1, 0), (0.8, 0, 3), (1.0, 1, 6)]
    def errors(t):
        return sum(a for s, a, _ in cells if s > t) / 11 + sum(r for s, _, r in cells if s <= t) / 10
    found = best_threshold(cells)
    assert errors(found) == min(errors(t / 100) for t in range(-150, 150)) and found == 0.5
    assert best_threshold([(0.0, 3, 0)]) == best_threshold([]) == float("inf")


def test_main_path_is_native(spark):
    plan = filter_urls(spark.read.parquet(f"{SF}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_odd_pages(spark):
    pages = odd_pages(spark)
    rows = filter_urls(pages).collect()
    assert len(rows) == pages.count() and {r["verdict"] for r in rows} <= {"allow", "block"}
    assert rows_of(filter_urls(pages.limit(0))) == []
