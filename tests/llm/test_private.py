import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import odd_documents

from zonespark.llm import private_data as P
from zonespark.llm import queries
from zonespark.llm import sequence_tagger as T

SF = "/root/testdata/sf0.01"


def plain_luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_base(text):
    """The base kinds by the patterns as they are stated."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and plain_luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "b@c.d", "@", ".", "1", "0", "255", "256", "+4", "-", " ", "(", ")", "4111111111111111", "٣", "é", "_", "%", "x.y", "\n", "000000", "7"]), max_size=24).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert P.base_spans(text) == plain_base(text)


def test_long_runs_are_looked_at_once():
    for text in ("a" * 400_000, "1" * 400_000, "999." * 100_000, "+1" * 200_000, "1 " * 200_000, "a@" * 200_000, "a@b" * 100_000, "+1" + "-" * 400_000):
        assert P.base_spans(text) == []
    tail = "x" * 300_000 + "@y.z " + "9" * 200_000 + " 1.2.3.4"
    assert [s[0] for s in P.base_spans(tail)] == [0, 1]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in T.new_model(5, 6, 4).items()}
    model["T"] += rng.normal(0, 0.3, (5, 5))
    x, y = rng.integers(0, T.SYMBOLS, (3, 7)), rng.integers(0, 5, (3, 7))
    gradient = T.loss_and_gradient(model, x, y)[1]
    for name, values in model.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in values.shape) if name != "E" else (int(x[0, 2]), int(rng.integers(0, 6)))
            was, losses = values[at], []
            for step in (1e-4, -1e-4):
                values[at] = was + step
                losses.append(T.loss_and_gradient(model, x, y)[0])
            values[at] = was
            assert abs((losses[0] - losses[1]) / 2e-4 - gradient[name][at]) < 2e-3


def test_marginals_and_paths_against_all_paths():
    rng = np.random.default_rng(1)
    tags, length = 3, 4
    model = T.new_model(tags, 5, 4)
    model["T"] = rng.normal(0, 1, (tags, tags)).astype(np.float32)
    x = rng.integers(0, T.SYMBOLS, (1, length))
    scores = T._emissions(model, x)[0][:, 0]
    total, chance = 0.0, np.zeros((length, tags))
    for path in np.ndindex(*[tags] * length):
        weight = np.exp(model["S"][path[0]] + sum(scores[t, p] for t, p in enumerate(path)) + sum(model["T"][a, b] for a, b in zip(path, path[1:])))
        total += weight
        for t, p in enumerate(path):
            chance[t, p] += weight
    assert np.allclose(T.marginals(model, x)[0], chance / total, atol=1e-5)

    allowed, starts = np.array([[1, 1, 0], [1, 1, 1], [1, 1, 1]], bool), np.array([1, 1, 0], bool)
    given_chances = [rng.dirichlet(np.ones(3), n) for n in (4, 1, 6)]
    for c, found in zip(given_chances, T.best_paths(given_chances, allowed, starts)):
        legal = [p for p in np.ndindex(*[3] * len(c)) if starts[p[0]] and all(allowed[a, b] for a, b in zip(p, p[1:]))]
        assert tuple(found) == max(legal, key=lambda p: sum(np.log(c[t, k]) for t, k in enumerate(p)))


def _trained(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if not hasattr(_trained, "model"):
        _trained.model = P.train(docs.filter("doc_id % 4 <> 0"))
    return docs, _trained.model


def test_held_out_spans_are_found_as_they_stand_and_rewritten(spark):
    docs, model = _trained(spark)
    held = [r["text"] for r in docs.filter("doc_id % 4 = 0").collect() if r["text"] and P.base_spans(r["text"])]
    hits, wanted, again, tried = 0, 0, 0, 0
    rng = np.random.default_rng(5)
    for text in held:
        spans = P.base_spans(text)
        if any(a < d and c < b for i, (_, a, b) in enumerate(spans) for _, c, d in spans[:i]):
            continue
        # As the network alone sees them: nothing is a base span.
        found = {(k - 4, a, b) for k, a, b in P.added_spans(model, [text], [[]], 0.5)[0]}
        wanted += len(spans)
        hits += sum(s in found for s in spans if s[0] != 3) + sum(any(k == 3 and a < e and s < b for k, a, b in found) for kind, s, e in spans if kind == 3)
        for kind, a, b in spans:
            new = P.rewritten(kind, text[a:b], rng)
            changed = text[:a] + new + text[b:]
            if P._plausible(kind, new) and not P.base_spans(new):
                tried += 1
                again += any(k == kind + 4 and s < a + len(new) and e > a for k, s, e in P.added_spans(model, [changed], [P.base_spans(changed)], 0.8)[0])
    assert wanted > 15 and hits >= 0.8 * wanted
    assert tried > 8 and again >= 0.7 * tried


def test_clean_texts_get_no_spans(spark):
    docs, model = _trained(spark)
    clean = [r["text"] for r in docs.filter("doc_id % 4 = 0").collect() if r["text"] and not P.base_spans(r["text"])]
    added = P.added_spans(model, clean, [[] for _ in clean], 0.9)
    assert sum(map(bool, added)) <= 0.005 * len(clean)


def test_windows_are_reconciled_over_the_whole_text(spark):
    _, model = _trained(spark)
    fill = "eaed the and onoa then " * 12
    for shift in range(0, 64, 7):
        text = fill[: 100 + shift] + " kitra.27 [at] mail3.example.com " + fill + "x" * 3 + " and so on 2024, page 12. " + fill
        base = P.base_spans(text)
        one = P.added_spans(model, [text], [base], 0.6)[0]
        assert P.added_spans(model, ["", text, text], [[], base, base], 0.6)[1:] == [one, one]
        assert all(text[a:b].startswith("k") or P._plausible(k - 4, text[a:b]) for k, a, b in one)


def test_runs_of_any_length_are_cut_outside_spans(monkeypatch, spark):
    _, model = _trained(spark)
    text = " ".join(f"line {i} call +1 (555) 010-{i:04d} or mail a{i}@mail.example.com" for i in range(120))
    monkeypatch.setattr(P, "_LONG_RUN", 10**9)
    whole = P.added_spans(model, [text], [[]], 0.5)[0]
    monkeypatch.setattr(P, "_SECTION", 640)
    cut = P.added_spans(model, [text], [[]], 0.5)[0]
    assert len(whole) > 60 and len(set(whole) ^ set(cut)) <= 0.05 * len(whole)


def test_added_spans_meet_no_base_span(spark):
    docs, _ = _trained(spark)
    found = {r["doc_id"]: r for r in queries.op12_private_data(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert set(found) == set(texts)
    for d, text in texts.items():
        base = plain_base(text)
        written = ",".join(f"{P.BASE[k]}:{a}:{b}" for k, a, b in base)
        r = found[d]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == i for k, _, _ in base) for i in range(4))
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest() and r["spans"].startswith(written)
        rest = [s.split(":") for s in r["spans"][len(written) :].strip(",").split(",") if s]
        assert len(rest) == r["n_added"]
        assert not any(int(a) < e and s < int(b) for _, a, b in rest for _, s, e in base)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    found = P.private_data(docs).collect()
    assert len(found) == docs.count() and P.train(docs) is None
    assert all(not r["found"] for r in found)
    assert P.private_data(docs.limit(0)).collect() == []
    long = spark.createDataFrame([(1, "a.b@c.de " + "word " * 300_000 + "1.2.3.4")], "doc_id long, text string")
    assert [(s["kind"], s["start"]) for s in P.find_private(long, None).first()["found"]] == [("email", 0), ("ip", 1_500_009)]
