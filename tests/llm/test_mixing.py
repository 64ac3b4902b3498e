from collections import Counter, defaultdict
from fractions import Fraction
from math import ceil

import pytest
from odd import odd_documents, rows_of

from zonespark.llm.mixing import exact_parts, mixed_documents, parts_of, pfair_mix, pfair_round, pfair_slots
from zonespark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("parts", [{"a": 1}, {"a": 3, "b": 3, "c": 1}, {"a": 500, "b": 300, "c": 150, "d": 49, "e": 1}, {str(i): 1 + i % 7 for i in range(40)}])
def test_every_source_stays_within_one_block_of_its_weight(parts):
    total, read = sum(parts.values()), Counter()
    round_ = pfair_round(parts)
    assert Counter(s for s, _ in round_) == parts
    for slot, (source, block) in enumerate(round_, 1):
        assert block == read[source]
        read[source] += 1
        for s, p in parts.items():
            # |read - slot * p / total| < 1 in whole numbers.
            assert abs(read[s] * total - slot * p) < total


def test_parts_sum_to_the_resolution_and_follow_the_weights():
    parts = parts_of({"a": 0.62, "b": 0.38, "c": 1e-9}, 1000)
    assert sum(parts.values()) == 1000 and parts["c"] == 1 and abs(parts["a"] - 620) <= 1


def plain_schedule(parts, blocks):
    """Earliest deadline first, slot by slot, until every block is read; idle where a source that ran out is due."""
    total, slots, slot = sum(parts.values()), {}, 0
    queue = {s: 0 for s in parts}
    while any(queue[s] < blocks[s] for s in parts):
        due = [(ceil((queue[s] + 1) * total / p), s) for s, p in parts.items() if queue[s] * total // p <= slot]
        _, s = min(due)
        if queue[s] < blocks[s]:
            slots[s, queue[s]] = slot
        queue[s] += 1
        slot += 1
    return slots


def test_slots_are_those_of_the_plain_schedule(spark):
    docs = spark.createDataFrame([(i, "abcabdaa"[i % 8]) for i in range(400)], "doc_id long, source string")
    mix = pfair_mix(docs, weights={"a": 5, "b": 3, "c": 1, "d": 2}, block_docs=4, resolution=110)
    rows = mix.rows.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(400))
    blocks = defaultdict(set)
    for r in rows:
        blocks[r["source"], r["block"]].add((r["slot"], r["release"], r["deadline"]))
        assert r["release"] <= r["slot"] < r["deadline"]
    assert all(len(b) == 1 for b in blocks.values())
    named = {f"={s}": p for s, p in mix.parts.items()}
    sizes = Counter(s for s, _ in blocks)
    expected = plain_schedule(named, {f"={s}": n for s, n in sizes.items()})
    assert {(f"={s}", b): min(v)[0] for (s, b), v in blocks.items()} == expected


def test_every_document_of_the_table_has_one_place(spark):
    rows = QUERIES["op6_pfair_mix"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()
    assert sorted((r["doc_id"], r["source"]) for r in rows) == sorted(map(tuple, docs))
    assert len({(r["slot"], r["place"]) for r in rows}) == len(rows)
    slots = defaultdict(set)
    for r in rows:
        slots[r["slot"]].add((r["source"], r["block"]))
    assert all(len(s) == 1 for s in slots.values())


def test_sources_that_fall_short_are_read_again(spark):
    docs = spark.createDataFrame([(i, "big" if i < 80 else "small", f"t{i}") for i in range(100)], "doc_id long, source string, text string")
    mixed = mixed_documents(docs, weights={"big": 2, "small": 1}, block_docs=5, resolution=30)
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert all(times[i] == 1 for i in range(80)) and set(times) == set(range(100))
    # 80 documents of the one call for 40 of the other, which has 20.
    assert all(times[i] == 2 for i in range(80, 100)) and mixed.columns == docs.columns
    assert rows_of(mixed_documents(docs, max_epochs=1)) == rows_of(docs)


def test_target_weights_hold_however_long_the_input_is():
    shares = {"a": 0.6180339, "b": 0.3819, "c": 1e-5, "d": 0.0000561}
    parts = exact_parts(shares)
    total, read = sum(parts.values()), Counter()
    assert all(p * sum(map(Fraction, shares.values())) == total * Fraction(shares[s]) for s, p in parts.items())
    at = dict.fromkeys(parts, 0)
    for first in range(0, 200_000, 50_000):
        for source, block, release, deadline, slot in pfair_slots(parts, at, first, first + 50_000):
            assert block == read[source] and release <= slot < deadline
            read[source] += 1
            assert all(abs(read[s] * total - (slot + 1) * p) < total for s, p in parts.items())
    assert read["c"] in (1, 2, 3)
    assert [(s, j) for s, j, *_ in pfair_slots({"a": 5, "b": 3, "c": 1}, {"a": 0, "b": 0, "c": 0}, 0, 9)] == pfair_round({"a": 5, "b": 3, "c": 1})


def test_slots_and_epochs_follow_the_targets(spark, monkeypatch):
    import zonespark.llm.mixing as mixing

    monkeypatch.setattr(mixing, "STRETCH", 64)
    docs = spark.createDataFrame([(i, "big" if i < 4000 else "small") for i in range(4010)], "doc_id long, source string")
    mix = pfair_mix(docs, weights={"big": 0.9876, "small": 0.0124}, block_docs=2, max_epochs=None)
    slots = {(r["source"], r["epoch"], r["block"]): r["slot"] for r in mix.rows.collect()}
    # What is due by the horizon is read, in slots of its own; so the small source of 5 blocks is read as its weight asks.
    assert len(set(slots.values())) == len(slots) >= mix.horizon - 1 and max(slots.values()) < mix.horizon
    assert sum(s == "small" for s, _, _ in slots) == int(mix.horizon * 0.0124)
    times = Counter(r["doc_id"] for r in mixed_documents(docs, weights={"big": 0.9876, "small": 0.0124}, block_docs=2).collect())
    assert all(times[i] == 1 for i in range(4000)) and all(times[i] == 5 for i in range(4000, 4010))


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = pfair_mix(docs).rows.collect()
    assert Counter((r["doc_id"], r["source"]) for r in rows) == Counter({(r[0], r[3]) for r in docs.collect()})
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns and Counter(docs.collect()) - Counter(mixed.collect()) == Counter()
    assert rows_of(pfair_mix(docs.limit(0)).rows) == rows_of(mixed_documents(docs.limit(0))) == []
