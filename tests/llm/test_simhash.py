import random
import re

import numpy as np
import xxhash
from odd import odd_documents, rows_of

from zonespark.llm import simhash
from zonespark.llm.components import components
from zonespark.llm.queries import QUERIES
from zonespark.llm.simhash import first_of_each_group, fingerprint_links, near_duplicates, text_fingerprint

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    """Smallest id reachable, over all pairs."""
    fp = np.array(prints, np.uint64)
    root = list(range(len(fp)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a in range(len(fp)):
        for b in np.flatnonzero(np.bitwise_count(fp ^ fp[a]) <= 2):
            root[find(a)] = find(int(b))
    least = {}
    for a, i in enumerate(ids):
        least[find(a)] = min(i, least.get(find(a), i))
    return [least[find(a)] for a in range(len(ids))]


def test_all_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"]) for r in docs]
    groups = plain_components([r["doc_id"] for r in docs], prints)
    expected = {r["doc_id"]: (f"{p:016x}", g) for r, p, g in zip(docs, prints, groups)}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash_near_dedup"](spark, SF).collect()}
    assert found == expected
    assert len(set(groups)) < len(groups)


def test_spark_hashes_shingles_alike(spark):
    row = spark.sql("SELECT xxhash64('one two three') AS h").first()
    assert row["h"] & (1 << 64) - 1 == xxhash.xxh64_intdigest("one two three", 42) == text_fingerprint(b"One TWO three")


def test_texts_over_several_blocks(monkeypatch):
    text = " ".join(f"w{i % 997}" for i in range(5000)).encode()
    whole = text_fingerprint(text)
    monkeypatch.setattr(simhash, "word_blocks", lambda t: (t.split()[i : i + 7] for i in range(0, len(t.split()), 7)))
    assert text_fingerprint(text) == whole == plain_fingerprint(text.decode())
    assert text_fingerprint(b"a b") == plain_fingerprint("a b") and text_fingerprint(b"") == 0


def test_links_connect_what_all_pairs_connect(spark, monkeypatch):
    """Random fingerprints, chains of small steps, and one crowd in a few bits, with both ways of reading a file."""
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(150):
        p = rng.choice(prints)
        for _ in range(rng.choice([1, 1, 2, 3])):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    base = rng.getrandbits(64)
    prints += [base ^ sum(1 << b for b in rng.sample(range(50, 62), rng.randrange(6))) for _ in range(200)]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(s,) for s in signed], "fp long")
    expected = plain_components(signed, prints)
    for limit in (48, 3):
        for place in FILE_LIMITS:
            place(monkeypatch, limit)
        links = fingerprint_links(table)
        for u, v in links.collect():
            assert u != v
        roots = dict(map(tuple, components(links).collect()))
        assert [roots.get(s, s) for s in signed] == expected


FILE_LIMITS = [lambda patch, limit: patch.setattr(simhash, "SMALL_FILE", limit)]


def test_large_files_are_tied_as_pairs_would():
    rng = random.Random(9)
    for file, (agree, bit, free) in list(enumerate(simhash.FILES))[::9]:
        base = rng.getrandbits(64) & agree
        places = [b for b in range(64) if free >> b & 1]
        crowd = {base | sum(1 << b for b in rng.sample(places, rng.randrange(4))) | (rng.getrandbits(1) << bit if bit is not None else 0) for _ in range(120)}
        fp = np.array(sorted(crowd), np.uint64)
        a, b = simhash._stars_in_large(fp, file)
        tied = dict(zip(a.tolist(), b.tolist()))
        plain = plain_components(fp.tolist(), fp.tolist())
        if bit is None:
            assert [tied.get(p, p) for p in fp.tolist()] == plain
        else:
            # Links inside a file of one differing bit are true links; the other files hold the rest.
            where = dict(zip(fp.tolist(), plain))
            assert all(where[x] == where[y] for x, y in tied.items())


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 200), (300, 250)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 60)} | {300: 200, 250: 200}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    groups = {r["doc_id"]: r["component_id"] for r in rows}
    assert groups[1] == groups[5] == 1 and groups[2] == groups[3] == groups[6] == 2
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (2, 3, 6)} == {"0" * 16}
    assert rows_of(near_duplicates(docs.limit(0))) == []


def test_one_document_of_each_group_stays(spark):
    docs = odd_documents(spark)
    kept = first_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0], r[1]) for r in kept.collect() if r[0] is not None) == sorted(
        {(r[0], r[1]) for r in docs.collect() if r[0] in (1, 2, 4, 7)}, key=lambda r: r[0]
    )
    assert [r[1] for r in kept.collect() if r[0] is None] == ["no id here at all"]
