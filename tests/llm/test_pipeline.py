import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from odd import odd_documents
from test_near_copies import plain_groups
from test_rules import plain_statistics
from test_secrets import plain_base
from tokenizers import Tokenizer

import corpus_pipeline
from zonespark.llm.common import keep, pick

SF = "/root/testdata/sf0.01"


def test_every_stage_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())

    kept = keep(stages["quality rules"](spark, docs, SF))
    assert kept.columns == columns
    before, after = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in kept.collect()}
    assert all(after[d] == before[d] for d in after)
    for d, r in before.items():
        n, _, _, _, repeated = plain_statistics(r["text"])
        if n < 50 or 2 * repeated > n:
            assert d not in after
        elif labels.get(d) == 1:
            assert d in after
    assert any(labels.get(d) == 0 and plain_statistics(before[d]["text"])[0] >= 50 and d not in after for d in before)

    single = keep(stages["SimHash near-dedup"](spark, kept, SF))
    rows = kept.collect()
    ids = [r["doc_id"] for r in rows]
    groups = plain_groups({r["doc_id"]: r["text"] for r in rows})
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(set(groups.values())) and len(set(groups.values())) < len(ids)

    clean = keep(stages["secret scans"](spark, single, SF))
    was, now = {r["doc_id"]: r for r in single.collect()}, {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == columns and set(was) == set(now)
    assert all(plain_base(now[d]["text"]) == [] and ((now[d] == was[d]) == (not plain_base(was[d]["text"]))) for d in now)
    assert all(len(r["text"]) == r["n_chars"] for d, r in now.items() if plain_base(was[d]["text"])) and any(now[d] != was[d] for d in now)

    mixed = keep(stages["mixing sources to target weights"](spark, clean, SF))
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == columns and set(times) == set(now) and set(times.values()) <= {1, 2}

    pieces = stages["packing"](spark, mixed, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = Counter()
    for p in pieces:
        tokens[p["doc_id"]] += p["length"]
    for d, n in times.items():
        assert tokens[d] == n * (len(tokenizer.encode(now[d]["text"], add_special_tokens=False).ids) + 1)
    assert all(zlib.crc32(p["ids"]) == p["ids_crc32"] and len(np.frombuffer(p["ids"], "<u4")) == p["length"] for p in pieces)


def test_run_applies_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, sf))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    found = corpus_pipeline.run(spark, sf)
    assert found.columns == packed.columns
    assert found.selectExpr("sum(length)").first() == packed.selectExpr("sum(length)").first()


def test_stages_bear_odd_documents(spark):
    docs = odd_documents(spark)
    for part in (docs, docs.limit(0)):
        part = pick(part, "doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, part, "/root/testdata/sf0.001").columns == part.columns
            stage(spark, part, "/root/testdata/sf0.001").collect()
        corpus_pipeline.STAGES[-1][1](spark, part, SF).collect()
