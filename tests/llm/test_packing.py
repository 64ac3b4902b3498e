import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from odd import odd_documents, rows_of
from tokenizers import Tokenizer

from zonespark.llm import packing
from zonespark.llm.packing import hilbert_key, pack_documents
from zonespark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def expected_ids(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(pieces, texts):
    """pieces: dicts; texts: list of (doc_id, text), repeated rows included."""
    sequences, found = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        found[p["doc_id"]].append((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    wanted = defaultdict(list)
    for doc_id, text in texts:
        wanted[doc_id].append(expected_ids(text))
    assert set(found) == set(wanted)
    for doc_id, all_ids in wanted.items():
        assert sum(n for _, n, _, _ in found[doc_id]) == sum(map(len, all_ids))
        for start, length, crc, total in found[doc_id]:
            parts = [ids[start : start + length] for ids in all_ids if len(ids) == total]
            assert crc in [zlib.crc32(np.array(p, "<u4").tobytes()) for p in parts]
        if len(all_ids) == 1:
            at = 0
            for start, length, _, _ in sorted(found[doc_id]):
                assert start == at
                at += length


def test_every_id_lies_in_one_piece(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    pieces = [r.asDict() for r in QUERIES["op1_curve_packing"](spark, SF).collect()]
    check_pieces(pieces, [tuple(r) for r in docs])


def test_odd_documents(spark):
    docs = odd_documents(spark)
    pieces = [r.asDict() | {"ids_crc32": zlib.crc32(r["ids"])} for r in pack_documents(docs).collect()]
    check_pieces(pieces, [(r[0], r[1]) for r in docs.collect()])
    assert rows_of(pack_documents(docs.limit(0))) == []


@pytest.mark.parametrize("text", [
    "a b c d", "é x́\ty", "don't I'LL\x0bfoo\x0cbar", "<|endoftext|> a<|endoftext|>b", "ΑΣ ΑΣ. ὈΔΥΣΣΕΎΣ", "İstanbul ﬁ x", "\x1c a\x85b",
    "à́ ̧b", "힣ᆨ 한", " ̈ x", "École ÉTÉ ß ÿ× a÷b ª µ", "x!!!\"# $%& y", "a</w> b</w>, <w>", "naïve, élan. Ærø", "­soft a b", "",
])
def test_ids_are_those_of_the_tokenizer(text):
    words = packing._Words(packing._tokenizer("word_bpe_49k.json"))
    for _ in range(2):
        assert np.frombuffer(packing.document_ids(text.encode(), words, 1), "<u4").tolist() == expected_ids(text)


def test_other_tokenizers_are_read_word_by_word_only_through_themselves():
    words = packing._Words(packing._tokenizer("byte_bpe_50k.json"))
    assert not words.lowering


@pytest.mark.parametrize("dimensions, bits", [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dimensions, bits):
    points = np.array(list(product(range(1 << bits), repeat=dimensions)))
    keys = hilbert_key(points, bits)
    assert sorted(keys) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_a_rest_is_cut_into_powers_of_two(spark):
    docs = spark.createDataFrame([(1, "a " * 2500), (2, "b " * 37)], "doc_id long, text string")
    pieces = pack_documents(docs, partitions=1).collect()
    lengths = defaultdict(int)
    for p in pieces:
        lengths[p["sequence_id"]] += p["length"]
    total = sum(p["length"] for p in pieces)
    assert total == 2500 + 1 + 37 + 1
    assert sorted(lengths.values(), reverse=True) == [2048] + [1 << b for b in range(11, -1, -1) if (total - 2048) >> b & 1]
