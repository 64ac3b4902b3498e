"""Ranked lexical search over a document FP-tree, by depth-first branch and bound per item.

Every document is read once and cut down to the terms that items ask for. Its terms, the most frequent first, are a path;
documents that begin alike share it. A node knows, for the documents below it, the largest tf of each term and the smallest m.
As a score grows with tf and falls with m, these bound every score below the node, and a branch that cannot reach
an item's ten best is never entered. Each task builds trees over blocks of bounded size and keeps the best of all its blocks.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonespark.llm.common import keep, pick, split_blocks
from zonespark.shipping import ship_package

# Terms are runs of ASCII letters and digits and of anything beyond ASCII; only A-Z change case.
_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Documents of a leaf, documents and terms of a tree, and nodes one below the other before the rest is cut into leaves.
_LEAF, _TREE, _ENTRIES, _DEEPEST = 32, 8192, 2_000_000, 200
#: Pairs of item and term that are searched at once.
_ASKED = 200_000


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of bounded size."""
    for block in split_blocks(text):
        yield block.translate(_TERMS).split()


@dataclass
class Node:
    """Documents first to last of a tree: bounds of what they score, and what is below."""

    first: int
    last: int
    terms: np.ndarray
    tf: np.ndarray
    m: int
    least_id: int
    children: list["Node"] = field(default_factory=list)
    #: Of a leaf: its (term, document, tf), sorted by term, and each document's m.
    entries: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


class Tree:
    """FP-tree of documents given as arrays: id and m of each, where its terms begin, and the terms (frequent first) with tf."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, starts: np.ndarray, terms: np.ndarray, tf: np.ndarray):
        paths = [terms[a:b].astype(">u4").tobytes() for a, b in zip(starts, starts[1:])]
        # In this order documents with the same beginning stand side by side.
        order = sorted(range(len(paths)), key=paths.__getitem__)
        self.paths = [paths[i] for i in order]
        self.ids, self.m = ids[order], m[order]
        sizes = np.diff(starts)[order]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        moved = np.repeat(starts[:-1][order] - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        self.terms, self.tf = terms[moved], tf[moved]
        self.root = self._node(0, len(paths), 0)

    def _node(self, first: int, last: int, level: int) -> Node:
        if last - first <= _LEAF:
            return self._leaf(first, last)
        cuts = self._branches(first, last) if level < _DEEPEST else []
        if len(cuts) < 2:
            cuts = list(range(first, last, _LEAF))
        children, waiting = [], first
        for a, b in zip(cuts, [*cuts[1:], last]):
            if b - a > _LEAF:
                if waiting < a:
                    children.append(self._leaf(waiting, a))
                children.append(self._node(a, b, level + 1))
                waiting = b
            elif b - waiting > _LEAF:
                # Small branches that stand side by side share a leaf.
                children.append(self._leaf(waiting, a))
                waiting = a
        if waiting < last:
            children.append(self._leaf(waiting, last))
        terms, tf = _maxima(np.concatenate([c.terms for c in children]), np.concatenate([c.tf for c in children]))
        return Node(first, last, terms, tf, min(c.m for c in children), min(c.least_id for c in children), children)

    def _branches(self, first: int, last: int) -> list[int]:
        """Where the documents of a range start that share one term more than the whole range does."""
        a, b = self.paths[first], self.paths[last - 1]
        shared = next((i for i in range(0, min(len(a), len(b)), 4) if a[i : i + 4] != b[i : i + 4]), min(len(a), len(b)))
        heads = [p[shared : shared + 4] for p in self.paths[first:last]]
        return [first, *(first + i for i in range(1, len(heads)) if heads[i] != heads[i - 1])]

    def _leaf(self, first: int, last: int) -> Node:
        a, b = self.starts[first], self.starts[last]
        sizes = np.diff(self.starts[first : last + 1])
        of = np.repeat(np.arange(last - first), sizes)
        order = np.argsort(self.terms[a:b], kind="stable")
        terms, tf = _maxima(self.terms[a:b], self.tf[a:b])
        entries = self.terms[a:b][order], of[order], self.tf[a:b][order]
        return Node(first, last, terms, tf, int(self.m[first:last].min()), int(self.ids[first:last].min()), [], entries)


def _maxima(terms: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(terms):
        return terms, tf
    order = np.argsort(terms, kind="stable")
    terms, tf = terms[order], tf[order]
    first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    return terms[first], np.maximum.reduceat(tf, first)


def _share(tf: np.ndarray, m) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Item:
    """What one item asks for, and the best it has met: (-score, doc_id) in ascending order."""

    item_id: int | None
    terms: np.ndarray
    weights: np.ndarray
    best: list[tuple[int, int]] = field(default_factory=list)

    def bound(self, node: Node) -> int:
        at = np.searchsorted(node.terms, self.terms)
        at[at == len(node.terms)] = 0
        met = node.terms[at] == self.terms
        return int((self.weights[met] * _share(node.tf[at[met]], node.m)).sum())

    def scores(self, tree: Tree, leaf: Node) -> np.ndarray:
        terms, of, tf = leaf.entries
        first, last = np.searchsorted(terms, self.terms), np.searchsorted(terms, self.terms, "right")
        sizes = last - first
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        found = np.zeros(leaf.last - leaf.first, np.int64)
        np.add.at(found, of[at], np.repeat(self.weights, sizes) * _share(tf[at], tree.m[leaf.first + of[at]]))
        return found

    def search(self, tree: Tree, top: int) -> int:
        """Meet the documents of a tree; the number of leaves that had to be opened is returned."""
        stack, opened = [(self.bound(tree.root), tree.root)], 0
        while stack:
            bound, node = stack.pop()
            if not bound or len(self.best) == top and (-bound, node.least_id) > self.best[-1]:
                continue
            if node.children:
                bounded = [(self.bound(c), c) for c in node.children]
                # The most promising branch is entered first, as it stands last.
                stack += sorted(bounded, key=lambda b: b[0])
                continue
            opened += 1
            found = self.scores(tree, node)
            some = np.flatnonzero(found > 0)
            if len(self.best) == top:
                some = some[found[some] >= -self.best[-1][0]]
            if len(some):
                new = zip((-found[some]).tolist(), tree.ids[node.first + some].tolist())
                self.best = sorted([*self.best, *new])[:top]
        return opened


def _asked(items: DataFrame) -> DataFrame:
    """item_id, term, times of all items. Texts of one id are one item; a row that repeats id and text counts once."""
    texts = pick(items, "item_id", "text").filter("text is not null").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                found: Counter[bytes] = Counter()
                for terms in terms_of(text.as_buffer().to_pybytes()):
                    found.update(terms)
                ids = pa.array([item.as_py()] * len(found), pa.int64())
                columns = [ids, pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "term", "times"])

    cast = texts.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text"))
    counted = cast.mapInArrow(count, "item_id long, term string, times long")
    return counted.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def restricted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n, terms, tf of each document with a term: n counts all its terms, the others only those of the vocabulary.

    terms (places in the vocabulary, ascending) and tf are arrays of little-endian 32-bit integers.
    """
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = sent.value
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1)):
                n, found = 0, Counter()
                for terms in terms_of(text.as_buffer().to_pybytes()):
                    n += len(terms)
                    found.update(filter(places.__contains__, terms))
                if n:
                    pairs = sorted((places[t], tf) for t, tf in found.items())
                    both = np.array(pairs, "<i4").reshape(-1, 2)
                    rows.append((i, n, both[:, 0].tobytes(), both[:, 1].tobytes()))
            if rows:
                at, n, terms, tf = zip(*rows)
                ids = batch.column(0).take(pa.array(at))
                columns = [ids, pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tf"])

    texts = pick(docs, "doc_id", "text").filter("text is not null")
    cast = texts.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    vectors = keep(cast.mapInArrow(cut, "doc_id long, n long, terms binary, tf binary"))
    sent.destroy()
    return vectors


def document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """In how many of the vectors each of `size` terms stands."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for terms in batch.column(0):
                total[np.frombuffer(terms.as_buffer(), "<i4")] += 1
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["term", "df"])

    df = np.zeros(size, np.int64)
    for row in vectors.select("terms").mapInArrow(add_up, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row["term"]] = row["df"]
    return df


#: Stands for a null doc_id, so that it comes after all others.
_NO_ID = np.iinfo(np.int64).max


def _best_of(vectors: DataFrame, items: list[Item], order: np.ndarray, documents: int, words: int, top: int) -> DataFrame:
    """item_id, doc_id, score: the best of each task for each item. order is the place of each term on a path."""
    sent = vectors.sparkSession.sparkContext.broadcast((items, order))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, places = sent.value
        asking = [Item(i.item_id, i.terms, i.weights) for i in given]
        held: list[tuple] = []

        def meet() -> None:
            ids, m, sizes, terms, tf = zip(*held)
            held.clear()
            starts = np.concatenate([[0], np.cumsum(sizes)])
            tree = Tree(np.array(ids, np.int64), np.array(m, np.int64), starts, np.concatenate(terms), np.concatenate(tf))
            for item in asking:
                item.search(tree, top)

        entries = 0
        for batch in batches:
            for doc_id, n, terms, tf in zip(*(batch.column(i) for i in range(4))):
                path = places[np.frombuffer(terms.as_buffer(), "<i4")]
                if not len(path):
                    continue
                along = np.argsort(path)
                m = 100 - 75 + (75 * n.as_py() * documents) // words
                times = np.frombuffer(tf.as_buffer(), "<i4").astype(np.int64)[along]
                held.append((doc_id.as_py() if doc_id.is_valid else _NO_ID, m, len(path), path[along], times))
                entries += len(path)
                if len(held) == _TREE or entries >= _ENTRIES:
                    meet()
                    entries = 0
        if held:
            meet()
        rows = [(i.item_id, None if d == _NO_ID else d, -s) for i in asking for s, d in i.best]
        if rows:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    found = keep(vectors.mapInArrow(search, "item_id long, doc_id long, score long"))
    sent.destroy()
    return found


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """The `top` highest-scoring documents of each item: item_id, rank (from 1), doc_id, score.

    docs has doc_id and text, items has item_id and text; other columns are ignored. Null texts hold no term, and a document
    without a term counts for nothing. Every row of docs is a document of its own, repeated ones too. The texts of one item_id are one item. Equal scores go by
    ascending doc_id, a null one last. Empty tables give an empty result. Texts of any length are read whole, in blocks.
    """
    spark = docs.sparkSession
    ship_package(spark)
    asked = keep(_asked(items))
    blocks = -(-asked.count() // _ASKED)
    best = None
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        vocabulary = sorted({r["term"].encode() for r in part})
        place = {t: i for i, t in enumerate(vocabulary)}
        vectors = restricted(docs, vocabulary)
        documents, words = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_frequencies(vectors, len(vocabulary))
        weights = [floor(1000 * log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()]
        order = np.empty(len(vocabulary), np.int32)
        order[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df), dtype=np.int32)
        by_item: dict[int | None, list[tuple[int, int]]] = {}
        for r in part:
            at = place[r["term"].encode()]
            by_item.setdefault(r["item_id"], []).append((int(order[at]), r["times"] * weights[at]))
        wanted = []
        for item_id, pairs in by_item.items():
            terms, weight = zip(*sorted(pairs))
            wanted.append(Item(item_id, np.array(terms, np.int32), np.array(weight, np.int64)))
        found = _best_of(vectors, wanted, order, documents, words, top)
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = spark.createDataFrame([], "item_id long, doc_id long, score long")
    by_score = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
