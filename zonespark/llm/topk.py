"""Exact top-k inner products by multi-resolution segment statistics.

For segments of equal length L, the squared distance of two vectors is at least the sum over segments of
L * ((difference of means)^2 + (difference of deviations)^2). With the norms known, that lower bound on the distance is
an upper bound on the inner product. It is checked from few long segments to many short ones, and what it cannot rule
out against the k-th best score so far is scored exactly.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonespark.llm.common import keep, pick
from zonespark.plans.ordering import with_global_rank
from zonespark.shipping import ship_package

#: Segment lengths, coarse to fine. Vectors are padded with zeros to a multiple of the first.
LENGTHS = [16, 4, 2]
#: Candidates compared with a block of queries at a time.
TILE = 1024


def scaled(rows: pa.Array, width: int = 0) -> np.ndarray:
    """floor(256 * x) of every component as doubles, padded with zeros to a common width."""
    sizes = np.diff(rows.offsets.to_numpy())
    width = max(width, int(sizes.max(initial=0)))
    width = -(-max(width, 1) // LENGTHS[0]) * LENGTHS[0]
    out = np.zeros((len(sizes), width))
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(256 * flat)
    return out


def segments(vectors: np.ndarray, length: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that an inner product of two such rows bounds that of the vectors."""
    parts = vectors.reshape(len(vectors), -1, length)
    return np.hstack([parts.mean(axis=2), parts.std(axis=2)]) * np.sqrt(length)


def exact_scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond the exact range of doubles with whole-number arithmetic, held within a long."""
    most = np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * queries.shape[1]
    if most < 2**53:
        return queries @ candidates.T
    whole = [[int(x) for x in row] for row in queries], [[int(x) for x in row] for row in candidates]
    scores = [[max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c)))) for c in whole[1]] for q in whole[0]]
    return np.array(scores, dtype=object).reshape(len(whole[0]), len(whole[1]))


class _Best:
    """The k best (score, smaller id first) per query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.levels = [segments(vectors, n) for n in LENGTHS]
        self.norms = np.linalg.norm(vectors, axis=1)
        self.query, self.score, self.found = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        queries, columns = np.arange(len(self.ids)), np.arange(len(ids))
        slack = 1e-6 + 1e-9 * self.norms * np.linalg.norm(vectors, axis=1).max(initial=0)
        possible = np.ones((len(queries), len(columns)), bool)
        for level, length in zip(self.levels, LENGTHS):
            if not possible.size:
                return
            bound = level[queries] @ segments(vectors[columns], length).T
            possible &= bound >= (self.least - slack)[queries][:, None]
            # Queries and candidates without a survivor in this tile leave it.
            rows, cols = possible.any(axis=1), possible.any(axis=0)
            queries, columns, possible = queries[rows], columns[cols], possible[np.ix_(rows, cols)]
        if not possible.size:
            return
        scores = exact_scores(self.vectors[queries], vectors[columns])
        q, c = np.nonzero(possible & (scores >= self.least[queries][:, None]) & (self.ids[queries][:, None] != ids[columns]))
        self._merge(queries[q], scores[q, c], ids[columns[c]])

    def _merge(self, query: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        query, found = np.concatenate([self.query, query]), np.concatenate([self.found, found])
        score = np.concatenate([self.score, score])
        order = np.lexsort((found, -score, query))
        query, score, found = query[order], score[order], found[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (found[1:] != found[:-1]) | (score[1:] != score[:-1])
        query, score, found = query[new], score[new], found[new]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        self.query, self.score, self.found = query[keep], score[keep], found[keep]
        full = np.arange(len(query)) - first == self.k - 1
        self.least[query[full]] = score[full].astype(np.float64)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, block: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products of every query with the other rows.

    `vectors` has vec_id and embedding; the queries are the rows whose vec_id is divisible by `every`. Components count
    as floor(256 * x). Queries are taken in blocks of at most `block` rows, each broadcast in turn and held against all
    rows where they are; only the k best per task are shuffled. Vectors that are null or hold a null or non-finite
    component take no part, nor do rows without an id. Shorter vectors count as padded with zeros. Rows repeated with
    their id and score count once; of rows repeating a query's id none is its neighbour. Ties go to the smaller id. With
    fewer than k other rows all are given, and an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = keep(with_global_rank(asked, ["vec_id"]))
    partials = []
    for first in range(0, asked.count(), block):
        part = asked.filter(F.col("rank").between(first, first + block - 1)).collect()
        ids = np.array([r["vec_id"] for r in part], np.int64)
        sent = spark.sparkContext.broadcast((ids, scaled(pa.array([r["embedding"] for r in part], pa.list_(pa.float64())))))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, queries = sent.value
            best = None
            for batch in batches:
                for at in range(0, batch.num_rows, TILE):
                    tile = batch.slice(at, TILE)
                    found = scaled(tile.column(1), queries.shape[1])
                    if best is None or found.shape[1] > best.vectors.shape[1]:
                        wider = np.zeros((len(ids), found.shape[1]))
                        wider[:, : queries.shape[1]] = queries
                        # A wider tile starts the block anew with wider queries and keeps what was found.
                        before, best = best, _Best(ids, wider, k)
                        if before is None:
                            best.add(ids, wider)
                            best.query, best.score, best.found = best.query[:0], best.score[:0], best.found[:0]
                        else:
                            best.query, best.score, best.found, best.least = before.query, before.score, before.found, before.least
                    best.add(tile.column(0).to_numpy(), found if found.shape[1] == best.vectors.shape[1] else np.pad(
                        found, ((0, 0), (0, best.vectors.shape[1] - found.shape[1]))
                    ))
            if best is not None:
                columns = [pa.array(ids[best.query]), pa.array(best.found), pa.array([int(s) for s in best.score], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

        partials.append(keep(rows.mapInArrow(search, "query_id long, vec_id long, score long")))
    if not partials:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score")).limit(0)
    found = partials[0]
    for part in partials[1:]:
        found = found.unionByName(part)
    ordered = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
