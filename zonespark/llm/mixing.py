"""Mixing sources to target weights by Pfair scheduling.

Time is cut into slots of one block each. Block j of a source with `parts` out of `resolution` is released at slot
floor(j * resolution / parts) and due by ceil((j + 1) * resolution / parts); in each slot the released block with the
earliest deadline is read. Every deadline is met, so at any time every source is less than one block off its weight.
The weights are taken as exact fractions, as whole parts of any size, so nothing drifts however long the input is. The
driver goes through the slots once and remembers only where every source stands at the start of each stretch; the
tasks go through their stretches again and give out the blocks.
"""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import gcd, lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonespark.llm.common import keep, pick
from zonespark.plans.ordering import with_global_rank
from zonespark.shipping import ship_package

#: Slots that one task goes through at a time.
STRETCH = 1 << 16


def parts_of(shares: dict[str, float], resolution: int) -> dict[str, int]:
    """Whole parts that sum to the resolution, by largest remainder; every source has one at least."""
    total = sum(shares.values())
    exact = {s: w / total * (resolution - len(shares)) for s, w in shares.items()}
    parts = {s: int(x) + 1 for s, x in exact.items()}
    left = resolution - sum(parts.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:left]:
        parts[s] += 1
    return parts


def pfair_round(parts: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block) for every slot of one round, earliest deadline first among the released blocks."""
    length = sum(parts.values())
    released = sorted((j * length // p, -(-(j + 1) * length // p), s, j) for s, p in parts.items() for j in range(p))
    ready: list[tuple[int, str, int]] = []
    slots, upcoming = [], 0
    for slot in range(length):
        while upcoming < len(released) and released[upcoming][0] <= slot:
            heapq.heappush(ready, released[upcoming][1:])
            upcoming += 1
        deadline, source, block = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a block missed its deadline")
        slots.append((source, block))
    return slots


def exact_parts(shares: dict[str, float]) -> dict[str, int]:
    """The shares as whole parts in exactly their proportions."""
    exact = {s: Fraction(w) for s, w in shares.items()}
    whole = lcm(*(x.denominator for x in exact.values()))
    parts = {s: int(x * whole) for s, x in exact.items()}
    common = gcd(*parts.values())
    return {s: p // common for s, p in parts.items()}


def pfair_slots(parts: dict[str, int], at: dict[str, int], first: int, last: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) for slots first to last - 1, earliest deadline first among the released.

    `at` holds the next block of every source at the first slot, and at the end that of the last one. A block of a
    source is released after the one before it was due, or in the last slot before that, so one a source is enough.
    """
    length = sum(parts.values())
    upcoming = [(j * length // parts[s], -(-(j + 1) * length // parts[s]), s) for s, j in at.items()]
    heapq.heapify(upcoming)
    ready: list[tuple[int, str, int]] = []
    for slot in range(first, last):
        while upcoming and upcoming[0][0] <= slot:
            release, deadline, source = heapq.heappop(upcoming)
            heapq.heappush(ready, (deadline, source, release))
        deadline, source, release = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a block missed its deadline")
        j, p = at[source], parts[source]
        yield source, j, release, deadline, slot
        at[source] = j + 1
        heapq.heappush(upcoming, ((j + 1) * length // p, -(-(j + 2) * length // p), source))


def _schedule(spark, parts: dict[str, int], blocks: dict[str, int], horizon: int, max_epochs: int | None) -> DataFrame:
    """name, number, release, deadline, slot of every block that is due by the horizon."""
    ship_package(spark)
    at, starts = dict.fromkeys(parts, 0), []
    for first in range(0, horizon, STRETCH):
        starts.append((first, [at[s] for s in parts]))
        for _ in pfair_slots(parts, at, first, min(first + STRETCH, horizon)):
            pass
    names = ["name", "number", "release", "deadline", "slot"]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stands in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = pfair_slots(parts, dict(zip(parts, stands)), first, min(first + STRETCH, horizon))
                rows = [r for r in found if r[3] <= horizon and (max_epochs is None or r[1] < max_epochs * blocks[r[0]])]
                if rows:
                    types = [pa.string(), *[pa.int64()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    stands = spark.createDataFrame(starts, "first long, stands array<long>")
    schema = "name string, number long, release long, deadline long, slot long"
    return stands.repartition(max(len(starts), 1), "first").mapInArrow(stretches, schema)


@dataclass
class Mix:
    """The scheduled documents, and the slot by which every source has been read once."""

    rows: DataFrame
    horizon: int
    parts: dict[str | None, int]


def _named(source):
    """Sources by a name that is never null and differs for the null source."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source))


def pfair_mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, tempering: float = 0.9, block_docs: int = 32,
    resolution: int | None = None, max_epochs: int | None = 1,
) -> Mix:
    """Schedule the documents (doc_id, source) of every source in blocks.

    rows: doc_id, source, epoch, block (of the source), place (in the block), release, deadline, slot; reading by slot,
    then place, gives the mix. A source that has run out leaves its slots idle, so the others keep their weights. With
    max_epochs above 1, sources that run out before the horizon start again, up to so many times; with None as often as
    their weight asks for, with every block that is due by the horizon.

    weights: per source, sources without one get none of their rows dropped: they count with the least weight given.
    Without weights a source counts by its number of documents to the power `tempering`. Weights are followed exactly, or
    rounded to whole parts of `resolution` if one is given. The number of sources is taken to be small, as a weight is
    set for each.
    A null source is a source of its own. Rows repeating a doc_id of a source are one document; null ids are documents
    like others. An empty table gives an empty mix. Columns other than doc_id and source are ignored.
    """
    spark = docs.sparkSession
    light = (
        pick(docs, "doc_id", "source").select(F.col("doc_id").cast("long"), "source", _named(F.col("source").cast("string")).alias("name"))
        .distinct()
    )
    ranked = keep(
        with_global_rank(
            light.withColumns({"_hash": F.xxhash64("doc_id"), "_id": F.coalesce("doc_id", F.lit(0)), "_null": F.col("doc_id").isNull()}),
            ["name", "_hash", "_id", "_null"],
        ).drop("_hash", "_id", "_null")
    )
    found = {r["name"]: (r["source"], r["n"], r["first"]) for r in ranked.groupBy("name").agg(
        F.first("source").alias("source"), F.count("*").alias("n"), F.min("rank").alias("first")
    ).collect()}
    if weights is None:
        shares = {name: n**tempering for name, (_, n, _) in found.items()}
    else:
        least = min((w for w in weights.values() if w > 0), default=1.0)
        shares = {name: max(weights.get(source, least), least) for name, (source, _, _) in found.items()}
    if resolution is not None and shares:
        parts = parts_of(shares, max(resolution, 2 * len(shares)))
    else:
        parts = exact_parts(shares) if shares else {}
    length = sum(parts.values())
    blocks = {name: -(-n // block_docs) for name, (_, n, _) in found.items()}
    horizon = max((-(-blocks[s] * length // parts[s]) for s in parts), default=0)
    per_source = spark.createDataFrame(
        [(name, first, blocks[name]) for name, (_, _, first) in found.items()], "name string, first long, blocks long"
    )
    # The table that is broadcast has one row per source.
    place = F.col("rank") - F.col("first")
    scheduled = (
        _schedule(spark, parts, blocks, horizon, max_epochs).join(F.broadcast(per_source.select("name", "blocks")), "name")
        .select("name", F.expr("number div blocks").alias("epoch"), (F.col("number") % F.col("blocks")).alias("block"), "release", "deadline", "slot")
    )
    rows = (
        ranked.join(F.broadcast(per_source), "name")
        .withColumns({"block": F.floor(place / block_docs).cast("long"), "place": place % block_docs})
        .join(scheduled, ["name", "block"])
        .select("doc_id", "source", "epoch", "block", "place", "release", "deadline", "slot")
    )
    return Mix(rows, horizon, {found[s][0]: p for s, p in parts.items()})


def mixed_documents(docs: DataFrame, max_epochs: int | None = None, **settings) -> DataFrame:
    """docs in the target mix: every row stays, and rows of sources that fall short are there again per further epoch."""
    mix = pfair_mix(docs, max_epochs=max_epochs, **settings)
    names = docs.columns
    lowered = [c.lower() for c in names]
    ids, sources = (names.index(n) if n in names else lowered.index(n) for n in ("doc_id", "source"))
    again = mix.rows.filter("epoch > 0").select(F.col("doc_id").alias("again_id"), F.col("source").alias("again_source"))
    rows = docs.toDF(*[f"_{i}" for i in range(len(names))])
    # Only the repeated documents are joined; the rest of the texts are read where they are.
    repeated = rows.join(
        keep(again), F.col(f"_{ids}").eqNullSafe(F.col("again_id")) & F.col(f"_{sources}").eqNullSafe(F.col("again_source"))
    ).select(rows.columns)
    return rows.unionByName(repeated).toDF(*names)
