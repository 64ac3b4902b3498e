"""Connected components of a graph given by its edges, by alternating star steps on written tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonespark.llm.common import keep


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _towards_minimum(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Every neighbour v of u is tied to the smallest of u and its neighbours."""
    # The minimum comes from partial sums and is written, so that the join back may split a node with many edges.
    least = keep(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    tied = pairs.filter("v > u") if larger_only else pairs
    return tied.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), least


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable from node. Nodes without an edge and roots are not listed.

    `edges` has two long columns u and v. Each round ties neighbours to smaller nodes (large and small star), which
    keeps the components and ends in one star per component after a number of rounds logarithmic in its length.
    No adjacency list is ever gathered: a node with any number of edges is met by sums and joins that split.
    """
    edges = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = _towards_minimum(both, True)
        large = keep(large.filter("u <> v").distinct())
        small, least = _towards_minimum(large, False)
        own = least.select("u", F.col("m").alias("v"))
        edges = keep(small.unionByName(own).filter("u <> v").distinct())
        after = _state(edges)
        if after == state:
            break
        state = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
