"""One JSON document as an ordered table of text fragments.

A document over a large library does not fit one row, one task or the driver. Here every zone, and every
opening and closing bracket above it, is its own row; sorted and written as text, the part files put one
after the other are the document.
"""

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonespark.plans.ordering import join_large, lookup, materialise, sorted_parts
from zonespark.sources.ranged import write_parts


@dataclass
class Level:
    """Rows of one nesting depth: key columns (the parent's first), `order`, `open`, `close`.

    `order` has to be unique among the rows of one parent. A row without `close` is closed already. `few_parents` says
    that the level above has few rows with many below each, so that it is repeated to divide them.
    """

    rows: DataFrame
    keys: list[str]
    few_parents: bool = True


def literal(value) -> str:
    """A constant as JSON; a whole float is written as the integer it equals."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, ensure_ascii=False)


def member(indent: int, name: str, value: Column) -> Column:
    return F.concat(F.lit(" " * indent + literal(name) + ": "), value)


def members(indent: int, fields: dict[str, Column]) -> Column:
    return reduce(
        lambda a, b: F.concat(a, F.lit(",\n"), b), [member(indent, name, value) for name, value in fields.items()]
    )


def document(head: str, levels: list[Level], tail: str, comma: str = ",") -> DataFrame:
    """Columns `line` and `place`; sorted by place, the lines are the document."""
    depth = len(levels)
    spark_rows = levels[0].rows
    orders = [level.rows.schema["order"].dataType for level in levels]

    def place(phase: int, parts: list[tuple[Column, int]]) -> Column:
        fields = [F.lit(phase).alias("phase")]
        for i in range(depth):
            order, side = parts[i] if i < len(parts) else (F.lit(None).cast(orders[i]), None)
            fields.append(order.alias(f"o{i}"))
            fields.append(F.lit(side).cast("int").alias(f"s{i}"))
        return F.struct(*fields).alias("place")

    pieces = []
    above: DataFrame | None = None
    for i, level in enumerate(levels):
        inner = i < depth - 1
        # A level that others hang from is read several times, and is small beside the leaves.
        rows = materialise(level.rows) if inner else level.rows
        if above is None:
            final = rows.orderBy(F.col("order").desc()).limit(1).select(*level.keys, F.lit(True).alias("_is_last"))
            rows = rows.join(final, level.keys, "left").withColumn("_last", F.coalesce("_is_last", F.lit(False)))
        else:
            parent = levels[i - 1].keys
            ends = rows.groupBy(*parent).agg(F.max("order").alias("_max"))
            opened = join_large(above, ends, parent)
            rows = lookup(rows, opened, parent, ["order"]) if level.few_parents else join_large(rows, opened, parent)
            rows = rows.withColumn("_last", F.col("order") == F.col("_max"))
        path = [(F.col(f"_o{j}"), 1) for j in range(i)]
        here = F.col("order")
        end = F.when(F.col("_last"), "").otherwise(comma)
        closed = F.col("close").isNull()
        opening = F.concat(F.col("open"), F.when(closed, end).otherwise(""))
        pieces.append(rows.select(opening.alias("line"), place(1, [*path, (here, 0)])))
        if inner:
            pieces.append(
                rows.filter(~closed).select(F.concat("close", end).alias("line"), place(1, [*path, (here, 2)]))
            )
            above = rows.select(*level.keys, *[f"_o{j}" for j in range(i)], here.alias(f"_o{i}"))
    one = spark_rows.sparkSession.range(1)
    pieces.append(one.select(F.lit(head).alias("line"), place(0, [])))
    pieces.append(one.select(F.lit(tail).alias("line"), place(2, [])))
    return reduce(lambda a, b: a.unionByName(b), pieces)


def in_order(fragments: DataFrame) -> DataFrame:
    return sorted_parts(fragments, "place").select("line")


def write_document(fragments: DataFrame, path: str) -> None:
    """Write the fragments in order; the part files put one after the other are the document."""
    in_order(fragments).write.mode("errorifexists").text(path)


def write_document_parts(fragments: DataFrame, path: str) -> None:
    """Write the fragments in order as one document: parts, and a manifest with the place of each. All of it or nothing is there."""
    write_parts(in_order(fragments), path)
