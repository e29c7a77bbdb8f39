"""Connected components by large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._state import drop, written


def _star(e: DataFrame) -> DataFrame:
    """Large-star: from each node, its larger neighbours go to the least of its neighbours and itself."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Small-star: from each node, its smaller neighbours and itself go to the least of them. Each edge has u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    to = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return to.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node of an edge; the component is its least node. Edges with a null are left out.

    Rounds go on until the edges no longer change, in about log(longest path) rounds; each is a written table.
    """
    kind = edges.schema[a].dataType.simpleString()
    e = edges.select(F.greatest(a, b).cast(kind).alias("u"), F.least(a, b).cast(kind).alias("v")).filter(f"`{a}` is not null and `{b}` is not null")
    e = written(e.distinct(), "edges")
    now = e.filter("u != v").select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    table = e.filter("u != v")
    held = None
    while now[0]:
        nxt = written(_small(_star(table)), "edges")
        was, now = now, nxt.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if held is not None:
            drop(held)
        table = held = nxt
        if tuple(now) == tuple(was):
            break
    nodes = e.select(F.col("v").alias("node")).union(e.select("u")).distinct()
    to = table.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = written(nodes.join(to, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")
    drop(e, *([held] if held is not None else []))
    return out
