"""Connected components with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, table


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component) for every node of an edge; the component is the least node that it reaches.

    Alternates two steps until nothing changes (large and small star, Kiveris et al., 2014): each node hooks its greater
    neighbours, then its lesser ones, to the least neighbour. Each step groups by node with a running minimum before the
    shuffle, so a hub's row is only a minimum; the edges of a hub are dealt over tasks by the skew join of adaptive execution.
    Null ends and loops are ignored; repeated edges count once. Each round is a table in the shared folder.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v").distinct()
    e = table(e, "edges")
    nodes = e
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = table(out.where("u != v").distinct(), "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if e is not nodes:
            drop(e)
        e = new
        if now == before:
            break
        before = now
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    named = nodes.select("u").union(nodes.select("v")).distinct()
    return named.join(roots, "u", "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component"))
