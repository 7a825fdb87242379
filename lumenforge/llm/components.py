"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_table, materialize


def _lower(pairs: DataFrame, node, least) -> DataFrame:
    """Edges (u, v) with v < u, without repeats."""
    return pairs.select(node.alias("u"), least.alias("v")).where("u > v").distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """One row (node, root) per node of edges; root is the least node of its component, also in its own row.

    Nodes may be of any orderable type; null nodes, loops and repeated edges count for nothing; no edges give no rows.
    A hot node is no bottleneck: minima are combined before the shuffle, and the join on u is one that Spark can split.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = materialize(_lower(e, F.greatest(a, b), F.least(a, b)), "cc")
    mark = _mark(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _lower(both.join(least, "u").where("v > u"), F.col("v"), F.col("m"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = _lower(near.select(F.explode(F.array(F.struct(F.col("u").alias("n"), "m"), F.struct(F.col("v").alias("n"), "m"))).alias("x")), F.col("x.n"), F.col("x.m"))
        new = materialize(small, "cc")
        now = _mark(new)
        drop_table(e)
        e = new
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
