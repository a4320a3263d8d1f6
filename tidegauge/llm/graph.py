"""Connected components by repeated contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import cut, drop_cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of an edge, the smallest node that it can reach.

    Each round hooks every node to its smallest neighbour if that is smaller (a minimum with
    partial aggregation, so that the centre of a large star is no hot task), takes two pointer
    jumps, and contracts the edges; edges within one node go. The nodes that are left at
    least halve, so rounds grow with the logarithm of the longest path. The smallest node of a
    component never hooks, so it is the name at the end. Null ends and self-loops are ignored;
    repeated edges count once; without edges the result is empty.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    names = None
    while not e.isEmpty():
        # hook the larger end to the smallest smaller neighbour; nodes without one stay
        p = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        p = cut(p, "hooks")
        for _ in range(2):
            q = p.select(F.col("node").alias("up"), F.col("up").alias("further"))
            longer = cut(p.join(q, "up", "left").select("node", F.coalesce("further", "up").alias("up")), "hooks")
            drop_cut(p)
            p = longer
        if names is None:
            new = p.select("node", F.col("up").alias("component"))
        else:
            q = p.select(F.col("node").alias("component"), F.col("up").alias("further"))
            known = names.join(q, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
            new = known.unionByName(p.join(names.select("node"), "node", "left_anti").select("node", F.col("up").alias("component")))
        new = cut(new, "names")
        pa = p.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        pb = p.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        n = e.join(pa, "a", "left").join(pb, "b", "left").select(F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y")).where("x <> y")
        n = cut(n.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        for old in [e, p] + ([names] if names is not None else []):
            drop_cut(old)
        e, names = n, new
    if names is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = names.select(F.col("component").alias("node")).distinct().join(names.select("node"), "node", "left_anti")
    return names.unionByName(roots.select("node", F.col("node").alias("component")))
