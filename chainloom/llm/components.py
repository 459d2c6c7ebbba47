"""Connected components of link tables, by hooking, pointer jumping and contraction.

Links stay distributed.  Each round hooks every node to its least smaller neighbour (an
aggregation with partial results, so hot nodes are summed before their shuffle), jumps
along the hooks until they end at roots, and replaces links by links between roots, which
are few after a round or two.  All joins are between written tables, which Spark can split
where a key is hot, and broadcasts where they are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.shared import Scratch


def _ordered(a, b) -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _roots(hooks: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, p, moved) with p the end of each node's chain of hooks, which lead to smaller nodes; chains double with each jump."""
    while True:
        on = hooks.select(F.col("a").alias("p"), F.col("p").alias("q"))
        jumped = scratch.write(hooks.join(on, "p", "left").select("a", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
        scratch.remove(hooks)
        hooks = jumped
        if jumped.where("moved").isEmpty():
            return jumped


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of the links, component = smallest reachable node.

    Null ends and self-links are ignored, repeated links count once; no links give no
    rows.  Raises if links are left after ``max_rounds``.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a != b")
    first = e = scratch.write(e.select(*_ordered("a", "b")).distinct())
    named = None
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        hooks = scratch.write(e.groupBy("a").agg(F.min("b").alias("p")))
        roots = _roots(hooks, scratch)
        of = lambda c: roots.select(F.col("a").alias(c), F.col("p").alias(f"{c}_root"))
        moved = e.join(of("a"), "a").join(of("b"), "b", "left")
        left = scratch.write(moved.select(*_ordered(F.col("a_root"), F.coalesce("b_root", "b"))).where("a != b").distinct())
        if e is not first:
            scratch.remove(e)
        if named is None:
            named = roots
        else:  # what led to a node that has hooked since goes on to its root
            on = roots.select(F.col("a").alias("p"), F.col("p").alias("q"))
            longer = scratch.write(named.join(on, "p", "left").select("a", F.coalesce("q", "p").alias("p")).unionByName(roots.select("a", "p").join(named.select("a"), "a", "left_anti")))
            scratch.remove(named, roots)
            named = longer
        e = left
    else:
        raise RuntimeError(f"links are left after {max_rounds} rounds")
    if named is None:
        return first.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = named.select(F.col("a").alias("node"), F.col("p").alias("component"))
    return found.unionByName(named.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct())
