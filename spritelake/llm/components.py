"""Connected components of an edge table, without an unbounded group in one task or the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    FastSV: each round hooks a node and its parent to the smallest grandparent among its
    neighbours and halves the paths, so rounds grow with the logarithm of the longest chain.
    All steps are joins on keys and minima, which combine before the shuffle; the driver
    sees only whether anything changed.  Edges and states are written tables, so that both sides
    of a join on a node with very many neighbours come straight from an exchange, and adaptive
    execution can split it.  Null ends and loops are left out; with no edge the result is empty.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    both = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    state = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("f")))
    while True:
        grand = state.join(state.select(F.col("u").alias("f"), F.col("f").alias("g")), "f").select("u", "f", "g")
        near = both.join(grand.select(F.col("u").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("m"))
        hooks = grand.join(near, "u").select(F.explode(F.array(F.struct("u", F.least("g", "m").alias("f")), F.struct(F.col("f").alias("u"), F.col("m").alias("f")))).alias("x"))
        after = written(hooks.select("x.*").groupBy("u").agg(F.min("f").alias("f")))
        changed = after.join(state.withColumnRenamed("f", "old"), "u").where("f <> old").limit(1).count()
        drop(state)
        state = after
        if not changed:
            drop(both)
            return state.select(F.col("u").alias("node"), F.col("f").alias("component"))
