"""Fingerprints of groups of any size: a tree of digests over sorted lines.

Lines are numbered within their group by range partitions, each run of ``fan`` lines becomes a digest, each run of
digests one above it, until one is left for each group.  No row or task holds a group, a line that
changes alters only the digests above it, and two trees are compared from the top.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .ordinals import ordinals

FAN = 1024


def _above(nodes: DataFrame, group: Sequence[str], fan: int) -> DataFrame:
    """One node for each run of nodes (group, i, digest, lines, n); n is how many the group has at a level."""
    run = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"]), "\n")  # at most fan
    return nodes.groupBy(*group, F.floor(F.col("i") / fan).alias("i")).agg(F.sha2(run.cast("binary"), 256).alias("digest"), F.sum("lines").alias("lines"), F.ceil(F.first("n") / fan).alias("n"))


def fingerprint_levels(rows: DataFrame, group: Sequence[str], line: Column, fan: int = FAN) -> list[DataFrame]:
    """The digests of all levels, from the leaves up, each (group, i, digest, lines, n) and a written table.

    A leaf digests up to ``fan`` lines in order, with a line feed between them; null lines are no lines, and
    lines that repeat count each.  Null groups are groups.  A group ends at the level where it has one node, so its
    fingerprint is that of its own lines whatever the other groups; without rows there is one level without any.
    """
    if fan < 2:
        raise ValueError("a node has two children at least")
    lines = rows.select(*group, line.alias("line")).where("line IS NOT NULL")
    numbered = ordinals(lines, ["line"], group, "i", "n")
    most = -(-(numbered.agg(F.max("n")).first()[0] or 0) // fan)
    levels = [written(_above(numbered.select(*group, "i", F.col("line").alias("digest"), F.lit(1).cast("long").alias("lines"), "n"), group, fan))]
    while most > 1:
        levels.append(written(_above(levels[-1].where("n > 1"), group, fan)))
        most = -(-most // fan)
    return levels


def fingerprint_tree(rows: DataFrame, group: Sequence[str], line: Column, fan: int = FAN) -> DataFrame:
    """group, lines and fingerprint: the digest at the top of each group's tree."""
    tops = [x.where("n = 1").select(*group, "lines", F.col("digest").alias("fingerprint")) for x in fingerprint_levels(rows, group, line, fan)]
    return reduce(DataFrame.unionByName, tops)


def changed(before: list[DataFrame], after: list[DataFrame], group: Sequence[str], fan: int = FAN) -> DataFrame:
    """group, i of the leaves that differ between two trees of one fan and height, found from the top: only
    tops, and what is below nodes that differ, are compared at each level."""
    if len(before) != len(after):
        raise ValueError("the trees have different heights")
    found = None
    for a, b in zip(reversed(before), reversed(after), strict=True):
        left, right = (x.select(*group, "i", "n", F.col("digest").alias(c)) for x, c in ((a, "old"), (b, "new")))
        if found is not None:
            above = found.withColumnRenamed("i", "parent")
            below = lambda x: x.where("n > 1").withColumn("parent", F.floor(F.col("i") / fan)).join(above, [*group, "parent"], "left_semi").drop("parent")
            left, right = (below(x).unionByName(x.where("n = 1")) for x in (left, right))
        found = left.drop("n").join(right.drop("n"), [*group, "i"], "full").where(~F.col("old").eqNullSafe(F.col("new"))).select(*group, "i")
    return found
