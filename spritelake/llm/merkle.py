"""Merkle manifest of a table: a tree of digests a group, a tree over their roots, and a proof for every row.

*Leaves.*  A row's leaf is the digest of its fields, each ``-`` if null, else its length in UTF-8
bytes, ``:`` and its value.  Within a group leaves ascend by id; a group without a name is one too.

*Levels.*  A level's nodes are partitioned by group and parent index, and an ordered full-frame
``collect_list`` holds the run of children: it is the parent's preimage and, without the node
itself, its siblings.  Each parent is kept once for the next level (the row of its first child),
so levels shrink by the arity and all exchanges together move twice the leaves, wherever
the rows of a large group lie.  Groups end when one node is left; the roots of all groups make
the levels of one more tree, ordered by group (null first, then bytewise).

*Proofs.*  Levels are joined from the top down: a node's path is its own siblings before those of
its parent, so a path is put together once for each node, not once for each leaf and level.  A path
is folded by ``folded``; with the leaf of the stored row it gives the root, with any other leaf not.

Index numbers come from range partitions (``ordinals``), so no group is sorted in one task.  The
driver sees the size of the largest group, the number of groups and the root.  Rows that repeat an
id are leaves of their own, in order of their digests; null ids come first.  An empty table has no
rows and no root.  Columns beside those named are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordinals import ordinals
from ._shared import drop, written

PATH = "array<struct<before:binary,after:binary>>"


def field(value: Column) -> Column:
    """One field of a preimage."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, each from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.lower(F.hex(F.concat(s["before"], s["after"])))), ""), 256)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    text = lambda b: F.lower(F.hex(b))
    return F.aggregate(path, node, lambda d, s: F.sha2(F.concat(text(s["before"]), d, text(s["after"])), 256))


def _levels(nodes: DataFrame, most: int, arity: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of nodes (g, i, n, digest, ...): the levels (g, i, parent, before, after, ...) from the leaves up, and the
    roots (g, digest) of the groups that end at each height."""
    levels, roots = [], [nodes.where("n = 1").select("g", "digest")]
    run = Window.partitionBy("g", "parent").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while most > 1:
        children = nodes.where("n > 1").withColumn("parent", F.floor(F.col("i") / arity)).withColumn("run", F.collect_list("digest").over(run))
        at = (F.col("i") % arity).cast("int")
        joined = lambda part: F.unhex(F.array_join(part, ""))
        levels.append(written(children.select("*", joined(F.slice("run", F.lit(1), at)).alias("before"), joined(F.slice("run", at + 2, F.lit(arity))).alias("after"), F.sha2(F.array_join("run", ""), 256).alias("up")).drop("run")))
        first = levels[-1].where(F.col("i") == F.col("parent") * arity)  # each parent once
        nodes = first.select("g", F.col("parent").alias("i"), F.ceil(F.col("n") / arity).alias("n"), F.col("up").alias("digest"))
        roots.append(nodes.where("n = 1").select("g", "digest"))
        most = -(-most // arity)
    return levels, roots


def _paths(levels: list[DataFrame], tops: DataFrame, keep: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Leaves that have a parent, with their path, ``keep`` of the group's top (g, height, path, ...) and ``carry`` of their own."""
    at = lambda h: tops.where(F.col("height") == h).select("g", F.lit(0).cast("long").alias("parent"), "path", *keep)
    above = at(len(levels))
    for h in reversed(range(len(levels))):
        path = F.concat(F.array(F.struct("before", "after")), "path").cast(PATH).alias("path")
        here = levels[h].join(above, ["g", "parent"])
        if not h:
            return here.select(*carry, path, *keep)
        last, above = above, written(here.select("g", F.col("i").alias("parent"), path, *keep).unionByName(at(h)))
        if h < len(levels) - 1:
            drop(last)
    return None


def proofs(leaves: DataFrame, id_col: str, group_col: str, digest_col: str, carry: Sequence[str] = (), arity: int = 2) -> DataFrame:
    """id, digest and ``carry`` of every leaf with its path, subroot and root."""
    if arity < 2:
        raise ValueError("a parent has two children at least")
    own = [F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(carry)]
    kept = [f"own_{k}" for k in range(len(own))]
    group = F.when(F.col(f"`{group_col}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")))
    rows = leaves.select(F.col(f"`{id_col}`").alias("id"), group.alias("g"), F.col(f"`{digest_col}`").alias("digest"), *own)
    nodes = written(ordinals(rows, ["id", "digest"], ["g"], "i", "n"))
    levels, ended = _levels(nodes, nodes.agg(F.max("n")).first()[0] or 0, arity)

    by_height = [r.withColumn("height", F.lit(h)) for h, r in enumerate(ended)]
    roots = by_height[0]
    for more in by_height[1:]:
        roots = roots.unionByName(more)
    roots = written(ordinals(written(roots).withColumnRenamed("g", "name"), ["name"], (), "i", "n").withColumn("g", F.lit("")))
    count = roots.count()
    above, [*_, top] = _levels(roots, count, arity)
    root = top.first()
    start = roots.sparkSession.range(1).select(F.lit("").alias("g"), F.lit(len(above)).alias("height"), F.array().cast(PATH).alias("path"))
    named = [F.col("name").alias("g"), "height", "path", F.col("digest").alias("subroot"), F.lit(root and root["digest"]).cast("string").alias("root")]
    tops = _paths(above, start, (), ("name", "height", "digest")) if above else roots.select("name", "height", "digest", F.array().cast(PATH).alias("path"))
    tops = written(tops.select(*named))

    out = ["id", "digest", *kept]
    alone = nodes.where("n = 1").join(tops.where("height = 0"), "g").select(*out, "path", "subroot", "root")
    all_ = _paths(levels, tops, ("subroot", "root"), out).unionByName(alone) if levels else alone
    return all_.select(F.col("id").alias(id_col), F.col("digest").alias(digest_col), *(F.col(k).alias(c) for k, c in zip(kept, carry, strict=True)), "path", "subroot", "root")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Manifest and proofs of ``documents``; where 7 divides the checksum of the id, one is added to n_chars before the
    row is verified.  Texts are hashed once, into a written table of digests."""
    value = {c: F.col(c) for c in FIELDS}
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(*(value | {"n_chars": F.col("n_chars") + 1}).values()))
    leaves = written(docs.select("doc_id", "lang", leaf(*value.values()).alias("leaf"), changed.alias("changed")))
    rows = proofs(leaves, "doc_id", "lang", "leaf", ["changed"])
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
