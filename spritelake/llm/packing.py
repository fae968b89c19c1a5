"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents fall into pack groups of about ``GROUP`` rows by a hash of their id, rows that are alike
one to each group in turn, and each group
is packed alone: best-fit decreasing, where the open bins lie in the order of their residual
space and the successor search goes on from the tightest bin that has room until it finds one
that is compatible.  A bin carries a bitmap of its duplicate clusters, of which it may hold
one copy each, and ``per_source`` bitmaps of its sources: a source's k-th document in the bin
sets its bit in the k-th; a bin with the bit set in all of them takes no more of that source.
Null sources are free of that limit and null clusters of the other.  Open bins with the same residual
space and bitmaps are one entry of the search, under the lowest of their numbers, so many bins that hold the
same conflict are passed in one step.

A document longer than a bin is cut into pieces of exactly the capacity, each a bin of its
own, and a last piece that is packed like any other.  A document of no length takes part with
length 0.  Every document's pieces are returned, none is dropped.  Ties are broken by id and,
among rows that repeat an id, by length, source and cluster.  A group's rows are a few numbers
each, so its memory is bounded whatever the texts; a hot source or cluster is spread over all
groups.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = 4096
CAPACITY = 32_768
PER_SOURCE = 4


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> list[tuple[int, int, int, int, int]]:
    """(document, piece, start, length, bin) of documents given by decreasing length of what is left over."""
    out, n_bins = [], 0
    open_: list[tuple[int, int]] = []  # (residual, lowest number) of open bins that are alike
    alike: dict[tuple, list[int]] = {}  # their numbers as heaps, by residual and bitmaps
    bitmaps: list[tuple[int, ...]] = []  # of each bin, that of its clusters and those of its sources
    bit_of: dict = {}
    rest = []
    for i, length in enumerate(lengths):
        whole = max(0, -(-length // capacity) - 1)
        out += [(i, k, k * capacity, capacity, n_bins + k) for k in range(whole)]
        bitmaps += [()] * whole
        n_bins += whole
        rest.append((whole, length - whole * capacity))
    for i in sorted(range(len(lengths)), key=lambda i: -rest[i][1]):
        piece, length = rest[i]
        source = 0 if sources[i] is None else 1 << bit_of.setdefault(("s", sources[i]), len(bit_of))
        cluster = 0 if clusters[i] is None else 1 << bit_of.setdefault(("c", clusters[i]), len(bit_of))
        at = bisect_left(open_, (length, -1))
        while at < len(open_):
            held, *planes = bitmaps[open_[at][1]]
            if not held & cluster and (not source or any(not p & source for p in planes)):
                break
            at += 1
        if at < len(open_):
            residual, b = open_.pop(at)
            same = alike[residual, bitmaps[b]]
            heappop(same)
            if same:
                insort(open_, (residual, same[0]))
            else:
                del alike[residual, bitmaps[b]]
        else:
            residual, b = capacity, n_bins
            n_bins += 1
            bitmaps.append((0,) * (1 + per_source))
        held, *planes = bitmaps[b]
        k = next((k for k, p in enumerate(planes) if not p & source), 0)
        planes[k] |= source
        bitmaps[b] = (held | cluster, *planes)
        residual -= length
        same = alike.setdefault((residual, bitmaps[b]), [])
        if not same or b < same[0]:
            if same:
                open_.pop(bisect_left(open_, (residual, same[0])))
            insort(open_, (residual, b))
        heappush(same, b)
        out.append((i, piece, piece * capacity, length, b))
    return out


def pack(items: DataFrame, id_col: str, length_col: str, source_col: str, cluster_col: str, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group: int = GROUP) -> DataFrame:
    """bin_id, slot, id, piece, start, length: where each piece of each document lies."""
    rows = items.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{length_col}`"), F.lit(0)).cast("long").alias("length"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{cluster_col}`").cast("string").alias("cluster"))
    # rows that are alike are counted, combined before the shuffle, and dealt out one by one
    alike = rows.groupBy("id", "length", "source", "cluster").agg(F.count(F.lit(1)).alias("times"))
    groups = max(1, -(-rows.count() // group))

    def run(table: pa.Table) -> pa.Table:
        frame = table.to_pandas().sort_values(["length", "id", "source", "cluster"], ascending=[False, True, True, True], kind="stable")
        none = lambda x: x.astype(object).where(x.notna(), None).tolist()
        ids = none(frame["id"].astype("Int64"))
        found = best_fit(frame["length"].tolist(), none(frame["source"]), none(frame["cluster"]), capacity, per_source)
        found.sort(key=lambda x: (x[4], -x[3], x[0], x[1]))
        part = frame["part"].iloc[0]
        bins = np.array([x[4] for x in found], np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(bins)) + 1])
        slot = np.arange(len(bins)) - np.repeat(first, np.diff(np.append(first, len(bins))))
        return pa.table({
            "bin_id": (np.int64(part) << 32) + bins, "slot": slot.astype(np.int32), "id": pa.array([ids[x[0]] for x in found], pa.int64()),
            "piece": np.array([x[1] for x in found], np.int32), "start": np.array([x[2] for x in found], np.int64), "length": np.array([x[3] for x in found], np.int64),
        })

    single = alike.select("id", "length", "source", "cluster", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("turn"))
    part = F.pmod(F.pmod(F.xxhash64("id", "length", "cluster"), F.lit(groups)) + F.col("turn"), F.lit(groups))
    tasks = min(groups, max(2000, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = single.withColumn("part", part).drop("turn").repartition(tasks, "part").groupBy("part").applyInArrow(run, "bin_id long, slot int, id long, piece int, start long, length long")
    return placed.withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Packs texts by UTF-8 bytes plus one end mark; the cluster is that of texts equal but for case and white space."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    items = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.octet_length(text) + 1).alias("length"), F.col(f"`{source_col}`").alias("source"), F.md5(F.lower(F.regexp_replace(text, r"\s+", " ")).cast("binary")).alias("cluster"))
    return pack(items, "id", "length", "source", "cluster", **options).withColumnRenamed("id", id_col)
