"""N-gram Jaccard self-join by T-occurrence search (DivideSkip).

A document's set holds the distinct hashes of its ``width``-word shingles.  Two documents
link when ``den * |A & B| >= num * |A | B|``.  The steps, none of which holds an unbounded
group in one task or on the driver:

1. Documents with equal sets form a class (128-bit signature); one of each goes on.
2. Inverted lists: packed postings (shingle, class) go to ranges of the shingle hash.
   A shingle that occurs in several classes of one batch is counted there and sends one
   marked posting, so that a list of any length reaches a reducer as a few postings a
   batch.  Each class learns how many of its shingles occur elsewhere; a link needs an
   overlap of at least ``T = ceil(num * |A| / den)``, so classes below it have no link.
3. The rest orders its shingles by list length, rarest first.  Linked sets share one of the
   first ``|A| - T + 1``; classes that do lie in one neighbourhood.
4. A neighbourhood above ``BLOCK`` classes is parted into bands of sizes, each a factor of
   ``den / num`` wide, so that links lie within a band or between adjacent ones, and the
   bands into blocks, which are searched one against another: short inverted lists are
   merged, the longest ones are only probed by binary search for the candidates found, and
   sets with the required overlap are kept with their exact overlap.
5. Links join into components; counts of links are carried back to all copies.

Classes go by a number of their own.  Tables that meet on a key which a third of the rows may
share (a shingle, a class, a neighbourhood) are written before, so that both sides of the join
come straight from an exchange and adaptive execution can split such a key.

Texts may be null, empty or of any length; null and wordless texts have an empty set and
link with nothing.  A row whose id is null gets a null component.  Rows that repeat an id
are compared as they stand and each gets a result row, also if their texts differ.  Columns
other than the two named are not read, so their names do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import drop, written
from ._tokens import U, Tokeniser, mix, shingle_sets
from .components import components

POSTINGS_PER_RANGE = 2_000_000
BLOCK = 1024  # classes in a block of a neighbourhood


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signature(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and two 64-bit sums of each set; equal sets have equal signatures."""
    n = np.array([len(s) for s in sets], np.int64)
    k1, k2 = np.zeros(len(sets), U), np.zeros(len(sets), U)
    full = np.flatnonzero(n)
    if len(full):
        flat, at = np.concatenate([sets[i] for i in full]), np.cumsum(n[full]) - n[full]
        k1[full] = mix(np.add.reduceat(mix(flat + U(0x51ED270B)), at))
        k2[full] = mix(np.add.reduceat(mix(flat ^ U(0xA5A5F00DCAFE1234)), at))
    return n, k1, k2


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Tokeniser()
        for batch in batches:
            for lo, hi, h, counts in words.chunks(batch.column(1)):
                n, k1, k2 = signature(shingle_sets(h, counts, width))
                own = [batch.column(i).slice(lo, hi - lo) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(_signed(k1)), pa.array(_signed(k2))], ["id", "told", "n", "k1", "k2"])

    return run


def _pack(h: np.ndarray, k: np.ndarray, marked: np.ndarray) -> bytes:
    """Low 40 bits of the hashes, and the classes as runs; marked postings come last."""
    order = np.argsort(marked, kind="stable")
    h, k, many = h[order], k[order], int(marked.sum())
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    runs = np.diff(np.append(cut, len(k))).astype(np.uint32)
    head = np.array([len(h), many, len(cut)], np.uint32)
    return b"".join((head.tobytes(), k[cut].tobytes(), runs.tobytes(), h.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, many, cuts = np.frombuffer(data, np.uint32, 3).tolist()
    k = np.repeat(np.frombuffer(data, U, cuts, 12), np.frombuffer(data, np.uint32, cuts, 12 + 8 * cuts))
    h = np.zeros((n, 8), np.uint8)
    h[:, :5] = np.frombuffer(data, np.uint8, 5 * n, 12 + 12 * cuts).reshape(n, 5)
    return h.view(U).ravel(), k, np.arange(n) >= n - many


def _flush(h: np.ndarray, k: np.ndarray, ranges: int, turn: int) -> pa.RecordBatch:
    """Postings of one batch, by range; counts of what is shared within the batch."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    lengths = np.diff(np.append(np.flatnonzero(new), len(s)))
    several = np.repeat(lengths > 1, lengths)
    shared, counts = np.unique(k[order[several]], return_counts=True)
    keep = np.zeros(len(h), bool)
    keep[order[new]] = True
    marked = np.zeros(len(h), bool)
    marked[order[several]] = True
    h, k, marked = h[keep], k[keep], marked[keep]
    part = ((h >> U(32)) * U(ranges) >> U(32)).astype(np.uint32)
    order = np.argsort(part, kind="stable")
    h, k, marked, part = h[order], k[order], marked[order], part[order]
    at = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
    rows = [(int(part[i]), 0, _pack(h[i:j], k[i:j], marked[i:j])) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    if len(shared):
        rows.append((turn % ranges, 1, shared.tobytes() + counts.astype(np.int64).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], schema=pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())]))


def _post(width: int, ranges: int, most: int = 1_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size, seen, turn = Tokeniser(), [], 0, set(), 0
        for batch in batches:
            for _, _, h, counts in words.chunks(batch.column(0)):
                sets = shingle_sets(h, counts, width)
                for s, key in zip(sets, signature(sets)[1], strict=True):
                    if len(s) and key not in seen:
                        seen.add(key)
                        held.append((s, key))
                        size += len(s)
                if size >= most:
                    yield _flush(np.concatenate([s for s, _ in held]), np.repeat(np.array([k for _, k in held], U), [len(s) for s, _ in held]), ranges, turn)
                    held, size, seen, turn = [], 0, set(), turn + 1
        if size:
            yield _flush(np.concatenate([s for s, _ in held]), np.repeat(np.array([k for _, k in held], U), [len(s) for s, _ in held]), ranges, turn)

    return run


def _occurs(table: pa.Table) -> pa.Table:
    """For each class the postings of this range whose shingle another class has too (never too few)."""
    keys, counts, hs, ks, ms = [], [], [], [], []
    for kind, data in zip(table["kind"].to_pylist(), table["data"], strict=True):
        data = data.as_buffer()
        if kind:
            half = data.size // 2
            keys.append(np.frombuffer(data, U, half // 8))
            counts.append(np.frombuffer(data, np.int64, half // 8, half))
        else:
            for out, x in zip((hs, ks, ms), _unpack(data), strict=True):
                out.append(x)
    if hs:
        h, k, m = np.concatenate(hs), np.concatenate(ks), np.concatenate(ms)
        order = np.argsort(h, kind="stable")
        h, k, m = h[order], k[order], m[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        lengths = np.diff(np.append(at, len(h)))
        several = np.logical_or.reduceat(m, at) | (np.minimum.reduceat(k, at) != np.maximum.reduceat(k, at))
        found = np.repeat(several, lengths) & ~m
        u, c = np.unique(k[found], return_counts=True)
        keys.append(u)
        counts.append(c)
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    home = k % U(table["ranges"][0].as_py())
    order = np.argsort(home, kind="stable")
    at, first = np.unique(home[order], return_index=True)
    parts = np.split(order, first[1:])
    return pa.table({"home": at.astype(np.int32), "data": pa.array([k[p].tobytes() + c[p].tobytes() for p in parts] if len(at) else [], pa.binary())})


def _sum(table: pa.Table) -> pa.Table:
    """Adds the counts that the ranges found for each class."""
    parts = [x.as_buffer() for x in table["data"]]
    k = np.concatenate([np.frombuffer(x, U, x.size // 16) for x in parts])
    c = np.concatenate([np.frombuffer(x, np.int64, x.size // 16, x.size // 2) for x in parts])
    keys, where = np.unique(k, return_inverse=True)
    return pa.table({"k1": _signed(keys), "shared": np.bincount(where, c, len(keys)).astype(np.int64)})


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Tokeniser()
        for batch in batches:
            for _, _, h, counts in words.chunks(batch.column(0)):
                sets = shingle_sets(h, counts, width)
                _, k1, k2 = signature(sets)
                ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(k1)), pa.array(_signed(k2)), pa.ListArray.from_arrays(ends, _signed(np.concatenate(sets)))], ["k1", "k2", "hashes"])

    return run


def search(sets: list[np.ndarray], asks: np.ndarray, answers: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each asking set the answering ones it links with (itself left out).

    Of the asking set's inverted lists, sorted by length, the longest are put aside: at most
    T - 1, and more the longer they are (DivideSkip).  The short ones are merged, each being
    in ascending order; what occurs there at least T less the number put aside is looked up
    in the long ones by binary search.  T is the least overlap for any partner, and the
    exact bound for the partner's size decides.
    """
    if not len(asks) or not len(answers):
        return
    size = np.array([len(s) for s in sets], np.int64)
    held = np.concatenate([sets[i] for i in answers])
    owner = np.repeat(answers, size[answers])
    order = np.argsort(held, kind="stable")  # answers ascend, so every list ascends
    held, owner = held[order], owner[order]
    terms, starts = np.unique(held, return_index=True)
    ends = np.append(starts[1:], len(held))
    for i in asks.tolist():
        at = np.searchsorted(terms, sets[i])
        at = at[terms[np.minimum(at, len(terms) - 1)] == sets[i]]
        lists = sorted(zip((ends[at] - starts[at]).tolist(), starts[at].tolist(), strict=True))
        need = -(-num * int(size[i]) // den)
        if len(lists) < need:
            continue
        aside = min(need - 1, max(0, int(need / (0.05 * np.log2(lists[-1][0] + 2) + 1))))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        merged = np.sort(np.concatenate([owner[s : s + n] for n, s in short]), kind="stable")  # a merge of ascending runs
        cut = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        found, count = merged[cut], np.diff(np.append(cut, len(merged)))
        enough = (count >= need - aside) & (found != i) & (size[found] * den >= num * size[i]) & (size[i] * den >= num * size[found])
        found, count = found[enough], count[enough]
        for left, (n, s) in zip(range(aside - 1, -1, -1), reversed(long), strict=True):
            if not len(found):
                break
            where = np.minimum(np.searchsorted(owner[s : s + n], found), n - 1)
            count = count + (owner[s : s + n][where] == found)
            alive = count + left >= need
            found, count = found[alive], count[alive]
        both = size[i] + size[found] - count
        yield i, found[den * count >= num * both]


def _link(num: int, den: int):
    """Links within one task's blocks: counts for each class, and a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        own, side, copies = (table[c].to_numpy() for c in ("c", "side", "copies"))
        flat = table["hashes"].combine_chunks()
        ends, values = flat.offsets.to_numpy(), flat.values.to_numpy().view(U)
        sets = [values[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: both
        root, links = list(range(len(own))), np.zeros(len(own), np.int64)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, found in search(sets, left, right, num, den):
            links[i] += copies[found].sum()
            if side[i] != 2:
                links[found] += copies[i]
            for j in found.tolist():
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
        top = np.array([find(x) for x in range(len(own))], np.int64)
        some = np.flatnonzero(links)
        return pa.table({"c": own[some], "root": own[top[some]], "links": links[some]})

    return run


def _band(n: Column, num: int, den: int) -> Column:
    """Sizes of linked sets lie in one band or in adjacent ones (a little wider than the factor, for rounding)."""
    if num >= den:
        return n.cast("int")
    return F.floor(F.log(n) / F.lit(math.log(den / num) * 1.000001)).cast("int")


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def in_tasks(near: DataFrame) -> DataFrame:
    """(c, whole, task, side): where each class of the neighbourhoods (c, n, component, band) is compared.

    A neighbourhood of up to ``BLOCK`` classes lies in one task, with others.  In a larger one a block
    meets itself and the other blocks of its band and of the bands beside it; each such pair is a task.
    Side 0 and 1 are the two blocks, side 2 is a task that compares its classes with each other.
    """
    tasks = max(1, -(-near.count() // BLOCK))
    sizes = near.groupBy("component", "band").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("size") / BLOCK).cast("int"))))
    held = written(sizes.groupBy("component").agg(F.sum("size").alias("size"), blocks.alias("blocks")))
    of = lambda d: F.try_element_at("blocks", F.col("band") + d)
    cut = near.join(held, "component").withColumn("block", F.pmod(F.xxhash64("c"), of(0)).cast("int"))
    block, band = F.col("block"), F.col("band")
    at = lambda side, *key: F.struct(F.xxhash64("component", *key).alias("task"), side.alias("side"))
    within = F.transform(_upto(of(0)), lambda o: at(F.when(block == o, 2).when(block < o, 0).otherwise(1), band, F.least(block, o), F.greatest(block, o)))
    above = F.transform(_upto(of(1)), lambda o: at(F.lit(0), band, F.lit(-1), block, o))
    below = F.transform(_upto(of(-1)), lambda o: at(F.lit(1), band - 1, F.lit(-1), o, block))
    whole = F.col("size") <= BLOCK
    alone = F.array(F.struct(F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("task"), F.lit(2).alias("side")))
    return cut.select("c", whole.alias("whole"), F.explode(F.when(whole, alone).otherwise(F.concat(within, above, below))).alias("x")).select("c", "whole", "x.task", "x.side")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """A row a document: id, told (tells its text from others), n, component_id, n_links, part (number of its component, null without shingles or id)."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    ids = written(texts.withColumn("told", F.xxhash64("text")).mapInArrow(_sign(width), "id long, told long, n long, k1 long, k2 long"))
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(1, -(-total // POSTINGS_PER_RANGE))
    classes = ids.where("n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()))

    posts = texts.select("text").mapInArrow(_post(width, ranges), "part int, kind int, data binary").withColumn("ranges", F.lit(ranges))
    counts = posts.repartition(ranges, "part").groupBy("part").applyInArrow(_occurs, "home int, data binary")
    shared = counts.groupBy("home").applyInArrow(_sum, "k1 long, shared long")
    likely = written(classes.join(shared, "k1").where(F.col("shared") * den >= F.col("n") * num).drop("shared"))
    # rows that repeat an id may hold other texts too: sets are told by their signature
    sets = texts.join(likely.select(F.col("rep").alias("id")), "id", "left_semi").select("text").mapInArrow(_sets(width), "k1 long, k2 long, hashes array<long>")
    sets = written(sets.dropDuplicates(["k1", "k2"]).join(likely.select("k1", "k2", "c", "n", "copies"), ["k1", "k2"]).drop("k1", "k2"))

    posts = sets.select("c", "n", F.explode("hashes").alias("h"))
    lengths = written(posts.groupBy("h").agg(F.count(F.lit(1)).alias("length")).where("length > 1"))
    first = posts.join(lengths, "h").groupBy("c").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("length", "h"))).alias("x"))
    # the shingles of length 1 come first in the order, and none of them is shared
    start = F.col("n") - F.ceil(F.col("n") * num / den).cast("long") + 1 - (F.col("n") - F.size("x"))
    first = written(first.where(F.size("x") * den >= F.col("n") * num).select("c", F.explode(F.slice("x", F.lit(1), F.greatest(F.lit(1), start).cast("int"))).alias("x")).select("c", "x.h"))
    leaders = written(first.groupBy("h").agg(F.min("c").alias("leader")))
    near = components(first.join(leaders, "h").where("c <> leader").select("c", "leader"), "c", "leader")
    near = written(near.withColumnRenamed("node", "c").join(likely.select("c", "n"), "c").withColumn("band", _band(F.col("n"), num, den)))
    found = written(sets.join(in_tasks(near), "c").groupBy("whole", "task").applyInArrow(_link(num, den), "c long, root long, links long"))
    drop(near, leaders, first, lengths, likely, sets)

    groups = components(found.where("c <> root"), "c", "root").withColumnRenamed("node", "c")
    least = written(groups.join(classes.select("c", "rep"), "c").groupBy("component").agg(F.min("rep").alias("least")))
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    known = classes.select("k1", "k2", "c", "rep", "copies").join(counts, "c", "left").join(groups, "c", "left").join(least, "component", "left")
    told = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    known = known.select("k1", "k2", F.coalesce("least", "rep").alias("least"), told.alias("links"), F.coalesce("component", "c").alias("part"))
    some = (F.col("n") > 0) & F.col("id").isNotNull()
    out = ids.join(known, ["k1", "k2"], "left")
    return out.select("id", "told", "n", F.when(some, F.col("least")).otherwise(F.col("id")).alias("component_id"), F.when(some, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(some, F.col("part")).alias("part"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row a document: id, n_shingles, component_id (smallest id reachable), n_links (other documents linked)."""
    found = _grouped(docs, id_col, text_col, width, num, den)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest id (of such rows any one of a text); of equal rows without a shingle one stays.

    Rows that repeat an id with texts that don't link both stay.  Rows whose id is null are
    compared with nothing and stay.
    """
    told = "spritelake_told"
    found = _grouped(docs, id_col, text_col, width, num, den).where("id IS NOT NULL")
    alone = F.col("part").isNull()
    first = found.groupBy("part", F.when(alone, F.col("id")), F.when(alone, F.col("told"))).agg(F.min(F.struct("id", "told")).alias("x"))
    first = first.select(F.col("x.id").alias(id_col), F.col("x.told").alias(told))
    names = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.withColumn(told, F.xxhash64(F.col(f"`{text_col}`"))).join(first, [id_col, told], "left_semi").dropDuplicates([id_col, told])
    return kept.select(*names).unionByName(docs.where(F.col(f"`{id_col}`").isNull()).select(*names))
