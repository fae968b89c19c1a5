"""Ranked lexical search over an index in shards, exact, with variable blocks and their highest scores.

*Index.*  A task cuts the documents it scans into shards of about ``SHARD`` bytes of text; a longer text is
a shard of its own.  A shard numbers its documents by length, so that neighbours in a posting list
score alike, and makes one row a term: the documents that hold it, what each adds to a score
(without the term's weight), and the ends and highest addends of its blocks.  Texts are never shuffled.

*Blocks.*  Dynamic programming over each list chooses the block ends that make the sum of
(highest addend - addend) over all postings, plus ``COST`` a block, least, with at most
``LONGEST`` postings a block.  All lists of a shard are solved side by side, a posting a step.

*Search.*  The rows of the terms asked for meet their weights, which come from the whole corpus, by an
equi-join on the term, in blocks of ``QUERIES`` queries.  Then each shard answers
each query alone: the highest addends of the blocks over a document, times their weights, bound
its score.  The documents with the highest bounds are scored first, which gives a threshold; then the
pivot goes on in order to the next documents whose bound reaches it, all blocks in between
are skipped, and the threshold rises.  What is skipped can't be among the best ``top``, and equal
bounds are not skipped, so the result is that of scoring every document.  A shard returns at most
``top`` rows a query, which a window ranks.

Null and empty texts have no terms and are never found.  Each row of documents and of queries counts by
itself, also if ids repeat; equal scores are ordered by id, null ids last.  An empty table on
either side gives no rows.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import drop, written
from .pieces import _ranges

#: Fixed value: terms are the maximal matches of this.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD, DOCUMENTS = 16 << 20, 1 << 16  # bytes of text and documents in a shard
LONGEST, COST = 64, 1_000_000  # postings in a block; what a block costs, in addends of at most 1,000,000
QUERIES = 256  # answered together
TERMS = 200_000  # of the queries: up to this many their table is broadcast
STRIDE = 128  # pivots scored together at first


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def block_ends(scores: np.ndarray, lengths: np.ndarray, longest: int = LONGEST, cost: int = COST) -> np.ndarray:
    """Positions after the last posting of each block, of lists that lie one after another in ``scores``."""
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    start = (np.cumsum(lengths) - lengths)[order]
    best, back = np.zeros(len(scores), np.int64), np.zeros(len(scores), np.int64)  # up to a posting: least cost, length of its block
    top = np.zeros((len(size), 0), np.int64)  # highest of the last 1, 2, .. postings
    active = len(size)
    for j in range(int(size[0]) if len(size) else 0):
        active = int(np.searchsorted(-size[:active], -j))  # those longer than j
        at = start[:active] + j
        s = scores[at][:, None]
        top = np.concatenate([s, np.maximum(top[:active, : longest - 1], s)], axis=1)
        width = top.shape[1]
        total = top * np.arange(1, width + 1) + cost
        before = j - np.arange(width)  # postings before the block
        some = before > 0
        total[:, some] += best[(start[:active, None] + before[None, some]) - 1]
        k = np.argmin(total, axis=1)
        best[at], back[at] = total[np.arange(active), k], k + 1
    is_end = np.zeros(len(scores), bool)
    at, begin = start + size - 1, start
    while len(at):
        is_end[at] = True
        at = at - back[at]
        left = at >= begin
        at, begin = at[left], begin[left]
    return np.flatnonzero(is_end) + 1


INDEX = "shard long, term string, df long, docs binary, adds binary, ends binary, tops binary, ids array<long>"


class _Shard:
    """Documents of a shard as they come, and its rows of the index."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms, self.find = n_docs, n_terms, re.compile(rb"[0-9a-z\x80-\xff]+")
        self.clear()

    def clear(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.ids, self.words, self.held = [], [], []
        self.term, self.tf, self.size = array("i"), array("q"), 0

    def add(self, id_: int | None, text: str) -> None:
        raw = text.encode().lower()  # of bytes: A-Z only
        counts = Counter(m.group() for m in self.find.finditer(raw)) if len(raw) > SHARD else Counter(self.find.findall(raw))
        self.size += len(raw)
        if counts:
            known = self.terms
            self.term.extend([known.setdefault(t, len(known)) for t in counts])
            self.tf.extend(counts.values())
            self.ids.append(id_)
            self.words.append(sum(counts.values()))
            self.held.append(len(counts))

    def rows(self, shard: int, batch: int = 20_000) -> Iterator[pa.RecordBatch]:
        n = len(self.ids)
        if n:
            by_length = np.argsort(np.array(self.words, np.int64), kind="stable")
            number = np.empty(n, np.int64)
            number[by_length] = np.arange(n)
            m = np.array([25 + 75 * w * self.n_docs // self.n_terms for w in self.words], np.int64)
            doc = np.repeat(np.arange(n), self.held)
            term, tf = np.array(self.term, np.int64), np.array(self.tf, np.int64)
            adds = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
            order = np.argsort(term * n + number[doc])
            term, adds, doc = term[order], adds[order], number[doc][order].astype(np.uint16)
            df = np.bincount(term, minlength=len(self.terms))
            ends = block_ends(adds, df)
            tops = np.maximum.reduceat(adds, np.concatenate([[0], ends[:-1]])).astype(np.int32)
            stop = np.cumsum(df)
            first_block = np.searchsorted(ends, stop - df, "right")
            after_block = np.searchsorted(ends, stop, "right")
            of = np.repeat(stop - df, after_block - first_block)
            ends, adds = (ends - of).astype(np.int32), adds.astype(np.int32)
            names = pa.array(list(self.terms), pa.binary()).cast(pa.string())
            lists = {"docs": (doc, np.append(stop - df, stop[-1])), "adds": (adds, np.append(stop - df, stop[-1])), "ends": (ends, np.append(first_block, len(ends))), "tops": (tops, np.append(first_block, len(ends)))}
            held = [pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer((at * data.itemsize).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]) for data, at in lists.values()]
            whole = pa.RecordBatch.from_arrays([pa.array(np.full(len(names), shard)), names, pa.array(df), *held, pa.nulls(len(names), pa.list_(pa.int64()))], [x.split()[0] for x in INDEX.split(", ")])
            yield from (whole.slice(k, batch) for k in range(0, len(names), batch))
            ids = [self.ids[i] for i in by_length.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([""]), pa.array([n], pa.int64()), *([pa.array([b""], pa.binary())] * 4), pa.array([ids], pa.list_(pa.int64()))], [x.split()[0] for x in INDEX.split(", ")])
        self.clear()


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD) -> DataFrame:
    """The index as a written table: a row for each term of each shard, and one of term '' with the shard's ids by number."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    n = F.regexp_count("text", F.lit(TERM))
    n_docs, n_terms = rows.agg(F.count(F.when(n > 0, 1)), F.coalesce(F.sum(n), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = _Shard(n_docs, n_terms), TaskContext.get().partitionId() << 24
        for batch in (b.slice(k, 200) for b in batches for k in range(0, b.num_rows, 200)):
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard.size and (shard.size + len(text) > shard_bytes or len(shard.ids) == DOCUMENTS):
                    yield from shard.rows(number)
                    number += 1
                shard.add(id_, text)
        yield from shard.rows(number)

    return written(rows.mapInArrow(run, INDEX))


class _Lists:
    """The posting lists of a shard that queries read: postings one after another, and the blocks of each list."""

    def __init__(self, rows: list[tuple[bytes, bytes, bytes, bytes]]):
        self.docs, self.adds = np.frombuffer(b"".join(r[0] for r in rows), np.uint16), np.frombuffer(b"".join(r[1] for r in rows), np.int32)
        self.blocks, at = [], 0
        for docs, _, ends, tops in rows:
            n, end = len(docs) // 2, np.frombuffer(ends, np.int32).astype(np.int64)
            begin = np.concatenate([[0], end[:-1]])
            here = self.docs[at : at + n]
            self.blocks.append(np.array([here[begin], here[end - 1], begin + at, end - begin, np.frombuffer(tops, np.int32)], np.int64))
            at += n

    def best(self, wanted: list[tuple[int, int]], n: int, place: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``top`` highest scores above 0 of a shard of ``n`` documents, equal ones by
        ``place``; a query is its lists and their weights."""
        blocks = np.concatenate([self.blocks[k] for k, _ in wanted], axis=1)
        weight = np.repeat([w for _, w in wanted], [self.blocks[k].shape[1] for k, _ in wanted])
        first, last, begin, size, tops = blocks
        value = (tops * weight).astype(np.float64)  # whole numbers below 2**53
        bound = np.cumsum((np.bincount(first, value, n + 1) - np.bincount(last + 1, value, n + 1))[:n]).astype(np.int64)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def take(some: np.ndarray) -> int:
            """Scores documents from the blocks that they may be in; the score that others must reach."""
            nonlocal docs, scores
            so_far = np.zeros(n + 1, np.int64)
            so_far[some + 1] = 1
            so_far = np.cumsum(so_far)
            read = np.flatnonzero(so_far[last + 1] > so_far[first])
            at = _ranges(begin[read], size[read])
            found = np.bincount(self.docs[at], self.adds[at] * np.repeat(weight[read], size[read]).astype(np.float64), n)[some].astype(np.int64)
            docs, scores = np.concatenate([docs, some[found > 0]]), np.concatenate([scores, found[found > 0]])
            order = np.lexsort((place[docs], -scores))[:top]
            docs, scores = docs[order], scores[order]
            return int(scores[-1]) if len(scores) == top else 1

        highest = np.sort(np.argpartition(-bound, 4 * top)[: 4 * top]) if n > 4 * top else np.arange(n)
        least = take(highest[bound[highest] > 0])
        bound[highest] = 0
        pivots, stride = np.flatnonzero(bound >= least), STRIDE
        while len(pivots):
            least = take(pivots[:stride])
            pivots = pivots[stride:]
            pivots, stride = pivots[bound[pivots] >= least], stride * 2
        return docs, scores


def search(table: DataFrame, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", doc_col: str = "doc_id", top: int = 10) -> DataFrame:
    """id, rank, doc, score of the ``top`` best documents of an ``index`` for each query."""
    queries = written(queries.select(F.monotonically_increasing_id().alias("q"), F.col(f"`{id_col}`").alias("item"), F.regexp_extract_all(lowered(F.col(f"`{text_col}`")), F.lit(TERM), F.lit(0)).alias("terms")))
    blocks = max(1, -(-queries.count() // QUERIES))
    asked = written(queries.select(F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), "q", F.explode("terms").alias("term")).groupBy("block", "q", "term").agg(F.count(F.lit(1)).alias("times")))
    names = asked.select("term").distinct()
    hits = written(table.where("term <> ''").join(F.broadcast(names) if names.count() <= TERMS else names, "term", "left_semi").drop("ids"))
    n = table.where("term = ''").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    held = hits.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    asking = asked.join(held, "term").groupBy("block", "term").agg(F.collect_list(F.struct("q", (F.col("times") * weight).alias("weight"))).alias("asking"))
    lists = hits.drop("df").join(asking, "term").select("shard", "block", "docs", "adds", "ends", "tops", "asking", F.lit(None).cast("array<long>").alias("ids"))
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in lists.dtypes if c not in ("shard", "block", "ids")]
    every = table.where("term = ''").select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), *nothing, "ids")

    def run(rows: pa.Table) -> pa.Table:
        ids, kept, by_query = [], [], {}
        for docs, adds, ends, tops, asking, held in zip(*(rows[c].to_pylist() for c in ("docs", "adds", "ends", "tops", "asking", "ids")), strict=True):
            if held is not None:
                ids = held
                continue
            for a in asking:
                by_query.setdefault(a["q"], []).append((len(kept), a["weight"]))
            kept.append((docs, adds, ends, tops))
        lists = _Lists(kept)
        place = np.empty(len(ids), np.int64)
        place[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, i))] = np.arange(len(ids))
        out: list[tuple[int, int | None, int]] = []
        for q, wanted in by_query.items():
            docs, scores = lists.best(wanted, len(ids), place, top)
            out += [(q, ids[d], s) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
        return pa.table({c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate(("q", "doc", "score"))})

    found = lists.unionByName(every.select(lists.columns)).groupBy("shard", "block").applyInArrow(run, "q long, doc long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())).alias("rank")
    ranked = found.select("*", rank).where(F.col("rank") <= top)
    return ranked.join(queries.select("q", "item"), "q").select(F.col("item").alias(id_col), "rank", F.col("doc").alias(doc_col), "score")


def ranked(docs: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` best ``documents`` for each ``benchmark`` item."""
    table = index(docs)
    out = written(search(table, queries, top=top))
    drop(table)
    return out
