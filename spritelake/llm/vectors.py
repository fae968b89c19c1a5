"""Near-duplicate vectors by product quantisation, exact: coarse inverted lists, residual codes,
asymmetric distances, cosine rerank.

Vectors compare only within a label.  Equal vectors form a class first; its copies count as
links but are never paired.  On unit vectors ``cos >= t`` is a distance of at most
``r = sqrt(2 - 2t)``, and this bounds both searches, so that none drops a pair:

* Probes.  A vector x of list c asks list c' whenever ``(|x-c'|^2 - |x-c|^2) / (2 |c-c'|) <= r``:
  farther from the plane between the two centres no partner of x can lie in c'.
* Shortlist.  With the asymmetric distance a(x, y) from x to the decoded y, and the error e(y)
  stored beside the code, only ``a(x, y) <= r + e(y)`` can be partners.

What is left is reranked by its cosine in double precision.  Centres and codebooks are fitted
on at most ``SAMPLE`` classes (those with the smallest hash); all rows are indexed, and a bad
fit costs time, never pairs.  A list is searched in blocks of ``BLOCK`` rows against blocks of
asking rows, so a group of any size is spread over tasks.

Vectors that are null, empty, zero or hold a null or non-finite component, and those without
a label, link with nothing; so do vectors of different lengths with each other.  A row with a
null id takes no part and has a null component.  Rows that repeat an id are rows of their own
that share the links of their vectors.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop, written
from .components import components

SAMPLE = 20_000
LIST_ROWS = 256
MAX_LISTS = 32_768
BLOCK = 1024
SUBSPACES, WORDS = 8, 256


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, turns: int = 6) -> np.ndarray:
    """Lloyd's iterations from evenly spaced rows; an empty cell keeps its centre."""
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(turns):
        near = nearest(x, centre)
        order = np.argsort(near, kind="stable")
        at, first = np.unique(near[order], return_index=True)
        centre[at] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
    return centre


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T)


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(x[i : i + 4096], centre).argmin(1) for i in range(0, len(x), 4096)])


class Index:
    """Centres by (label, length) and codebooks by length; (label, length) without centres is one list around 0."""

    def __init__(self, sample: dict[tuple[int, int], np.ndarray], counts: dict[tuple[int, int], int]):
        self.centres, self.books = {}, {}
        spare = MAX_LISTS
        residuals: dict[int, list[np.ndarray]] = {}
        for key, x in sample.items():
            k = min(-(-counts.get(key, 0) // LIST_ROWS), max(1, len(x) // 4), max(1, spare))
            if k > 1:
                spare -= k
                self.centres[key] = k_means(x, k)
            residuals.setdefault(key[1], []).append(x - self.centre(key)[nearest(x, self.centre(key))])
        for size, parts in residuals.items():
            x = np.concatenate(parts)
            self.books[size] = [k_means(x[:, s], min(WORDS, len(x))) for s in self.subspaces(size)]

    def centre(self, key: tuple[int, int]) -> np.ndarray:
        return self.centres.get(key, np.zeros((1, key[1])))

    @staticmethod
    def subspaces(size: int) -> list[slice]:
        cuts = np.linspace(0, size, min(SUBSPACES, size) + 1).astype(int)
        return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def book(self, size: int) -> list[np.ndarray]:
        return self.books.get(size) or [np.zeros((1, s.stop - s.start)) for s in self.subspaces(size)]

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance from each residual to its decoded form."""
        size = residual.shape[1]
        book = self.book(size)
        codes = np.stack([nearest(residual[:, s], b) for s, b in zip(self.subspaces(size), book, strict=True)], 1)
        decoded = np.concatenate([b[codes[:, i]] for i, b in enumerate(book)], 1)
        return codes.astype(np.uint8), np.sqrt(((residual - decoded) ** 2).sum(1))

    def probes(self, x: np.ndarray, key: tuple[int, int], radius: float) -> tuple[np.ndarray, np.ndarray]:
        """The home list of each vector, and a matrix of the lists it has to ask."""
        c = self.centre(key)
        d = squares(x, c)
        home = d.argmin(1)
        apart = np.sqrt(squares(c, c))[home]
        margin = d - d[np.arange(len(x)), home][:, None]
        return home, margin <= 2 * apart * (radius + 1e-6) + 1e-9


def _place(index: Index, radius: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vectors = batch.column(2)
            sizes = vectors.value_lengths().to_numpy()
            flat = vectors.flatten().to_numpy().astype(float)
            at = np.cumsum(sizes) - sizes
            for label, size in {*zip(labels.tolist(), sizes.tolist(), strict=True)}:
                rows = np.flatnonzero((labels == label) & (sizes == size))
                x = unit(flat[at[rows][:, None] + np.arange(size)])
                home, asks = index.probes(x, (label, size), radius)
                who, to = np.nonzero(asks)
                codes, error = index.encode(x - index.centre((label, size))[home])
                rows_out, lists, role = np.concatenate([rows, rows[who]]), np.concatenate([home, to]), np.repeat([0, 1], [len(rows), len(who)])
                packed = [c.tobytes() for c in codes] + [b""] * len(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reps[rows_out]), pa.array(np.full(len(lists), label)), pa.array(np.full(len(lists), size, np.int32)), pa.array(lists.astype(np.int32)), pa.array(role.astype(np.int32)), pa.array(packed, pa.binary()), pa.array(np.concatenate([error, np.zeros(len(who))])), batch.column(3).take(pa.array(rows_out)), vectors.take(pa.array(rows_out))],
                    ["rep", "label", "size", "list", "role", "code", "error", "copies", "vector"],
                )

    return run


def shortlist(asking: np.ndarray, centre: np.ndarray, codes: np.ndarray, error: np.ndarray, book: list[np.ndarray], spaces: list[slice], radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asking, coded) within the radius by asymmetric distance from look-up tables."""
    total = np.zeros((len(asking), len(codes)))
    residual = asking - centre
    for i, (s, words) in enumerate(zip(spaces, book, strict=True)):
        total += squares(residual[:, s], words)[:, codes[:, i]]
    return np.nonzero(total <= (radius + error + 1e-6) ** 2)


def _search(index: Index, threshold: float, radius: float):
    def run(table: pa.Table) -> pa.Table:
        label, size, at = (table[c][0].as_py() for c in ("label", "size", "list"))
        role, reps, copies = (table[c].to_numpy() for c in ("role", "rep", "copies"))
        x = unit(table["vector"].combine_chunks().flatten().to_numpy().astype(float).reshape(len(reps), size))
        home, asks = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        nodes, where = np.unique(reps, return_inverse=True)
        links, root = np.zeros(len(nodes), np.int64), list(range(len(nodes)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        if len(home) and len(asks):
            book, spaces = index.book(size), index.subspaces(size)
            codes = np.frombuffer(b"".join(table["code"].filter(pa.array(role == 0)).to_pylist()), np.uint8).reshape(len(home), -1)
            error = table["error"].to_numpy()[home]
            for i in range(0, len(asks), 256):
                some = asks[i : i + 256]
                a, b = shortlist(x[some], index.centre((label, size))[at], codes, error, book, spaces, radius)
                a, b = some[a], home[b]
                near = (where[a] != where[b]) & (np.einsum("ij,ij->i", x[a], x[b]) >= threshold)
                a, b = a[near], b[near]
                np.add.at(links, where[a], copies[b])
                for p, q in zip(where[a].tolist(), where[b].tolist(), strict=True):
                    p, q = find(p), find(q)
                    if p != q:
                        root[max(p, q)] = min(p, q)
        top = np.array([find(i) for i in range(len(nodes))], np.int64)
        some = np.flatnonzero((links > 0) | (top != np.arange(len(nodes))))
        return pa.table({"rep": nodes[some], "root": nodes[top[some]], "links": links[some]})

    return run


def cosine_components(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: id, n_links, component_id (smallest id reachable), kept (it is that one)."""
    v = F.col("vector")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
    rows = rows.select("*", (fine & F.col("id").isNotNull() & F.col("label").isNotNull()).alias("fine"), F.xxhash64("label", "vector").alias("k1"), F.hash("vector", "label").alias("k2"))
    classes = written(rows.where("fine").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("label").alias("label"), F.count(F.lit(1)).alias("copies"), F.min_by("vector", "id").alias("vector")))

    sample: dict[tuple[int, int], list] = {}
    for label, x in classes.orderBy(F.xxhash64("rep")).select("label", "vector").limit(SAMPLE).collect():  # at most SAMPLE rows
        sample.setdefault((label, len(x)), []).append(x)
    large = classes.groupBy("label", F.size("vector").alias("size")).count().where(F.col("count") > LIST_ROWS).orderBy(F.desc("count")).limit(MAX_LISTS)
    counts = {(r["label"], r["size"]): r["count"] for r in large.collect()}  # at most MAX_LISTS rows
    index = Index({k: unit(np.array(x, float)) for k, x in sorted(sample.items())}, counts)
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    kind = dict(classes.dtypes)["vector"]
    placed = written(classes.select("rep", "label", "vector", "copies").mapInArrow(_place(index, radius), f"rep long, label long, size int, list int, role int, code binary, error double, copies long, vector {kind}"))
    key = ["label", "size", "list"]
    blocks = placed.groupBy(*key).agg(*(F.ceil(F.count_if(F.col("role") == r) / BLOCK).cast("int").alias(n) for r, n in ((0, "homes"), (1, "asks"))))
    both = placed.join(blocks, key)
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("role") == 0, F.col("homes")).otherwise(F.col("asks"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.when(F.col("role") == 0, F.col("asks")).otherwise(F.col("homes"))) - 1))
    both = both.where("homes > 0 AND asks > 0").withColumn("own", own).withColumn("other", others)
    home, ask = (F.when(F.col("role") == r, F.col("own")).otherwise(F.col("other")) for r in (0, 1))
    found = written(both.withColumn("home", home).withColumn("ask", ask).drop("homes", "asks", "own", "other").groupBy(*key, "home", "ask").applyInArrow(_search(index, threshold, radius), "rep long, root long, links long"))
    groups = components(found.where("rep <> root"), "rep", "root")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = written(classes.select("k1", "k2", "rep", "copies").join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left"))
    drop(placed, classes, found)
    out = rows.select("id", "fine", "k1", "k2").join(known, ["k1", "k2"], "left")
    n_links = F.when(F.col("fine"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long")
    component = F.when(F.col("fine"), F.coalesce("component", "rep")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
