"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays
in the shared folder, memory-mapped by the workers that score.

Tokens are the lower-cased (A-Z) words of a text and one end mark; the first token's context
is a start mark.  For a context v with total c(v) and a token w

    p(w | v) = (c(vw) - D(c(vw))) / c(v) + g(v) * q(w)
    q(w)     = (n(w) - E(n(w))) / n + h / (V + 1)

where n(w) counts the contexts of w, n is their sum, V the tokens known, D and E the three
modified discounts of bigram counts and of context counts, and g(v), h what they leave over.
So the probabilities of all V tokens and of one unknown token sum to 1 in every context.

Counting ships packed pairs.  A task merges about ``FLUSH`` tokens before it ships them, so a
frequent pair is one entry a flush.  Pairs go to parts by their context, those of the
``HEAVY`` contexts that lead in a sample by the pair itself, so no context fills a part; the
sample decides about routing only.  A part adds its pairs up, writes its sorted array, and
sends each word's share to the word's part, which adds those up and writes the word arrays.
Files are written under a temporary name and renamed, so a task may run again.

Order 2 is what 4 times the input's disk allows (see the README): arrays hold every pair,
none is pruned.

Null and empty texts are one end mark.  A null id trains (the remainder of an empty id) and
is scored like any other; repeated ids are rows of their own.  With nothing to train on every
token has the uniform probability 1 / (V + 1) = 1.  Other columns are not read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import delete, local_path, shared_dir
from ._tokens import U, Tokeniser, mix

FLUSH = 2_000_000
PART_BYTES = 15 << 20  # of text a part
HEAVY, HEAVY_SAMPLE = 1024, 2_000  # contexts, documents
CLEAR = U(0xFFFFFFFFFFFFFF00)  # words are told apart by 56 bits
START, END = U(0x5747A7B1C0FFEE00), U(0x0E4DE4D0E4D0E400)


def _tokens(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, token) of every token, each text's end mark included."""
    at = np.cumsum(counts)
    token = np.insert(h & CLEAR, at, END)
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[at - counts + np.arange(len(counts))] = START
    return context, token


def _pair(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(context * U(0x9DDFEA08EB382D69) + token)


def _range(x: np.ndarray, parts: int) -> np.ndarray:
    return ((x >> U(32)) * U(parts) >> U(32)).astype(np.int32)


def _part(context: np.ndarray, pair: np.ndarray, heavy: np.ndarray, parts: int) -> np.ndarray:
    spread = np.isin(context, heavy) if len(heavy) else np.zeros(len(context), bool)
    return _range(np.where(spread, pair, context), parts)


def _merged(pair: np.ndarray, *columns: np.ndarray, add: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, ...]:
    """Distinct pairs in order, the columns at their first occurrence, and sums."""
    order = np.argsort(pair, kind="stable")
    s = pair[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(a[order], first) if len(first) else a for a in add]
    return s[first], *(c[order[first]] for c in columns), *sums


PACKED = pa.schema([("part", pa.int32()), ("data", pa.binary())])


def _pack(context: np.ndarray, token: np.ndarray, count: np.ndarray) -> bytes:
    """In order of contexts: these as runs, 7 bytes a token, counts."""
    order = np.argsort(context, kind="stable")
    context, token, count = context[order], token[order], count[order]
    cut = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    runs = np.diff(np.append(cut, len(context))).astype(np.uint32)
    head = np.array([len(context), len(cut)], np.uint32)
    return b"".join((head.tobytes(), context[cut].tobytes(), runs.tobytes(), count.astype(np.uint32).tobytes(), token.view(np.uint8).reshape(-1, 8)[:, 1:].tobytes()))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, cuts = np.frombuffer(data, np.uint32, 2).tolist()
    context = np.repeat(np.frombuffer(data, U, cuts, 8), np.frombuffer(data, np.uint32, cuts, 8 + 8 * cuts))
    count = np.frombuffer(data, np.uint32, n, 8 + 12 * cuts).astype(np.int64)
    token = np.zeros((n, 8), np.uint8)
    token[:, 1:] = np.frombuffer(data, np.uint8, 7 * n, 8 + 12 * cuts + 4 * n).reshape(n, 7)
    return context, token.view(U).ravel(), count


def _count(heavy: np.ndarray, parts: int):
    def flush(held: list) -> pa.RecordBatch:
        context, token = (np.concatenate(x) for x in zip(*held, strict=True))
        pair = _pair(context, token)
        pair, context, token, count = _merged(pair, context, token, add=(np.ones(len(pair), np.int64),))
        part = _part(context, pair, heavy, parts)
        order = np.argsort(part, kind="stable")
        at = np.append(np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0])), len(part))
        cuts = [order[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([int(part[c[0]]) for c in cuts], pa.int32()), pa.array([_pack(context[c], token[c], count[c]) for c in cuts], pa.binary())], schema=PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Tokeniser(), [], 0
        for batch in batches:
            for _, _, h, counts in words.chunks(batch.column(0)):
                held.append(_tokens(h, counts))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _save(path: str, array: np.ndarray) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        np.save(f, array)
    os.replace(own, path)


def _add_pairs(folder: str):
    """Writes a part's pairs; sends words their counts and contexts, contexts their totals."""

    def run(table: pa.Table) -> pa.Table:
        part, parts = table["part"][0].as_py(), table["parts"][0].as_py()
        context, token, count = (np.concatenate(x) for x in zip(*(_unpack(d.as_buffer()) for d in table["data"]), strict=True))
        pair, context, token, count = _merged(_pair(context, token), context, token, add=(count,))
        _save(f"{folder}/pair-{part}.npy", pair)
        _save(f"{folder}/count-{part}.npy", np.minimum(count, 255).astype(np.uint8))
        many = count >= 255
        _save(f"{folder}/many-{part}.npy", np.stack([pair[many], count[many].astype(U)]))
        one = np.ones(len(count), np.int64)
        w, uses, contexts = _merged(token, add=(count, one))
        v, total, n1, n2, n3 = _merged(context, add=(count, (count == 1) * one, (count == 2) * one, (count > 2) * one))
        out = []
        for word, columns in ((w, (uses, contexts)), (v, (total, n1, n2, n3))):
            home = _range(word, parts)  # words ascend, so homes do
            at = np.append(np.flatnonzero(np.concatenate([[True], np.diff(home) != 0])), len(home))
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                out.append((int(home[a]), len(columns), b"".join([word[a:b].tobytes(), *(c[a:b].astype(np.uint32 if c[a:b].max() < 1 << 32 else U).tobytes() for c in columns)]), [c[a:b].max() < 1 << 32 for c in columns], b - a))
        sums = [int((count == k).sum()) for k in (1, 2, 3, 4)]
        return pa.table({
            "home": pa.array([x[0] for x in out] + [0], pa.int32()), "kind": pa.array([x[1] for x in out] + [0], pa.int32()), "rows": pa.array([x[4] for x in out] + [0], pa.int64()),
            "narrow": pa.array([[bool(y) for y in x[3]] for x in out] + [[]], pa.list_(pa.bool_())), "data": pa.array([x[2] for x in out] + [np.array(sums, np.int64).tobytes()], pa.binary()),
        })

    return run


def _add_words(folder: str):
    """Writes the word arrays of one range of hashes; returns sums for the discounts."""

    def run(table: pa.Table) -> pa.Table:
        home, pairs = table["home"][0].as_py(), np.zeros(4, np.int64)
        parts = {2: [], 4: []}
        for kind, rows, narrow, data in zip(table["kind"].to_pylist(), table["rows"].to_pylist(), table["narrow"].to_pylist(), table["data"], strict=True):
            data = data.as_buffer()
            if not kind:
                pairs += np.frombuffer(data, np.int64)
                continue
            at, columns = 8 * rows, [np.frombuffer(data, U, rows)]
            for small in narrow:
                columns.append(np.frombuffer(data, np.uint32 if small else U, rows, at).astype(np.int64))
                at += rows * (4 if small else 8)
            none = [np.zeros(rows, np.int64)]
            parts[kind].append((columns[0], *(columns[1:] + none * 4 if kind == 2 else none * 2 + columns[1:])))
        everything = parts[2] + parts[4]
        if everything:
            columns = [np.concatenate(x) for x in zip(*everything, strict=True)]
            word, *sums = _merged(columns[0], add=tuple(columns[1:]))
            table_ = np.stack(sums, 1)
            _save(f"{folder}/word-{home}.npy", word)
            _save(f"{folder}/sums-{home}.npy", table_.astype(np.uint32 if table_.max() < 1 << 32 else U))
            uses, contexts = sums[:2]
            told = [int((uses > 0).sum()), int(uses.sum()), int(contexts.sum()), *(int((contexts == k).sum()) for k in (1, 2, 3, 4)), int((contexts > 2).sum())]
        else:
            told = [0] * 8
        return pa.table({"told": pa.array([[*told, *pairs.tolist()]], pa.list_(pa.int64()))})

    return run


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Chen and Goodman's three discounts, kept above zero so that every token stays possible."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    d = [k - (k + 1) * y * b / a if a else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))])


class Model:
    """Where the arrays lie and what holds for all of them; opens them on first use in a worker."""

    def __init__(self, folder: str, parts: int, heavy: np.ndarray, told: list[int]):
        self.folder, self.parts, self.heavy = folder, parts, heavy
        self.known, self.tokens, self.contexts, m1, m2, m3, m4, more, *pairs = told
        self.d, self.e = discounts(*pairs), discounts(m1, m2, m3, m4)
        self.rest = (self.e[1] * m1 + self.e[2] * m2 + self.e[3] * more) / self.contexts if self.contexts else 1.0
        self.open = {}

    def array(self, name: str) -> np.ndarray:
        if name not in self.open:
            path = f"{self.folder}/{name}.npy"
            self.open[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.open[name]

    def _find(self, kind: str, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ascending ``x`` in a sorted array, and which of them are there."""
        keys = self.array(f"{kind}-{part}")
        if keys is None or not len(keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return at, keys[at] == x

    def words(self, x: np.ndarray) -> np.ndarray:
        """Uses, contexts, total, n1, n2, n3 of ascending distinct words."""
        out, part = np.zeros((len(x), 6), np.int64), _range(x, self.parts)
        for p in np.unique(part).tolist():
            mine = np.flatnonzero(part == p)
            at, there = self._find("word", p, x[mine])
            if there.any():
                out[mine[there]] = self.array(f"sums-{p}")[at[there]]
        return out

    def pairs(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Counts of pairs."""
        pair, first, back = np.unique(_pair(context, token), return_index=True, return_inverse=True)
        out, part = np.zeros(len(pair), np.int64), _part(context[first], pair, self.heavy, self.parts)
        for p in np.unique(part).tolist():
            mine = np.flatnonzero(part == p)
            at, there = self._find("pair", p, pair[mine])
            if not there.any():
                continue
            count = self.array(f"count-{p}")[at[there]].astype(np.int64)
            if (count == 255).any():
                keys, full = self.array(f"many-{p}")
                count[count == 255] = full[np.searchsorted(keys, pair[mine[there]][count == 255])]
            out[mine[there]] = count
        return out[back]

    def score(self, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base and model log10 probabilities of each text."""
        context, token = _tokens(h, counts)
        text = np.repeat(np.arange(len(counts)), counts + 1)
        words, back = np.unique(np.concatenate([token, context]), return_inverse=True)
        facts = self.words(words)
        uses, contexts = facts[:, 0], facts[:, 1]
        q = np.maximum(contexts - self.e[np.minimum(contexts, 3)], 0) / max(1, self.contexts) + self.rest / (self.known + 1)
        total = np.maximum(facts[:, 2], 1)
        rest = np.where(facts[:, 2] > 0, (facts[:, 3:] * self.d[1:]).sum(1) / total, 1.0)
        w, v = back[: len(token)], back[len(token) :]
        count = self.pairs(context, token)
        p = (count - self.d[np.minimum(count, 3)]) / total[v] + rest[v] * q[w]
        base = np.log10((uses + 1) / (self.tokens + self.known + 1))
        n = len(counts)
        return counts + 1, np.bincount(text, uses[w] > 0, n).astype(np.int64), np.bincount(text, base[w], n), np.bincount(text, np.log10(p), n)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Tokeniser()
    for batch in batches:
        for _, _, h, counts in words.chunks(batch.column(0)):
            u, c = np.unique(_tokens(h, counts)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["word", "uses"])


def train(texts: DataFrame, text_col: str = "text") -> Model:
    """Counts a model over all texts; its arrays stay in the shared folder."""
    spark = texts.sparkSession
    only = texts.select(F.col(f"`{text_col}`").alias("text"))
    size, rows = only.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(1, -(-size // PART_BYTES))
    some = only.where(F.rand(7) < HEAVY_SAMPLE / max(1, rows))
    lead = some.mapInArrow(_sampled, "word long, uses long").groupBy("word").agg(F.sum("uses").alias("uses")).orderBy(F.desc("uses"), "word").limit(HEAVY)
    heavy = np.array([r["word"] for r in lead.collect()], np.int64).view(U)
    folder = shared_dir(spark)
    at = local_path(folder)
    pairs = only.mapInArrow(_count(heavy, parts), "part int, data binary").withColumn("parts", F.lit(parts)).repartition(parts, "part")
    words = pairs.groupBy("part").applyInArrow(_add_pairs(at), "home int, kind int, rows long, narrow array<boolean>, data binary").repartition(parts, "home")
    told = words.groupBy("home").applyInArrow(_add_words(at), "told array<bigint>").select(*(F.col("told")[i].alias(f"t{i}") for i in range(12)))
    sums = told.agg(*(F.coalesce(F.sum(f"t{i}"), F.lit(0)) for i in range(12))).first()
    return Model(at, parts, heavy, list(sums))


def forget(model: Model, spark) -> None:
    delete(spark, model.folder)


def held_out(id_col: str, buckets: int = 7, bucket: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % buckets == bucket


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score; perplexity = 10 ** (-score / n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Tokeniser(chunk=4 << 20)
        for batch in batches:
            for lo, hi, h, counts in words.chunks(batch.column(2)):
                n, known, base, own = model.score(h, counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), pa.array(known), pa.array(np.full(hi - lo, model.tokens, np.int64)), pa.array(base), pa.array(own)], NAMES)

    NAMES = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on the documents that aren't held out and scores all."""
    return score(docs, train(docs.where(~held_out(id_col)), text_col), id_col, text_col)
