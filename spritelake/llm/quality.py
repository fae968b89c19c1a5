"""Quality classifier: importance resampling with hashed n-gram models and Gumbel top-k.

Two bag-of-n-grams models over ``BUCKETS`` hash buckets are counted: the *target* model from
labelled good texts, the *raw* model from every text.  A text's log weight is the sum of
``log p_target - log p_raw`` over its n-grams.  Texts are then drawn without replacement by
Gumbel top-k: the k largest of ``margin + g``, g being standard Gumbel noise from a keyed
hash of the id, are kept.

Tokens are word runs and punctuation runs; the n-grams are single tokens, pairs, and for a
token equal to the one before it a mark of its own, so that runs of one word look alike
whatever the word is.

``margin = log weight - cut * n-grams + PRIOR``.  ``cut`` (nats an n-gram) lies where the
two classes of the labelled sample part best; k is the number of texts with a positive
margin, so the sample is as large as the part of the corpus that the models call good, and
the noise decides between borderline texts only.  A caller's ``k`` sets another size; a caller's
``cut`` and ``prior`` of 0 make the draw one on the log weights alone.

The labelled sample is bounded: the ``SAMPLE`` labelled ids with the smallest hash; both the
target model and the cut are fitted on it.  Everything else covers all rows.

Null and empty texts have no n-grams and weight 0: nothing speaks against them and they
keep the prior.  Repeated ids draw the same noise; ties at the k-th key are all kept.
Labels that are null or conflict for one id count as bad.  Where no label is good, or none
is bad, there is nothing to part and every text is kept.  Other columns pass unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import drop, written
from ._tokens import U, Tokeniser, grams, mix

BUCKETS = 10_000
SAMPLE = 20_000
PRIOR = 3.0  # nats in favour of a text; noise below -3 has a chance of 2e-9
SEED = 20_240_229


def _features(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a chunk, and the text that each belongs to."""
    text = np.repeat(np.arange(len(counts)), counts)
    pairs, inside = grams(h, counts, 2)
    same = inside & (h[1:] == h[:-1]) if len(h) > 1 else inside
    bucket = np.concatenate([h % U(BUCKETS - 1), pairs[inside] % U(BUCKETS - 1), np.full(int(same.sum()), BUCKETS - 1, U)]).astype(np.int64)
    return bucket, np.concatenate([text, text[: len(inside)][inside], text[: len(same)][same]])


def _noise(ids: pa.Array) -> np.ndarray:
    """Standard Gumbel noise of each id; null draws as 0."""
    x = mix(mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U) + U(SEED)))
    return -np.log(-np.log(((x >> U(11)).astype(float) + 0.5) / (1 << 53)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, raw, good) of one task; the second column tells the good texts."""
    words, raw, good = Tokeniser(punctuation=True), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        told = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, h, counts in words.chunks(batch.column(0)):
            bucket, text = _features(h, counts)
            raw += np.bincount(bucket, minlength=BUCKETS)
            if told[lo:hi].any():
                good += np.bincount(bucket[told[lo:hi][text]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], ["bucket", "raw", "good"])


def _weights(texts: pa.Array, words: Tokeniser, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weight, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for lo, hi, h, counts in words.chunks(texts):
        bucket, text = _features(h, counts)
        weight[lo:hi] = np.bincount(text, ratio[bucket], hi - lo)
        size[lo:hi] = np.bincount(text, minlength=hi - lo)
    return weight, size


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as 64-bit integers in the same order."""
    bits = x.view(np.int64)
    return np.where(bits < 0, np.int64(-(1 << 63)) - bits, bits)


class Model:
    """Log ratios of the two models and the cut; scores batches of (id, text)."""

    def __init__(self, ratio: np.ndarray, cut: float, prior: float = PRIOR):
        self.ratio, self.cut, self.prior = ratio, cut, prior

    def keys(self, ids: pa.Array, texts: pa.Array, words: Tokeniser) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        weight, size = _weights(texts, words, self.ratio)
        margin = weight - self.cut * size + self.prior
        return weight, size, margin, margin + _noise(ids)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> Model | None:
    """Counts both models over all texts and places the cut; None where labels don't part."""
    sample = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("good"))
    sample = written(sample.orderBy(F.xxhash64("id"), "id").limit(SAMPLE))  # at most SAMPLE rows, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id", "left")
    counts = texts.select("text", F.coalesce(F.col("good") == 1, F.lit(False)).alias("told")).mapInArrow(_count, "bucket long, raw long, good long")
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    for bucket, r, g in counts.groupBy("bucket").agg(F.sum("raw"), F.sum("good")).collect():  # at most BUCKETS rows
        raw[bucket] += r
        good[bucket] += g
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Tokeniser(punctuation=True)
        for batch in batches:
            weight, size = _weights(batch.column(0), words, ratio)
            yield pa.RecordBatch.from_arrays([pa.array(weight / np.maximum(size, 1)), batch.column(1), batch.column(2)], ["mean", "good", "id"])

    scores = texts.where("good IS NOT NULL").select("text", "good", "id").mapInArrow(score, "mean double, good int, id " + dict(texts.dtypes)["id"])
    told = scores.groupBy("id").agg(F.avg("mean").alias("mean"), F.first("good").alias("good")).select("mean", "good").toPandas()  # at most SAMPLE rows
    drop(sample)
    fine, bad = np.sort(told["mean"][told["good"] == 1].to_numpy()), np.sort(told["mean"][told["good"] != 1].to_numpy())
    if not len(fine) or not len(bad):
        return None
    return Model(ratio, part(fine, bad))


def part(fine: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the least sum of error rates; amid the widest gap where several are as good."""
    at = np.unique(np.concatenate([fine, bad]))
    cuts = np.concatenate([[at[0] - 1e-9], (at[1:] + at[:-1]) / 2])
    wrong = np.searchsorted(fine, cuts) / len(fine) + 1 - np.searchsorted(bad, cuts) / len(bad)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    gaps = np.concatenate([[0], np.diff(at)])
    return float(cuts[best[np.argmax(gaps[best])]])


def kth_largest(keys: DataFrame, col: str, k: int) -> int:
    """The k-th largest of a column of longs: 16 bits a pass, each a count by bucket."""
    part, found = keys.select(F.col(col).bitwiseXOR(F.lit(-(1 << 63))).alias("x")), 0  # in order as unsigned
    for shift in (48, 32, 16, 0):
        bucket = F.shiftrightunsigned("x", shift).bitwiseAND(F.lit(0xFFFF))
        for at, n in sorted(part.groupBy(bucket.alias("at")).count().collect(), reverse=True):  # at most 65536 rows
            if k <= n:
                part, found = part.where(bucket == at), found << 16 | at
                break
            k -= n
    return found - (1 << 63)


def scored(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id, n_grams, log_weight, margin, key): one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Tokeniser(punctuation=True)
        for batch in batches:
            weight, size, margin, key = model.keys(batch.column(0), batch.column(1), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(weight), pa.array(margin), pa.array(_ordered(key))], ["id", "n_grams", "log_weight", "margin", "key"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, n_grams long, log_weight double, margin double, key long")


def _settled(model: Model | None, cut: float | None, prior: float) -> Model:
    if model is None:
        return Model(np.zeros(BUCKETS), 0.0)
    return Model(model.ratio, model.cut if cut is None else cut, prior)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, cut: float | None = None, prior: float = PRIOR) -> DataFrame:
    """id, n_grams, log_weight, margin, kept for every document; ``k`` of them are kept, or as many as have a positive margin."""
    model = _settled(fit(docs, labels, id_col, text_col), cut, prior)
    table = written(scored(docs, model, id_col, text_col))
    k = table.where("margin > 0").count() if k is None else min(k, table.count())
    least = kth_largest(table, "key", k) if k else None
    kept: Column = F.col("key") >= F.lit(least) if k else F.lit(False)
    return table.select(F.col("id").alias(id_col), "n_grams", "log_weight", "margin", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents drawn, with all their columns; scored again while they stream by, so no join moves texts."""
    model = fit(docs, labels, id_col, text_col)
    if model is None:
        return docs
    keys = written(scored(docs, model, id_col, text_col).select("margin", "key"))
    k = keys.where("margin > 0").count()
    least = kth_largest(keys, "key", k) if k else (1 << 63) - 1
    drop(keys)
    i, t = docs.columns.index(id_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Tokeniser(punctuation=True)
        for batch in batches:
            key = model.keys(batch.column(i).cast(pa.int64()), batch.column(t), words)[3]
            yield batch.filter(pa.array(_ordered(key) >= least))

    return docs.mapInArrow(run, docs.schema)
