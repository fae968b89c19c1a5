"""Byte-level BPE encoding and decoding with a given rank file, as a replay of the merges over the corpus.

1. Texts are split into words where the pattern of the tokenizer splits them, by array operations over
   code points; the distinct words of the corpus make one table.
2. *Replay.*  A partition's words lie one after another as bytes.  An inverted index holds, for
   each pair of neighbours that merges, the positions where it occurs, by the rank of
   the merged token.  Merges are applied in rank order, each at all of its positions in all
   words at once; only the pairs with the neighbours on either side are looked up anew and enter the
   index.  A merge may bring in a pair of lower rank, which comes next then; if it does
   so between two occurrences in one word, that word gets the first of them only and the other
   waits, so each word sees the very order of merging it alone from the left.
3. The words' ids are stored as arrays sorted by a hash, with the words themselves, in the shared
   folder; workers map them and write out each text's ids.  Words are compared byte by byte, so
   a clash of hashes costs a step, not a wrong id.

Null texts count as empty and have no ids; repeated ids are rows of their own.  Texts above
``CHUNK`` characters are split piece by piece, each ending before a space that begins a word, so
only a word of that length is held whole.  Decoding joins the bytes of the ids, which gives every
text again.  Bytes without a rank, or a pattern other than ``SPLIT``, are an error.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop, local_path, shared_dir, written
from ._tokens import U, mix
from .kneser_ney import _range, _save
from .pieces import _ranges

#: Fixed value: the pattern whose words are found here.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE, LETTER, NUMBER, OTHER = range(4)
CHUNK = 1 << 21  # characters looked at together
SYMBOLS = 1 << 21  # bytes of words in one replay
NONE = 1 << 40  # the rank of a pair that doesn't merge
_BASE = 0x9E3779B97F4A7C15


class Ranks:
    """Tokens of a rank file, and the merged token of each pair of tokens that has one."""

    def __init__(self, path: str, pattern: str = SPLIT):
        if pattern != SPLIT:
            raise ValueError("words are found for the pattern SPLIT only")
        with open(path, "rb") as f:
            self._set({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Ranks:
        out = cls.__new__(cls)
        out._set(ranks)
        return out

    def _set(self, ranks: dict[bytes, int]) -> None:
        self.whole = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        found = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.keys, self.merged = np.append(found[:, 0], np.iinfo(np.int64).max), np.append(found[:, 1], NONE)
        tokens = {r: t for t, r in ranks.items()}
        text = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.lengths = np.array([len(t) for t in text], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(text), np.uint8)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair of tokens merges into, or NONE."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, bytes of each)."""
        n = self.lengths[ids]
        total, at = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(counts)])
        return self.data[_ranges(self.starts[ids], n)], total[at[1:]] - total[at[:-1]]


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, ids of each); a word that is a token as it stands is that one."""
    whole = np.array([ranks.whole.get(w, -1) for w in words], np.int64)
    rest = np.flatnonzero(whole < 0)
    merged, n = _merges([words[k] for k in rest.tolist()], ranks)
    counts = np.ones(len(words), np.int64)
    counts[rest] = n
    starts = np.cumsum(counts) - counts
    ids = np.zeros(int(counts.sum()), np.int64)
    ids[starts[whole >= 0]] = whole[whole >= 0]
    ids[_ranges(starts[rest], n)] = merged
    return ids, counts


def _merges(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    data, lengths = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
    n = len(data)
    sym = np.append(ranks.byte[data], -1)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    ends = np.cumsum(lengths)
    after[ends - 1], before[ends - lengths] = n, n  # n: nothing there
    word = np.repeat(np.arange(len(lengths)), lengths)
    rank = np.append(ranks.pair(sym[:n], sym[after[:n]]), NONE)
    order = np.argsort(rank[:n], kind="stable")
    order = order[: np.searchsorted(rank[order], NONE)]
    cut = np.flatnonzero(np.diff(rank[order])) + 1
    index = {int(rank[p[0]]): [p] for p in np.split(order, cut) if len(p)}
    heap = list(index)  # ascends

    def put(r: int, at: np.ndarray) -> None:
        if r in index:
            index[r].append(at)
        else:
            index[r] = [at]
            heapq.heappush(heap, r)

    while heap:
        r = heapq.heappop(heap)
        places = index.pop(r)
        at = places[0] if len(places) == 1 else np.concatenate(places)
        at = np.unique(at[rank[at] == r])
        if not len(at):
            continue
        if len(at) > 1 and (word[at[1:]] == word[at[:-1]]).any():
            at, rest = _together(at, r, sym, after, before, word, ranks)
            if len(rest):
                put(r, rest)
        gone = after[at]
        right = after[gone]
        sym[at], sym[gone], rank[gone] = r, -1, NONE
        after[at], before[right] = right, at
        left = before[at]
        touched = np.concatenate([at, left[left < n]])
        fresh = ranks.pair(sym[touched], sym[after[touched]])
        rank[touched] = fresh
        touched, fresh = touched[fresh < NONE], fresh[fresh < NONE]
        if len(touched) == 1:
            put(int(fresh[0]), touched)
        elif len(touched):
            order = np.argsort(fresh, kind="stable")
            touched, fresh = touched[order], fresh[order]
            cut = np.flatnonzero(fresh[1:] != fresh[:-1]) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(fresh)], strict=True):
                put(int(fresh[a]), touched[a:b])
    alive = sym[:n] >= 0
    return sym[:n][alive], np.bincount(word[alive], minlength=len(lengths))


def _together(at: np.ndarray, r: int, sym: np.ndarray, after: np.ndarray, before: np.ndarray, word: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Of a merge's positions in order, those that merge at once, from the left and without overlap, and those that
    wait (or are gone by then): those of a word in which a pair of lower rank comes up in between."""
    given, laps = at, after[at[:-1]] == at[1:]
    if laps.any():
        place = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~laps]), place, 0))
        at = at[(place - begin) % 2 == 0]
    left, gone = before[at], after[at]
    by = sym[left]
    by[1:][gone[:-1] == left[1:]] = r
    lower = (ranks.pair(by, np.full(len(at), r)) < r) | (ranks.pair(np.full(len(at), r), sym[after[gone]]) < r)
    if not lower.any():
        return at, at[:0]
    first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
    waits = word[at[lower]]
    return at[first | ~np.isin(word[at], waits)], given[np.isin(word[given], waits)]


def classes() -> np.ndarray:
    """The class of each code point as the library's own regular expressions see it (versions of Unicode differ)."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary(every)
        out[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


class Words:
    """Words of texts by array operations over code points."""

    def __init__(self, of: np.ndarray, chunk: int = CHUNK):
        self.of, self.chunk = of, chunk
        self.up = self.down = np.zeros(0, U)

    def starts(self, cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where words begin in texts one after another, which begin at ``bounds`` and end at its last."""
        n = len(cp)
        kind = np.full(n + 3, 9, np.uint8)
        kind[:n] = self.of[cp]
        first = np.ones(n + 4, bool)
        first[:n] = False
        first[bounds[:-1]] = True
        start = first[:n].copy()
        start[1:] |= kind[1:n] != kind[: n - 1]
        # of white space before other text the last character stands alone, and a space goes with what follows
        i = np.flatnonzero((kind[1:n] != WHITE) & (kind[: n - 1] == WHITE) & ~first[1:n]) + 1
        start[i - 1] = True
        start[i] = cp[i - 1] != 32
        # an apostrophe that begins a word takes the letters of a contraction
        q = np.flatnonzero((cp == 39) & start)
        q = q[(kind[q + 1] == LETTER) & ~first[q + 1]]
        a, b = cp[q + 1], cp[np.minimum(q + 2, n - 1)]
        two = ~first[q + 2] & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        one = np.isin(a, [ord(c) for c in "stmd"])
        for q, width in ((q[one], 2), (q[two], 3)):
            start[q + 1] = False
            start[(q + width)[~first[q + width]]] = True
        return np.flatnonzero(start)

    def hashes(self, cp: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(cp)
        if n > len(self.up):
            m = max(n, self.chunk + (1 << 16))
            self.up, self.down = np.cumprod(np.full(m, _BASE, U)), np.cumprod(np.full(m, pow(_BASE, -1, 1 << 64), U))
        x = cp.astype(U)
        x += U(1)
        x *= self.up[:n]
        h = np.add.reduceat(x, at) * self.down[at]
        h += np.diff(np.append(at, n)).astype(U) * U(0xD6E8FEB86659FD93)
        return mix(h)

    def pieces(self, texts: list[str]) -> Iterator[tuple[int, int, list[str], bool]]:
        """(first text, text after the last, their strings, whether the text goes on); of a longer text several pieces in turn."""
        lo, size = 0, 0
        for k, text in enumerate(texts):
            if len(text) > self.chunk:
                if k > lo:
                    yield lo, k, texts[lo:k], False
                begin = 0
                while begin < len(text):
                    end = self._cut(text, begin)
                    yield k, k + 1, [text[begin:end]], end < len(text)
                    begin = end
                lo, size = k + 1, 0
                continue
            if size + len(text) > self.chunk and k > lo:
                yield lo, k, texts[lo:k], False
                lo, size = k, 0
            size += len(text)
        if lo < len(texts):
            yield lo, len(texts), texts[lo:], False

    def _cut(self, text: str, begin: int) -> int:
        """A space after something else that is about a chunk away: a word begins there whatever follows."""
        if len(text) - begin <= self.chunk:
            return len(text)
        at = text.rfind(" ", begin + 1, begin + self.chunk)
        while at > 0 and self.of[ord(text[at - 1])] == WHITE:
            at = text.rfind(" ", begin + 1, at)
        if at > 0:
            return at
        at = text.find(" ", begin + self.chunk)
        while at > 0 and self.of[ord(text[at - 1])] == WHITE:
            at = text.find(" ", at + 1)
        return at if at > 0 else len(text)

    def distinct(self, strings: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(distinct words, their hashes, of each word in turn which of them it is, words of each text)."""
        text = "".join(strings)
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        if not text:
            return [], np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(strings), np.int64)
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        full = np.append(bounds[:-1][bounds[:-1] < bounds[1:]], len(cp))
        at = self.starts(cp, full)
        n = np.diff(np.append(at, len(cp)))
        h = self.hashes(cp, at)
        u, first, which = np.unique(h, return_index=True, return_inverse=True)
        if not ((n[first][which] == n).all() and (cp[_ranges(at[first][which], n)] == cp).all()):  # two words have one hash
            seen: dict[str, int] = {}
            which = np.array([seen.setdefault(text[a : a + k], len(seen)) for a, k in zip(at.tolist(), n.tolist(), strict=True)])
            first = np.unique(which, return_index=True)[1]
            u = h[first]
        words = [text[a : a + k] for a, k in zip(at[first].tolist(), n[first].tolist(), strict=True)]
        return words, u, which, np.diff(np.searchsorted(at, bounds))


def _plain(batches: Iterator[pa.RecordBatch], i: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            yield part, [t or "" for t in part.column(i).to_pylist()]


class Encoder:
    """Where the words' ids lie; maps the arrays on first use in a worker."""

    def __init__(self, folder: str, parts: int, of: np.ndarray, ranks: Ranks):
        self.folder, self.parts, self.words, self.ranks, self.open = folder, parts, Words(of), ranks, {}

    def array(self, name: str) -> np.ndarray:
        if name not in self.open:
            self.open[name] = np.load(f"{self.folder}/{name}.npy", mmap_mode="r")
        return self.open[name]

    def of_words(self, words: list[str], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, ids of each)."""
        raw = pa.array(words, pa.string()).cast(pa.binary())
        data, ends = np.frombuffer(raw.buffers()[2] or b"", np.uint8), np.frombuffer(raw.buffers()[1], np.int32)[1 : len(words) + 1].astype(np.int64)
        size = np.diff(np.concatenate([[0], ends]))
        part = _range(h, self.parts)
        counts, begins, pieces, base = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        for p in np.unique(part).tolist():
            mine = np.flatnonzero(part == p)
            keys, text_ends, text, id_ends, ids = (self.array(f"{x}-{p}") for x in ("key", "end", "text", "id_end", "ids"))
            at, open_ = np.searchsorted(keys, h[mine]), np.arange(len(mine))
            while len(open_):  # on to the next of the same hash until the bytes are the same
                k, w = at[open_], mine[open_]
                if (k >= len(keys)).any() or (keys[k] != h[w]).any():
                    raise ValueError("a word has no ids: the texts differ from those whose words were encoded")
                begin = np.where(k > 0, text_ends[k - 1], 0)
                same = text_ends[k] - begin == size[w]
                of = np.flatnonzero(same)
                equal = text[_ranges(begin[of], size[w[of]])] == data[_ranges(ends[w[of]] - size[w[of]], size[w[of]])]
                same[of] = np.logical_and.reduceat(equal, np.cumsum(size[w[of]]) - size[w[of]]) if len(of) else True
                open_ = open_[~same]
                at[open_] += 1
            begin = np.where(at > 0, id_ends[at - 1], 0)
            counts[mine] = id_ends[at] - begin
            pieces.append(ids[_ranges(begin, counts[mine])])
            begins[mine] = base + np.cumsum(counts[mine]) - counts[mine]
            base += len(pieces[-1])
        flat = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
        return flat[_ranges(begins, counts)], counts

    def encoded(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, text after the last, ids, ids of each text)."""
        held: list[np.ndarray] = []  # of a text in several pieces
        for lo, hi, strings, more in self.words.pieces(texts):
            words, h, which, n_words = self.words.distinct(strings)
            ids, n = self.of_words(words, h)
            starts, each = np.cumsum(n) - n, n[which]
            ids = ids[_ranges(starts[which], each)]
            if more or held:
                held.append(ids)
                if not more:
                    yield lo, hi, np.concatenate(held), np.array([sum(map(len, held))])
                    held = []
                continue
            total, at = np.concatenate([[0], np.cumsum(each)]), np.concatenate([[0], np.cumsum(n_words)])
            yield lo, hi, ids, total[at[1:]] - total[at[:-1]]


def build(docs: DataFrame, ranks: Ranks, text_col: str = "text") -> Encoder:
    """Encodes every distinct word of the texts."""
    spark, of = docs.sparkSession, classes()

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(of)
        for _, texts in _plain(batches, 0):
            for _, _, strings, _ in words.pieces(texts):
                found = words.distinct(strings)[0]
                for k in range(0, len(found), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(found[k : k + 50_000], pa.string())], ["word"])

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(of), [], 0

        def flush() -> pa.RecordBatch:
            column = pa.concat_arrays(held)
            ids, n = replay(column.cast(pa.binary()).to_pylist(), ranks)
            strings = column.to_pylist()
            text = "".join(strings)
            at = np.concatenate([[0], np.cumsum([len(s) for s in strings])])[:-1]
            h = words.hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), at)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            return pa.RecordBatch.from_arrays([column, pa.array(h.view(np.int64)), lists], ["word", "h", "ids"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0))
                size += batch.column(0).nbytes
                if size >= SYMBOLS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    found = docs.select(F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL").mapInArrow(words_of, "word string").distinct()
    coded = written(found.mapInArrow(replayed, "word string, h long, ids array<int>"))
    size = coded.agg(F.coalesce(F.sum(F.octet_length("word") + 4 * F.size("ids") + 24), F.lit(0))).first()[0]
    parts = max(1, -(-size // (32 << 20)))
    folder = local_path(shared_dir(spark))

    def store(table: pa.Table) -> pa.Table:
        h = table["h"].to_numpy().view(U)
        part, order = int(_range(h[:1], parts)[0]), np.argsort(h)
        word, ids = (table[c].combine_chunks().take(pa.array(order)) for c in ("word", "ids"))
        raw = word.cast(pa.binary())
        ends = np.frombuffer(raw.buffers()[1], np.int32)[: len(raw) + 1].astype(np.int64)
        _save(f"{folder}/key-{part}.npy", h[order])
        _save(f"{folder}/end-{part}.npy", ends[1:] - ends[0])
        _save(f"{folder}/text-{part}.npy", np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]])
        _save(f"{folder}/id_end-{part}.npy", np.cumsum(ids.value_lengths().to_numpy()))
        _save(f"{folder}/ids-{part}.npy", ids.flatten().to_numpy().astype(np.int32))
        return pa.table({"words": pa.array([len(h)], pa.int64())})

    high = F.shiftrightunsigned("h", 32)
    by = F.shiftright(high * parts, 32)
    coded.withColumn("part", by).repartition(parts, "part").groupBy("part").applyInArrow(store, "words long").agg(F.sum("words")).first()
    drop(coded)
    return Encoder(folder, parts, of, ranks)


def encode(docs: DataFrame, ranks: Ranks, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of its texts in a further column (an existing one of that name is replaced)."""
    encoder, rest = build(docs, ranks, text_col), docs.drop(ids_col)
    i = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _plain(batches, i):
            for lo, hi, ids, n in encoder.encoded(texts):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, lists], [*batch.schema.names, ids_col])

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    return rest.mapInArrow(run, StructType(list(rest.schema.fields)).add(ids_col, ArrayType(IntegerType())))


def decode(docs: DataFrame, ranks: Ranks, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that its ids stand for in a further column; null ids stand for none."""
    rest = docs.drop(bytes_col)
    i = rest.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            lists = batch.column(i)
            counts = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            data, size = ranks.bytes(lists.flatten().to_numpy(), counts)
            ends = np.cumsum(size).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([data[b - n : b].tobytes() for b, n in zip(ends, size.tolist(), strict=True)], pa.binary())], [*batch.schema.names, bytes_col])

    from pyspark.sql.types import BinaryType, StructType

    return rest.mapInArrow(run, StructType(list(rest.schema.fields)).add(bytes_col, BinaryType()))


def round_trip(docs: DataFrame, ranks: Ranks, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256."""
    encoder = build(docs, ranks, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = lambda a, n: [hashlib.sha256(a[e - k : e].tobytes()).hexdigest() for e, k in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)]
        for batch, texts in _plain(batches, 1):
            for lo, hi, ids, n in encoder.encoded(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(digests(ids.astype("<u4"), n)), pa.array(digests(*ranks.bytes(ids, n)))], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
