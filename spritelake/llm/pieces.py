"""SentencePiece encoding and decoding with a given piece table, as a relational lattice.

1. Texts are cut into units wherever no piece holds the two bytes on either side next to each
   other, such as before a space or at a line feed.  No piece spans two units then, so a text's
   ids are those of its units one after another, and each distinct unit is encoded once.
2. Each unit is exploded into its substrings of at most the longest piece's length, which
   join the (bounded, broadcast) piece table; a character without a piece stands for its UTF-8
   byte pieces.  The edges are grouped by unit, which the distinct units are already
   partitioned by, so the lattice is never shuffled.
3. A Viterbi pass folds over a unit's edges in order of their ends with ``aggregate``: of the
   edges that end at a position, the best admissible one that continues the path to its start
   survives.  *Unigram* tables admit all and the highest sum of scores is best.  *BPE* tables
   admit an edge next to the piece before it only if no earlier merge would have crossed the
   boundary between them; exactly one edge passes at each position, and the path is the one
   that merging by rank finds.  Which parts of a piece stood at its two ends, and until which
   merge, is worked out once for each piece; what crosses a boundary, once for each boundary.
4. Ids of units are stored as sorted hash arrays in the shared folder; workers map them and
   write out each text's ids.

A unit of more than ``CHUNK`` characters, such as a text without any space, is folded in chunks,
one row each: all at once from a little before their start, then those again whose start isn't
as the chunk before has left it, until all fit together.  So no row grows with the text.

Null texts have null ids, empty texts none.  Repeated ids are rows of their own.  ``decode`` is
the inverse: it restores every text, as spaces and bytes are kept, but for the special sign
U+2581, which encoding reads as a space.  Units are told apart by 64 bits of a hash in the
stored arrays: a clash would be noticed when the arrays are written and is an error.
"""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import drop, local_path, shared_dir, written
from ._tokens import U, Tokeniser, mix
from .kneser_ney import _range, _save

SPACE = "▁"
CHUNK, BEFORE = 1024, 128  # positions folded in one row, and looked at before them
LATTICE_UNITS = 4096  # a partition
ENDLESS = (1 << 31) - 1


class PieceTable:
    """Pieces, ids, scores, byte pieces and model type of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.path, self.size = path, m.get_piece_size()
        plain = [i for i in range(self.size) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i) or m.is_unused(i))]
        self.pieces = {m.id_to_piece(i): (i, m.get_score(i)) for i in plain}
        self.bytes_ = {int(m.id_to_piece(i)[1:-1], 16): i for i in range(self.size) if m.is_byte(i)}
        self.unknown = m.unk_id()
        self.longest = max(map(len, self.pieces))
        self.bpe = _model_type(m.serialized_model_proto()) == 2
        self.inner = np.zeros((256, 256), bool)  # bytes that stand next to each other in a piece
        for piece in self.pieces:
            raw = np.frombuffer(piece.replace(SPACE, " ").encode(), np.uint8)
            self.inner[raw[:-1], raw[1:]] = True
        self.inner[:, 128:192] = True  # within a character

    def spines(self, piece: str) -> tuple[list[tuple[int, float]], list[tuple[int, float]]] | None:
        """(length, rank at which it merged on) of the parts that stood at a piece's left and right
        end while it was merged from characters; None if merging doesn't end in the piece."""
        parts, left, right = list(piece), [], []
        while len(parts) > 1:
            ranks = [-self.pieces[a + b][1] if a + b in self.pieces else np.inf for a, b in zip(parts[:-1], parts[1:], strict=True)]
            i = int(np.argmin(ranks))
            if ranks[i] == np.inf:
                return None
            if i == 0:
                left.append((len(parts[0]), float(ranks[i])))
            if i == len(parts) - 2:
                right.append((len(parts[-1]), float(ranks[i])))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return left + [(len(piece), float("inf"))], right + [(len(piece), float("inf"))]

    def frame(self, spark: SparkSession) -> DataFrame:
        """piece, id, rank (order of merging), score (fixed point) and parts: those at the left end and,
        marked by the last bit, at the right end, as ``until << 9 | length << 1 | mark``."""
        if self.longest > 255:
            raise ValueError("a piece is longer than 255 characters")
        order = {s: k for k, s in enumerate(sorted({-s for _, s in self.pieces.values()}))}
        rows = []
        for piece, (i, score) in self.pieces.items():
            ends = self.spines(piece) if self.bpe else ([], [])
            if ends:
                parts = [(ENDLESS if until == np.inf else order[until]) << 9 | n << 1 | mark for mark, spine in enumerate(ends) for n, until in spine]
                rows.append((piece, i, order[-score], 0 if self.bpe else round(score * (1 << 24)), parts))
        return spark.createDataFrame(rows, "piece string, id int, rank int, score long, parts array<long>")


STEP = "struct<step:long,total:long,crossed:array<long>>"


@contextlib.contextmanager
def _grouped_by_hash(spark: SparkSession) -> Iterator[None]:
    """A partition's units are few enough to be grouped without a sort; the setting is put back."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(LATTICE_UNITS * 8))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _model_type(proto: bytes) -> int:
    """Field 3 of the trainer settings, which are field 2: 1 unigram, 2 BPE."""

    def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
        at = 0

        def varint() -> int:
            nonlocal at
            out = shift = 0
            while True:
                b = data[at]
                at += 1
                out |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return out

        while at < len(data):
            tag = varint()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, varint()
            elif kind == 2:
                n = varint()
                yield tag >> 3, data[at : at + n]
                at += n
            else:
                at += 8 if kind == 1 else 4
                yield tag >> 3, b""

    for number, value in fields(proto):
        if number == 2:
            return next((v for n, v in fields(value) if n == 3), 1)
    return 1


def lattice(units: DataFrame, table: PieceTable, keys: tuple[str, ...] = ("unit",)) -> DataFrame:
    """The key columns, edges and merges: the edges of each distinct unit in order of their ends, and
    those of several characters once more as ``rank << 22 | end << 11 | begin``.

    An edge without a piece is a single character and has id -1.
    """
    ends = units.select("*", F.explode(F.sequence(F.lit(1), F.char_length("unit"))).alias("end"))
    spans = ends.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(table.longest), F.col("end")))).alias("len"))
    subs = spans.select(*keys, "end", "len", F.substring("unit", F.col("end") - F.col("len") + 1, F.col("len")).alias("piece"))
    pieces = F.broadcast(table.frame(units.sparkSession))  # one row a piece of the table: bounded
    found = subs.join(pieces, "piece", "left").where("id IS NOT NULL OR len = 1")
    alone = F.array(F.lit(ENDLESS << 9 | 1 << 1), F.lit(ENDLESS << 9 | 1 << 1 | 1)).cast("array<long>")
    weight = F.coalesce("parts", alone).alias("parts") if table.bpe else F.coalesce("score", F.lit(-(10_000 << 24))).cast("long").alias("score")
    edge = F.struct("end", "len", F.coalesce("id", F.lit(-1)).alias("id"), weight)
    merged = F.when(F.col("len") > 1, F.shiftleft(F.col("rank").cast("long"), 22) + F.col("end") * 2048 + F.col("end") - F.col("len"))
    return found.groupBy(*keys).agg(F.collect_list(edge).alias("edges"), F.collect_list(merged).alias("merges"))


def viterbi(table: PieceTable, state: str | None = None, lead: Column | None = None) -> Column:
    """The steps of the best path to each position, ``(id + 1) << 8 | length``, after those of the
    state (of the positions up to ``lead``) if there is one, else after a first one at position 0.

    Edges that are not in order of their ends make the path end early; they are never taken wrongly.
    """
    start = F.array(F.struct(F.lit(0).cast("long").alias("step"), F.lit(0).cast("long").alias("total"), F.array().cast("array<long>").alias("crossed"))).cast(f"array<{STEP}>")
    given = F.col(state) if state else start
    base = lead - F.size(state) + 1 if state else F.lit(0)  # the position of the first
    known = lead if state else F.lit(0)
    last = F.element_at("edges", -1)["end"]

    def crossed(p: Column, parts: Column) -> Column:
        """Merges over the boundary p with a part at its left that is still there: ``rank << 9 | length at the right << 1``."""
        begin, end, rank = (lambda m: m.bitwiseAND(F.lit(2047))), (lambda m: F.shiftright(m, 11).bitwiseAND(F.lit(2047))), (lambda m: F.shiftright(m, 22))
        meets = lambda m: F.exists(parts, lambda a: (a.bitwiseAND(F.lit(511)) == (p - begin(m)) * 2 + 1) & (rank(m) < F.shiftright(a, 9)))
        over = F.filter("merges", lambda m: (begin(m) < p) & (end(m) > p) & meets(m))
        return F.transform(over, lambda m: F.shiftleft(rank(m), 9) + (end(m) - p) * 2)

    def entry(e: Column, total: Column) -> Column:
        step = F.shiftleft((e["id"] + 1).cast("long"), 8) + e["len"]
        none = F.array().cast("array<long>")  # nothing begins at the last position
        return F.array(F.struct(step.alias("step"), total.alias("total"), (F.when(e["end"] < last, crossed(e["end"], e["parts"])).otherwise(none) if table.bpe else none).alias("crossed")))

    def merge(path: Column, e: Column) -> Column:
        next_ = F.size(path) + base
        before = F.get(path, e["end"] - e["len"] - base)
        if table.bpe:  # a later part would have merged first if it is still there then
            stopped = F.exists(before["crossed"], lambda c: F.exists(e["parts"], lambda b: (b.bitwiseAND(F.lit(511)) == c.bitwiseAND(F.lit(511))) & (c <= b)))
            return F.when((e["end"] != next_) | stopped, path).otherwise(F.concat(path, entry(e, F.lit(0).cast("long"))))
        total = before["total"] + e["score"]
        better = (e["end"] == next_ - 1) & (e["end"] > known) & (total > F.get(path, next_ - 1 - base)["total"])
        return F.when(e["end"] == next_, F.concat(path, entry(e, total))).when(better, F.concat(F.slice(path, F.lit(1), F.size(path) - 1), entry(e, total))).otherwise(path)

    return F.aggregate("edges", given, merge)


def _short(units: DataFrame, table: PieceTable) -> DataFrame:
    """unit, steps of units of up to CHUNK characters."""
    return lattice(units, table).select("unit", F.slice(viterbi(table), F.lit(2), F.lit(CHUNK))["step"].alias("steps"))


def _long(units: DataFrame, table: PieceTable) -> DataFrame:
    """unit, steps of longer ones, chunk by chunk."""
    texts = written(units.select(F.monotonically_increasing_id().alias("uid"), "unit"))
    n, k = F.char_length("unit"), F.col("chunk")
    chunks = texts.select("uid", "unit", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))).alias("chunk"))
    lead = F.when(k > 0, BEFORE + table.longest).otherwise(0)
    here = F.least(F.lit(CHUNK), n - k * CHUNK)
    cut = chunks.select("uid", "chunk", lead.alias("lead"), here.cast("int").alias("here"), F.substring("unit", k * CHUNK - lead + 1, lead + CHUNK + table.longest).alias("unit"))
    keys = ("uid", "chunk", "lead", "here")
    with _grouped_by_hash(units.sparkSession):
        ready = written(lattice(cut.repartition("uid", "chunk"), table, keys))
    ends = lambda path, at: F.slice(path, F.greatest(at - table.longest + 2, F.lit(1)), F.least(at + 1, F.lit(table.longest)))

    def folded(rows: DataFrame, state: bool) -> DataFrame:
        """steps of the chunk, the state it began with and the one it left, sums counted from its end."""
        rows = rows.withColumn("path", viterbi(table, "state" if state else None, F.col("lead")))
        at = F.size("state") - 1 if state else F.col("lead")  # of the last step before the chunk
        from_end = lambda x: F.transform(x, lambda s: F.struct(s["step"].alias("step"), (s["total"] - F.element_at(x, -1)["total"]).alias("total"), s["crossed"].alias("crossed")))
        return rows.select("uid", "chunk", F.slice("path", at + 2, F.col("here"))["step"].alias("steps"), from_end(ends(F.col("path"), at)).alias("begun"), from_end(ends(F.col("path"), at + F.col("here"))).alias("left"))

    done = written(folded(ready, False))
    while True:
        before = done.select("uid", (F.col("chunk") + 1).alias("chunk"), F.col("left").alias("state"))
        wrong = written(done.join(before, ["uid", "chunk"]).where("begun <> state").select("uid", "chunk", "state"))
        if wrong.isEmpty():
            break
        again = folded(ready.join(wrong, ["uid", "chunk"]), True)
        after = written(done.join(wrong, ["uid", "chunk"], "left_anti").unionByName(again))
        drop(done, wrong)
        done = after
    drop(ready)
    steps = done.groupBy("uid").agg(F.flatten(F.array_sort(F.collect_list(F.struct("chunk", "steps")))["steps"]).alias("steps"))
    return texts.join(steps, "uid").select("unit", "steps")


def _walked(texts: pa.Array, steps: pa.Array, table: PieceTable) -> pa.Array:
    """Ids of units from the steps to each of their positions: all walk back from their ends together."""
    ends = steps.offsets.to_numpy()
    flat = steps.values.to_numpy()
    first, at = ends[:-1].astype(np.int64), ends[1:].astype(np.int64)
    who, found = [], []
    alive = np.flatnonzero(at > first)
    while len(alive):
        step = flat[at[alive] - 1]
        who.append(alive)
        found.append(np.where(step >> 8 > 0, (step >> 8) - 1, -1 - (at[alive] - 1 - first[alive])))  # below zero: the place of a character without a piece
        at[alive] -= step & 255
        alive = alive[at[alive] > first[alive]]
    unit, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, found))
    turn = np.concatenate([np.full(len(x), -k) for k, x in enumerate(who)]) if who else unit
    order = np.lexsort((turn, unit))
    unit, ids = unit[order], ids[order]
    for i in reversed(np.flatnonzero(ids < 0).tolist()):
        raw = texts[int(unit[i])].as_py()[-1 - int(ids[i])].encode()
        own = [table.bytes_[b] for b in raw] if table.bytes_ else [table.unknown]
        ids, unit = np.concatenate([ids[:i], own, ids[i + 1 :]]), np.concatenate([unit[:i], np.full(len(own), unit[i]), unit[i + 1 :]])
    cuts = np.concatenate([[0], np.cumsum(np.bincount(unit, minlength=len(texts)))]).astype(np.int32)
    return pa.ListArray.from_arrays(cuts, pa.array(ids, pa.int32()))


class Units(Tokeniser):
    """Units of texts instead of words; they cover a text without gaps."""

    def __init__(self, inner: np.ndarray, chunk: int = 1 << 20):
        super().__init__(chunk=chunk)
        self.inner = inner.ravel()
        self.table = mix(np.arange(1001, 1257, dtype=U) * U(0x9E3779B97F4A7C15))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            self.starts = np.zeros(0, np.int64)
            return np.zeros(0, U), np.zeros(len(offsets) - 1, np.int64)
        if n > len(self.up):
            self.powers(n)
        start = np.zeros(n, bool)
        start[1:] = ~self.inner[data[:-1].astype(np.uint16) << 8 | data[1:]]
        start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        at = np.flatnonzero(start)
        x = self.table[data] * self.up[:n]
        h = np.add.reduceat(x, at) * self.down[at]
        self.starts = at
        h += np.diff(np.append(at, n)).astype(U) * U(0xD6E8FEB86659FD93)
        return mix(h), np.diff(np.searchsorted(at, offsets))


def prepared(texts: pa.Array) -> pa.Array:
    """With the space that stands before a text; an empty text stays empty."""
    texts = pc.replace_substring(texts, SPACE, " ")
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(" ", texts, ""))


def _distinct(inner: np.ndarray, most: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, seen = Units(inner), np.zeros(0, U)
        for texts in (prepared(b.column(0).slice(i, 500)) for b in batches for i in range(0, b.num_rows, 500)):
            data, offsets = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.frombuffer(texts.buffers()[1], np.int32)
            for lo, hi, h, _ in units.chunks(texts):
                u, first = np.unique(h, return_index=True)
                new = ~np.isin(u, seen, assume_unique=True)
                if not new.any():
                    continue
                seen = np.concatenate([seen, u[new]]) if len(seen) < most else u[new]
                base, end = int(offsets[texts.offset + lo]), int(offsets[texts.offset + hi])
                cuts = np.append(units.starts, end - base).astype(np.int32)
                strings = pa.StringArray.from_buffers(len(units.starts), pa.py_buffer(cuts.tobytes()), pa.py_buffer(data[base:end].tobytes()))
                yield pa.RecordBatch.from_arrays([strings.take(pa.array(np.sort(first[new])))], ["unit"])

    return run


def _store(folder: str):
    def run(table: pa.Table) -> pa.Table:
        part, h = table["part"][0].as_py(), table["h"].to_numpy().view(U)
        order = np.argsort(h)
        if (np.diff(h[order]) == 0).any():
            raise ValueError("two units have one hash")
        ids = table["ids"].combine_chunks().take(pa.array(order))
        _save(f"{folder}/unit-{part}.npy", h[order])
        _save(f"{folder}/ends-{part}.npy", np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)))
        _save(f"{folder}/ids-{part}.npy", ids.flatten().to_numpy().astype(np.int32))
        return pa.table({"part": pa.array([part], pa.int32()), "units": pa.array([len(h)], pa.int64())})

    return run


def _one(units: Units, texts: pa.Array) -> np.ndarray:
    """Hashes of strings that are one unit each."""
    out = []
    for _, _, h, counts in units.chunks(texts):
        if (counts != 1).any():
            raise ValueError("a stored unit is not one unit")
        out.append(h)
    return np.concatenate(out)


class Encoder:
    """Where the units' ids lie; maps the arrays on first use in a worker."""

    def __init__(self, folder: str, parts: int):
        self.folder, self.parts, self.open = folder, parts, {}

    def array(self, name: str) -> np.ndarray:
        if name not in self.open:
            self.open[name] = np.load(f"{self.folder}/{name}.npy", mmap_mode="r")
        return self.open[name]

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after another, ids of each unit)."""
        u, back = np.unique(h, return_inverse=True)
        part = _range(u, self.parts)
        lengths, pieces = np.zeros(len(u), np.int64), []
        for p in np.unique(part).tolist():
            mine = np.flatnonzero(part == p)
            keys, ends = self.array(f"unit-{p}"), self.array(f"ends-{p}")
            at = np.searchsorted(keys, u[mine])
            if len(keys) == 0 or (keys[np.minimum(at, len(keys) - 1)] != u[mine]).any():
                raise ValueError("a unit has no ids: the texts differ from those that the lattice was built from")
            n = ends[at] - np.where(at > 0, ends[at - 1], 0)
            lengths[mine] = n
            pieces.append(self.array(f"ids-{p}")[_ranges(ends[at] - n, n)])  # parts ascend with u
        flat, starts = (np.concatenate(pieces) if pieces else np.zeros(0, np.int32)), np.cumsum(lengths) - lengths
        n = lengths[back]
        return flat[_ranges(starts[back], n)], n


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + lengths[0] - 1, starts[1] .. and so on."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def build(docs: DataFrame, text_col: str, table: PieceTable) -> Encoder:
    """Encodes every distinct unit of the texts."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    found = texts.mapInArrow(_distinct(table.inner), "unit string").select(F.replace("unit", F.lit(" "), F.lit(SPACE)).alias("unit"))
    units = written(found.distinct())
    n = F.char_length("unit")
    count, size, longest = units.agg(F.count(F.lit(1)), F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    # dealt out so finely that a partition's edges fit in memory; the lattice keeps this partitioning
    path = _short(units.where(n <= CHUNK).repartition(max(1, -(-count // LATTICE_UNITS)), "unit"), table)
    if longest > CHUNK:
        path = path.unionByName(_long(units.where(n > CHUNK), table))
    parts = max(1, -(-size // (4 << 20)))
    uri, inner = shared_dir(spark), table.inner
    at = local_path(uri)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(inner)
        for batch in batches:
            if batch.num_rows:
                if not pc.all(pc.equal(pc.list_value_length(batch.column(1)), pc.utf8_length(batch.column(0)))).as_py():
                    raise ValueError("a path doesn't reach the end of its unit")
                h = _one(units, pc.replace_substring(batch.column(0), SPACE, " "))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), _walked(batch.column(0), batch.column(1), table), pa.array(_range(h, parts))], ["h", "ids", "part"])

    with _grouped_by_hash(spark):
        ids = written(path.mapInArrow(hashed, "h long, ids array<int>, part int"))
    ids.repartition(parts, "part").groupBy("part").applyInArrow(_store(at), "part int, units long").agg(F.sum("units")).first()
    drop(units, ids)
    return Encoder(at, parts)


def encode(docs: DataFrame, table: PieceTable, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of its texts in a further column (an existing one of that name is replaced)."""
    encoder, inner = build(docs, text_col, table), table.inner
    rest = docs.drop(ids_col)
    i = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(inner)
        for batch in batches:
            for lo, hi, ids, n in encoded(batch.column(i), units, encoder):
                null = pc.is_null(batch.column(i).slice(lo, hi - lo)).to_numpy(zero_copy_only=False)
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), mask=np.append(null, False))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))], [*batch.schema.names, ids_col])

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    return rest.mapInArrow(run, StructType(list(rest.schema.fields)).add(ids_col, ArrayType(IntegerType())))


def encoded(texts: pa.Array, units: Units, encoder: Encoder) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, ids, ids of each text)."""
    for first in range(0, len(texts), 500):
        for lo, hi, h, counts in units.chunks(prepared(texts.slice(first, 500))):
            ids, n = encoder.ids(h)
            total = np.concatenate([[0], np.cumsum(n)])
            at = np.concatenate([[0], np.cumsum(counts)])
            yield first + lo, first + hi, ids, total[at[1:]] - total[at[:-1]]


class Decoder:
    """Bytes of each id in one array."""

    def __init__(self, table: PieceTable):
        of = {i: p.replace(SPACE, " ").encode() for p, (i, _) in table.pieces.items()} | {i: bytes([b]) for b, i in table.bytes_.items()}
        text = [of.get(i, b"") for i in range(table.size)]
        self.lengths = np.array([len(t) for t in text], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(text), np.uint8)

    def bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, bytes of each), the space that encoding puts before each left out."""
        n = self.lengths[ids]
        data = self.data[_ranges(self.starts[ids], n)]
        total = np.concatenate([[0], np.cumsum(n)])
        at = np.concatenate([[0], np.cumsum(counts)])
        size = total[at[1:]] - total[at[:-1]]
        first = (np.cumsum(size) - size)[size > 0]
        return np.delete(data, first[data[first] == 32]), size - _led(data, size)


def _led(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(size), np.int64)
    full = size > 0
    out[full] = data[(np.cumsum(size) - size)[full]] == 32
    return out


def decode(docs: DataFrame, table: PieceTable, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``docs`` with the texts of its ids in a further column; null ids give null, bytes that aren't UTF-8 U+FFFD."""
    decoder = Decoder(table)
    rest = docs.drop(text_col)
    i = rest.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(i)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            data, size = decoder.bytes(lists.flatten().to_numpy(), counts)
            ends = np.cumsum(size)
            texts = [data[b - n : b].tobytes().decode("utf-8", "replace") for b, n in zip(ends.tolist(), size.tolist(), strict=True)]
            mask = pc.is_null(lists).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string(), mask=mask)], [*batch.schema.names, text_col])

    from pyspark.sql.types import StringType, StructType

    return rest.mapInArrow(run, StructType(list(rest.schema.fields)).add(text_col, StringType()))


def round_trip(docs: DataFrame, table: PieceTable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), decoded (decoding gives the text again)."""
    encoder, decoder, inner = build(docs, text_col, table), Decoder(table), table.inner
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(inner)
        for batch in batches:
            texts = batch.column(1)
            clean = pc.fill_null(pc.replace_substring(texts, SPACE, " "), "")
            for lo, hi, ids, n in encoded(texts, units, encoder):
                data, size = decoder.bytes(ids, n)
                ends, wide = np.cumsum(n), ids.astype("<i4")
                sums = [zlib.crc32(wide[b - k : b].tobytes()) for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
                stop = np.cumsum(size).tolist()
                back = [data[b - k : b].tobytes() == t.as_buffer().to_pybytes() for b, k, t in zip(stop, size.tolist(), clean.slice(lo, hi - lo), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(sums, pa.int64()), pa.array(back)], ["id", "n_tokens", "ids_crc32", "decoded"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_tokens long, ids_crc32 long, decoded boolean").withColumnRenamed("id", id_col)
