"""K-d tree partitioning: shards of nearly equal bytes, alike in metadata, as DataFrame operations only.

A node of the tree is split along its widest metadata dimension (the largest spread of the
scaled coordinate; of equal ones the first) at the weighted median of bytes, until each leaf
is one shard.  A node of s shards is split s // 2 to the rest, so any number of shards will do;
``target_bytes`` instead of a number asks for leaves of at most that many bytes on average.

A dimension's coordinate has 31 bits, scaled over the whole table; strings go by their first
six bytes, dates and numbers by value.  Below it are 32 bits of a hash, so a value that a third
of the rows share can be cut anywhere.  The median is found in four passes of 16 bits: each
counts bytes by bucket and keeps the bucket that the median is in, so a pass shuffles at most
65536 rows a node and task, and the driver gets one row a node.

What the tree places are *groups* of rows with equal texts, each at the least coordinates of its
rows, so equal texts lie in one shard.  Groups above 1 / ``LARGE`` of a shard, of which there are
at most ``LARGE`` a shard, are placed before, the largest first, each in the emptiest shard, and the
tree fills up what they leave.  A group that fits into no shard is cut into pieces of that size
by the rows' numbers, so its rows are spread even if they are alike in all.

Nulls in a dimension have the lowest coordinate, null texts no bytes but one row's share and are
one group with empty ones.  An empty table gives an empty result.  Slots are gapless within a
shard and come from counts by chunk and a rank within the chunk, so no shard is ever sorted as
a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import drop, written

CHUNK_ROWS = 4096
BITS = 31
LARGE = 16


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(col.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.TimestampType | T.DateType):
        return F.unix_timestamp(col).cast("double")
    return F.when(~F.isnan(col.cast("double")), col.cast("double"))


def kd_shards(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, ...] = ("lang", "source", "n_chars", "doc_id")) -> DataFrame:
    """id, size, text_crc32, shard, slot for every row; size is the text's UTF-8 bytes plus 1."""
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    chosen = [F.col(f"`{id_col}`").alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"), F.xxhash64(body).alias("same"), F.monotonically_increasing_id().alias("row")]
    meta = written(docs.select(*chosen, *(_number(docs, d).alias(f"d{i}") for i, d in enumerate(dimensions))))
    n = len(dimensions)
    spans = meta.agg(F.sum("size").alias("bytes"), *(f(f"d{i}") for i in range(n) for f in (F.min, F.max))).first()
    if shards is None:
        shards = max(1, -(-(spans["bytes"] or 0) // target_bytes))
    most = max(1, (spans["bytes"] or 0) // (shards * LARGE))
    group = ["same", "crc", "size"]
    groups = meta.groupBy(*group).agg(F.sum(F.col("size")).alias("bytes"), *(F.min(f"d{i}").alias(f"d{i}") for i in range(n)))
    large = groups.where(F.col("bytes") > most).select(*group, "bytes").collect()  # fewer than LARGE a shard
    room, fixed = [float(spans["bytes"] or 0) / shards] * shards, []
    for r in sorted(large, key=lambda r: (-r["bytes"], r["same"])):
        at = max(range(shards), key=lambda k: (room[k], -k))
        if r["bytes"] <= room[at]:
            room[at] -= r["bytes"]
            fixed.append((r["same"], r["crc"], r["size"], at, 1))
        else:
            fixed.append((r["same"], r["crc"], r["size"], None, -(-r["bytes"] // most)))
    told = meta.sparkSession.createDataFrame(fixed, "same long, crc long, size long, home int, pieces long")
    piece = F.pmod(F.xxhash64("row"), F.coalesce("pieces", F.lit(1)))
    rows = written(meta.join(F.broadcast(told), group, "left").withColumn("piece", piece))
    units = rows.where("home IS NULL").groupBy(*group, "piece").agg(F.sum(F.col("size")).alias("weight"), *(F.min(f"d{i}").alias(f"d{i}") for i in range(n)))
    tie = F.xxhash64(*group, "piece").bitwiseAND(F.lit((1 << 32) - 1))
    keys = []
    for i in range(n):
        low, high = spans[f"min(d{i})"], spans[f"max(d{i})"]
        part = F.floor((F.col(f"d{i}") - F.lit(low)) / F.lit((high - low) or 1.0) * ((1 << BITS) - 1)) if low is not None else F.lit(0)
        keys.append((F.coalesce(part, F.lit(0)).cast("long") * F.lit(1 << 32) + tie).alias(f"k{i}"))
    placed = written(units.select(*group, "piece", "weight", *keys, F.lit(0).alias("first"), F.lit(shards).alias("span")))
    drop(meta)
    while True:
        cuts = _cuts(placed, n, room)
        if not cuts:
            break
        # the cuts are one row a node, of which there are fewer than shards
        at = placed.sparkSession.createDataFrame(cuts, "first int, dim int, cut long, lefts int")
        joined = placed.join(F.broadcast(at), "first", "left")
        left = F.coalesce(_pick("dim", n) <= F.col("cut"), F.lit(False))
        first = F.when(F.col("cut").isNull() | left, F.col("first")).otherwise(F.col("first") + F.col("lefts"))
        span = F.when(F.col("cut").isNull(), F.col("span")).when(left, F.col("lefts")).otherwise(F.col("span") - F.col("lefts"))
        after = written(joined.select(*group, "piece", "weight", *(f"k{i}" for i in range(n)), first.alias("first"), span.alias("span")))
        drop(placed)
        placed = after
    # rows of a placed group know their shard; the others are at most a piece, or a small group, to a key
    found = rows.where("home IS NULL").join(placed.select(*group, "piece", "first"), [*group, "piece"]).select("id", "size", "crc", "row", "first")
    found = found.unionByName(rows.where("home IS NOT NULL").select("id", "size", "crc", "row", F.col("home").alias("first")))
    return _slots(found).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("first").alias("shard"), "slot")


def _pick(dim: str, n: int) -> Column:
    out = F.when(F.col(dim) == 0, F.col("k0"))
    for i in range(1, n):
        out = out.when(F.col(dim) == i, F.col(f"k{i}"))
    return out


def _cuts(placed: DataFrame, n: int, room: list[float]) -> list[tuple[int, int, int, int]]:
    """``room`` is what each shard has left.  For each node that is to be split: its first shard, dimension, largest key of the left side, shards of the left side."""
    spread = [F.shiftright(F.max(f"k{i}"), 32) - F.shiftright(F.min(f"k{i}"), 32) for i in range(n)]
    nodes = placed.where("span > 1").groupBy("first", "span").agg(F.sum("weight").alias("bytes"), F.array(*spread).alias("spread")).collect()
    if not nodes:
        return []
    dims = {r["first"]: max(range(n), key=lambda i, r=r: (r["spread"][i], -i)) for r in nodes}
    lefts = {r["first"]: r["span"] // 2 for r in nodes}
    share = lambda f, m, k: sum(room[f : f + m]) / (sum(room[f : f + k]) or 1.0)
    want = {r["first"]: r["bytes"] * share(r["first"], lefts[r["first"]], r["span"]) for r in nodes}
    found = dict.fromkeys(want, 0)
    spark = placed.sparkSession
    dim_of = spark.createDataFrame(list(dims.items()), "first int, dim int")
    rows = placed.where("span > 1").join(F.broadcast(dim_of), "first").select("first", "weight", _pick("dim", n).alias("key"))
    for shift in (48, 32, 16, 0):
        above = spark.createDataFrame([(f, found[f], float(want[f])) for f in want], "first int, found long, want double")
        inside = rows.join(F.broadcast(above), "first")
        if shift < 48:  # a shift by 64 would be none
            inside = inside.where(F.shiftright("key", shift + 16) == F.col("found"))
        counts = inside.groupBy("first", "want", F.shiftright("key", shift).bitwiseAND(F.lit(0xFFFF)).alias("bucket")).agg(F.sum("weight").alias("bytes"))
        order = Window.partitionBy("first").orderBy("bucket")
        run = counts.withColumn("upto", F.sum("bytes").over(order))
        # the first bucket that reaches the wanted bytes; at the last 16 bits the nearer of it and the one before
        near = F.col("upto") >= F.col("want") if shift else F.col("upto") - F.col("bytes") / 2 >= F.col("want")
        hit = run.groupBy("first").agg(F.min(F.when(near, F.struct("bucket", "upto", "bytes"))).alias("hit"), F.max(F.struct("bucket", "upto", "bytes")).alias("last")).collect()
        for r in hit:
            x = r["hit"] or r["last"]
            before = x["upto"] - x["bytes"]
            if shift:
                found[r["first"]] = found[r["first"]] << 16 | x["bucket"]
                want[r["first"]] -= before
            else:  # keys up to the one before the bucket go left
                last = x["bucket"] if not r["hit"] else x["bucket"] - 1
                found[r["first"]] = (found[r["first"]] << 16) + last
    return [(f, dims[f], found[f], lefts[f]) for f in want]


def _slots(found: DataFrame) -> DataFrame:
    placed = written(found)
    chunks = max(1, -(-placed.count() // CHUNK_ROWS))
    chunked = placed.withColumn("tie", F.xxhash64("row")).withColumn("chunk", F.pmod("tie", F.lit(chunks)))
    sizes = chunked.groupBy("first", "chunk").agg(F.count(F.lit(1)).alias("n"))
    start = sizes.withColumn("start", F.sum("n").over(Window.partitionBy("first").orderBy("chunk")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("first", "chunk").orderBy("tie"))
    return chunked.withColumn("rank", rank).join(start, ["first", "chunk"]).withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long"))
