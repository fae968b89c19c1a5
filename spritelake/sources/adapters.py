"""Rasters, boards, datasets, manifests and keyframes derived from the analytic tables.

A vector of 64 numbers is read as an 8 x 8 image, so every raster operator has input at any
scale.  Images are *packed*, one row each with an array for each channel, or *exploded*, one
row a pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 8
#: Pixels are opaque above these values; see the tests for what each is good for.
DENSE, MEDIUM, SPARSE, OPAQUE = -0.1, 0.1, 0.2, -1e9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(spark: SparkSession, sf_dir: str, threshold: float | Column) -> DataFrame:
    """frame, clip, w, h and arrays r, g, b, a in row order; the threshold may depend on the frame."""
    base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").alias("clip"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    q = F.transform("v", lambda v: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (v + 1) * 128))).cast("int"))
    base = base.withColumn("r", q)
    shifted = lambda n, by: F.transform("r", lambda x, i: F.least(F.lit(255), x + (i % n) * by))
    return base.select("frame", "clip", F.lit(SIDE).alias("w"), F.lit(SIDE).alias("h"), "r", shifted(3, 6).alias("g"), shifted(5, 8).alias("b"), F.transform("v", lambda v: F.when(v > threshold, 255).otherwise(0)).alias("a"))


def exploded(frames: DataFrame) -> DataFrame:
    """frame, clip, i, x, y, r, g, b, a."""
    zipped = frames.select("frame", "clip", "w", F.posexplode(F.arrays_zip("r", "g", "b", "a")).alias("i", "p"))
    return zipped.select("frame", "clip", "i", (F.col("i") % F.col("w")).alias("x"), F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), "p.r", "p.g", "p.b", "p.a")


def pixels(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    return exploded(packed(spark, sf_dir, threshold))


def boards(spark: SparkSession, sf_dir: str, threshold: float | Column) -> DataFrame:
    """Nine frames as a board of 3 x 3 cells: adds board and cell, from the frame's number alone."""
    return packed(spark, sf_dir, threshold).select("*", F.floor(F.col("frame") / 9).cast("int").alias("board"), (F.col("frame") % 9).cast("int").alias("cell"))


GROUND, DRIFTED, GUIDE = 0xC8D2DC, 0xE6F0FA, 0x46688A


def board_triples(spark: SparkSession, sf_dir: str, threshold: float | Column) -> DataFrame:
    """Whole boards for grading: board, w, h, frames, given, target, made.

    Seven poses follow the identity, the last cell is empty.  Inputs show guides for poses.  What is
    made depends on the board's number: the target (0), a cell lacking (1), the input (2), another
    background (3), other colours of the identity (4), an unused cell filled (5), a cell flooded (6)
    or turned about (7).
    """
    cells = boards(spark, sf_dir, threshold).groupBy("board").agg(F.sort_array(F.collect_list(F.struct("cell", "r", "g", "b", "a"))).alias("c")).where(F.size("c") == 9)  # nine rows a board
    side = 3 * SIDE
    places = F.sequence(F.lit(0), F.lit(side * side - 1))
    cell = lambda p: F.floor(p / side / SIDE).cast("int") * 3 + F.floor(p % side / SIDE).cast("int")
    inner = lambda p: F.floor(p / side).cast("int") % SIDE * SIDE + p % SIDE

    def colour(k: Column, i: Column, other: Column | None = None) -> Column:
        of = lambda c: F.get(F.col("c")[k][c], i)
        shown = F.shiftleft(of("r"), 16) + F.shiftleft(of("g"), 8) + of("b")
        return F.when(of("a") > 20, shown if other is None else F.when(k > 0, other).otherwise(shown)).otherwise(F.lit(GROUND))

    empty = lambda k, x: F.when(k == 8, F.lit(GROUND)).otherwise(x)
    image = lambda f: F.transform(places, lambda p: f(cell(p), inner(p)))
    kind = F.pmod("board", F.lit(8))

    def made(k: Column, i: Column) -> Column:
        target, guide = empty(k, colour(k, i)), empty(k, colour(k, i, F.lit(GUIDE)))
        clear = target == GROUND
        return (
            F.when((kind == 1) & (k == 2), F.lit(GROUND)).when(kind == 2, guide).when((kind == 3) & clear, F.lit(DRIFTED)).when((kind == 4) & (k == 0) & ~clear, F.lit(0xFFFFFF) - target)
            .when((kind == 5) & (k == 8), colour(k, i)).when((kind == 6) & (k == 1), F.lit(0)).when((kind == 7) & (k == 3), colour(k, F.lit(SIDE * SIDE - 1) - i)).otherwise(target)
        )

    return cells.select("board", F.lit(side).alias("w"), F.lit(side).alias("h"), F.lit(7).alias("frames"), image(lambda k, i: empty(k, colour(k, i, F.lit(GUIDE)))).alias("given"), image(lambda k, i: empty(k, colour(k, i))).alias("target"), image(made).alias("made"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset rows: sample, character, split, pixel_hash, prompt; the last source by name is held out."""
    docs = table(spark, sf_dir, "documents")
    last = docs.agg(F.max("source").alias("last"))
    return docs.crossJoin(F.broadcast(last)).select(  # one row
        F.col("doc_id").alias("sample"), F.col("source").alias("character"), F.when(F.col("source") == F.col("last"), "validation").otherwise("train").alias("split"), F.sha2(F.col("text").cast("binary"), 256).alias("pixel_hash"), F.col("lang").alias("direction")
    )


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of keys from events: joint is the user, t the time from 0 to 1 between its first and last event."""
    per = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    e = e.withColumn("first", F.min("us").over(per)).withColumn("last", F.max("us").over(per))
    t = F.when(F.col("last") > F.col("first"), (F.col("us") - F.col("first")) / (F.col("last") - F.col("first"))).otherwise(F.lit(0.0))
    k = F.row_number().over(per.orderBy("us", "event_id"))
    return e.select(F.col("user_id").alias("joint"), k.alias("k"), t.alias("t"), "value")
