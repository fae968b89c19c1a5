"""Operators on rasters that built-in expressions carry: measures, masks, edges, palettes, boards.

Packed operators work within a row by higher-order functions and never shuffle.  Exploded ones
aggregate by frame, clip or cell with partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .ordinals import ordinals

AROUND = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]


def at(channel: str, x: Column, y: Column) -> Column:
    """A packed channel at (x, y); null outside the canvas."""
    inside = (x >= 0) & (y >= 0) & (x < F.col("w")) & (y < F.col("h"))
    return F.when(inside, F.get(F.col(channel), y * F.col("w") + x))


def _places() -> Column:
    return F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)


def _x(i: Column) -> Column:
    return (i % F.col("w")).cast("int")


def _y(i: Column) -> Column:
    return F.floor(i / F.col("w")).cast("int")


def frame_metrics(packed: DataFrame, threshold: int = 20) -> DataFrame:
    """Half-open box, size, foot point, opaque pixels and distinct opaque colours of each frame with any, within the row."""
    found = F.filter(_places(), lambda i: F.get(F.col("a"), i) > threshold)
    # a place's x and y lie in one number, so one pass finds each extreme
    ys = F.transform(F.array(F.array_min(found), F.array_max(found)), _y)
    xs = F.transform(found, _x)
    colours = F.array_distinct(F.transform(found, lambda i: F.get(F.col("r"), i) * 65536 + F.get(F.col("g"), i) * 256 + F.get(F.col("b"), i)))
    out = packed.where(F.exists("a", lambda a: a > threshold)).select("frame", "clip", F.array_min(xs).alias("x0"), ys[0].alias("y0"), (F.array_max(xs) + 1).alias("x1"), (ys[1] + 1).alias("y1"), F.size(found).cast("long").alias("opaque"), F.size(colours).cast("long").alias("colors"))
    return out.select("frame", "clip", "x0", "y0", "x1", "y1", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), F.floor((F.col("x0") + F.col("x1") - 1) / 2).cast("int").alias("foot_x"), (F.col("y1") - 1).alias("foot_y"), "opaque", "colors")


def boxes(packed: DataFrame, threshold: int = 20) -> DataFrame:
    """The same box within the row, without a shuffle; null where nothing is opaque."""
    found = F.filter(_places(), lambda i: F.get(F.col("a"), i) > threshold)
    xs, ys = F.transform(found, _x), F.transform(found, _y)
    box = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), (F.array_max(xs) + 1).alias("x1"), (F.array_max(ys) + 1).alias("y1"))
    return packed.withColumn("box", F.when(F.size(found) > 0, box)).withColumn("opaque", F.size(found).cast("long"))


def alpha_counts(pixels: DataFrame, alpha: str, threshold: int) -> DataFrame:
    hard = C.hardened(F.col(alpha), threshold)
    return pixels.groupBy("clip").agg(F.count_if(hard == 255).alias("opaque"), F.count_if(hard == 0).alias("transparent"))


def corner_colour(pixels: DataFrame, side: int) -> DataFrame:
    """Median of each channel over a frame's four corners."""
    corners = pixels.where(F.col("x").isin(0, side - 1) & F.col("y").isin(0, side - 1))
    return corners.groupBy("frame").agg(*(F.median(c).alias(f"m{c}") for c in "rgb"))


def foreground(pixels: DataFrame, side: int, threshold: int) -> DataFrame:
    """Pixels farther than ``threshold`` from their frame's corner colour."""
    to = corner_colour(pixels, side)
    far = C.square_distance(F.col("r"), F.col("g"), F.col("b"), (F.col("mr"), F.col("mg"), F.col("mb")))
    return pixels.join(to, "frame").groupBy("frame").agg(F.count_if(far > threshold * threshold).alias("foreground"), F.max(far).alias("farthest_sq"))


def fringe(packed: DataFrame, least: int, most_spread: int, threshold: int = 20) -> DataFrame:
    """Neutral opaque pixels with a transparent neighbour; what is off the canvas isn't transparent."""

    def touches(i: Column) -> Column:
        out = F.lit(False)
        for dx, dy in AROUND:
            out = out | (F.coalesce(at("a", _x(i) + dx, _y(i) + dy), F.lit(255)) <= threshold)
        return out

    get = lambda c, i: F.get(F.col(c), i)
    hit = F.filter(_places(), lambda i: (get("a", i) > threshold) & C.neutral(get("r", i), get("g", i), get("b", i), least, most_spread) & touches(i))
    return packed.select("frame", "clip", F.size(hit).cast("long").alias("fringe"))


def dilated(i: Column, radius: int = 1, threshold: int = 20) -> Column:
    out = F.lit(False)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            out = out | (F.coalesce(at("a", _x(i) + dx, _y(i) + dy), F.lit(0)) > threshold)
    return out


def eroded(i: Column, radius: int = 1, threshold: int = 20) -> Column:
    out = F.lit(True)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            out = out & (F.coalesce(at("a", _x(i) + dx, _y(i) + dy), F.lit(0)) > threshold)
    return out


def pose_guide(packed: DataFrame) -> DataFrame:
    """Pixels of the silhouette and of the band between its dilation and erosion."""
    edge = F.filter(_places(), lambda i: dilated(i) & ~eroded(i))
    return packed.select("frame", F.size(F.filter("a", lambda a: a > 20)).cast("long").alias("silhouette"), F.size(edge).cast("long").alias("edge"), F.coalesce(F.aggregate(edge, F.lit(0).cast("long"), lambda s, i: s + i), F.lit(0).cast("long")).alias("edge_places"))


def mirrored(pixels: DataFrame, w: int) -> DataFrame:
    """Left and right exchanged, colours darkened, alpha kept."""
    return pixels.select("frame", (w - 1 - F.col("x")).alias("x"), "y", *(C.darkened(F.col(c)).alias(c) for c in "rgb"), "a")


def iou(a: Column, b: Column, threshold: int = 20) -> Column:
    """Intersection over union of two packed alpha channels; 1 where both are empty."""
    both = F.zip_with(a, b, lambda p, q: (p > threshold) & (q > threshold))
    either = F.zip_with(a, b, lambda p, q: (p > threshold) | (q > threshold))
    n = lambda x: F.size(F.filter(x, lambda v: v))
    return F.when(n(either) == 0, 1.0).otherwise(n(both) / n(either))


def consecutive_iou(packed: DataFrame) -> DataFrame:
    """Overlap of each frame's mask with the one before it in its clip.

    A clip may hold very many frames: their numbers come from range partitions, and each frame
    meets the one before it by clip and number, so no task sorts a clip's images.
    """
    seq = ordinals(packed.select("frame", "clip"), ["frame"], ["clip"], "seq").select("frame", (F.col("seq") + 1).cast("int").alias("seq"))
    rows = packed.select("frame", "clip", "a").join(seq, "frame")
    before = rows.select("clip", (F.col("seq") + 1).alias("seq"), F.col("a").alias("before"))
    return rows.join(before, ["clip", "seq"]).select("frame", "clip", "seq", iou(F.col("a"), F.col("before")).alias("iou"))


def union_box(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("clip").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("frames"))


def drift_ratio(value: str) -> Column:
    """(max - min) / median; 0 for fewer than two values or a median of 0."""
    few = (F.count(value) < 2) | (F.median(value) <= 0)
    return F.when(few, 0.0).otherwise((F.max(value) - F.min(value)) / F.median(value))


def clip_drift(metrics: DataFrame) -> DataFrame:
    foot = lambda c: (F.max(c) - F.min(c)).alias(f"{c}_drift")
    return metrics.groupBy("clip").agg(drift_ratio("h").alias("height_drift"), drift_ratio("w").alias("width_drift"), foot("foot_x"), foot("foot_y"))


def anchors(metrics: DataFrame) -> DataFrame:
    """Each frame's foot within the union of its clip's boxes."""
    return metrics.join(union_box(metrics).select("clip", F.col("x0").alias("ux0"), F.col("y0").alias("uy0"), F.col("x1").alias("ux1"), F.col("y1").alias("uy1")), "clip").select("frame", "clip", (F.col("foot_x") - F.col("ux0")).alias("anchor_x"), (F.col("foot_y") - F.col("uy0")).alias("anchor_y"), (F.col("ux1") - F.col("ux0")).alias("envelope_w"), (F.col("uy1") - F.col("uy0")).alias("envelope_h"))


def palette_gate(pixels: DataFrame, most: int, samples: int) -> DataFrame:
    """Distinct opaque colours of a clip among a stride sample in frame and pixel order.

    The stride is taken by each pixel's exact rank: frames are counted first, and a running sum
    over frames places each one, so no clip is ranked pixel by pixel in one task.
    """
    opaque = pixels.where("a > 20")
    counts = opaque.groupBy("clip", "frame").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.withColumn("start", F.sum("n").over(Window.partitionBy("clip").orderBy("frame")) - F.col("n"))
    totals = counts.groupBy("clip").agg(F.sum("n").alias("opaque"))
    rank = F.row_number().over(Window.partitionBy("clip", "frame").orderBy("i")) - 1 + F.col("start")
    step = F.greatest(F.lit(1), F.ceil(F.col("opaque") / samples).cast("long"))
    picked = opaque.join(starts, ["clip", "frame"]).join(totals, "clip").withColumn("rank", rank).where(F.pmod("rank", step) == 0)
    out = picked.groupBy("clip").agg(F.first("opaque").alias("opaque"), F.count(F.lit(1)).alias("sampled"), F.count_distinct(F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("colors"))
    return out.withColumn("needs_palette", F.col("colors") > most)


def mode_colour(packed: DataFrame, threshold: int = 20) -> DataFrame:
    """The colour (alpha included) most frequent among opaque pixels next to a transparent one; ties go to
    higher alpha, to higher brightness, then to the larger colour.  Only these pixels leave the row."""

    def beside(i: Column) -> Column:
        out = F.lit(False)
        for dx, dy in AROUND:
            out = out | (F.coalesce(at("a", _x(i) + dx, _y(i) + dy), F.lit(255)) <= threshold)
        return out

    edge = F.filter(_places(), lambda i: (F.get(F.col("a"), i) > threshold) & beside(i))
    pixel = F.transform(edge, lambda i: F.struct(*(F.get(F.col(c), i).alias(c) for c in "rgba")))
    counts = packed.select("frame", F.explode(pixel).alias("p")).groupBy("frame", "p").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct("n", "p.a", C.luma(F.col("p.r"), F.col("p.g"), F.col("p.b")).alias("l"), "p.r", "p.g", "p.b")
    return counts.groupBy("frame").agg(F.max(rank).alias("x")).select("frame", "x.r", "x.g", "x.b", "x.a", "x.n")


def nearest(r: Column, g: Column, b: Column, palette: list[tuple[int, int, int]]) -> Column:
    """Index of the palette's nearest colour, the first of equal ones; the palette is part of the expression."""
    ranked = [F.struct(C.square_distance(r, g, b, tuple(map(F.lit, p))).alias("d"), F.lit(k).alias("k")) for k, p in enumerate(palette)]
    return F.array_min(F.array(*ranked))["k"]


def longest_run(values: Column) -> Column:
    """Length of the longest run of true values."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, v: Column) -> Column:
        run = F.when(v, s["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(values, start, step, lambda s: s["best"])


def rows_of(packed: DataFrame, threshold: int = 20) -> DataFrame:
    """One row for each row of an image: its mask, opaque pixels and longest run."""
    cut = packed.select("frame", "clip", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"), "a")
    mask = F.transform(F.slice("a", F.col("y") * F.col("w") + 1, F.col("w")), lambda a: a > threshold)
    return cut.select("frame", "clip", "w", "y", mask.alias("mask")).select("frame", "clip", "w", "y", F.size(F.filter("mask", lambda v: v)).cast("long").alias("opaque"), longest_run(F.col("mask")).alias("longest"))


def islands(rows: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Runs of consecutive flagged rows: keys, first, last, length."""
    kept = rows.where(flag)
    group = F.col(order) - F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return kept.withColumn("_run", group).groupBy(*keys, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("_run")


def separator_bands(packed: DataFrame, coverage: float = 0.8, run: float = 0.4, thickest: int = 4) -> DataFrame:
    """Bands of at most ``thickest`` rows that are nearly full or hold a long run; thresholds are cut to whole pixels."""
    rows = rows_of(packed)
    flag = (F.col("opaque") >= F.floor(F.col("w") * coverage)) | (F.col("longest") >= F.floor(F.col("w") * run))
    return islands(rows, ["frame"], "y", flag).where(F.col("length") <= thickest)


def voronoi(pixels: DataFrame, seeds: list[tuple[str, float, float, float]]) -> DataFrame:
    """Opaque pixels by nearest weighted seed (name, x, y, weight): squared distance over squared weight, the first of equal ones."""
    score = [F.struct((((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)) / (w * w)).alias("d"), F.lit(k).alias("k"), F.lit(name).alias("part")) for k, (name, x, y, w) in enumerate(seeds)]
    return pixels.where("a > 20").withColumn("part", F.array_min(F.array(*score))["part"])


def board_cells(generated: DataFrame, target: DataFrame) -> DataFrame:
    """Opaque pixels, occupancy and overlap of each cell against the same cell of the target.

    Where the target is empty the occupancy is 1 for an empty cell and infinite for any other.
    """
    count = lambda c: F.size(F.filter(c, lambda v: v > 20)).cast("long")
    joined = generated.select("board", "cell", "a", count("a").alias("opaque")).join(target.select("board", "cell", F.col("a").alias("ta"), count("a").alias("wanted")), ["board", "cell"])
    occupancy = F.when(F.col("wanted") > 0, F.col("opaque") / F.col("wanted")).when(F.col("opaque") == 0, 1.0).otherwise(float("inf"))
    return joined.select("board", "cell", "opaque", occupancy.alias("occupancy"), iou(F.col("a"), F.col("ta")).alias("iou"))


def board_totals(cells: DataFrame) -> DataFrame:
    """Totals by board, shelf of 100 boards and overall in one pass."""
    return cells.withColumn("shelf", F.floor(F.col("board") / 100).cast("int")).rollup("shelf", "board").agg(F.sum("opaque").alias("opaque"), F.count(F.lit(1)).alias("cells"), F.min("iou").alias("least_iou"))


def grid_for(cells: int | Column, most: int = 12) -> Column:
    """The grid (columns, rows) of at least so many cells: the fewest, then the squarest, then the narrowest; 3 x 3 for 9."""
    grids = sorted((c * r, abs(c - r), c, r) for c in range(1, most + 1) for r in range(1, most + 1))
    best, k = [], 0
    for n in range(1, most * most + 1):  # all numbers of cells in one literal: a row looks its own up
        while grids[k][0] < n:
            k += 1
        best.append(grids[k])
    n = F.lit(cells) if not isinstance(cells, Column) else cells
    at = F.greatest(F.lit(0), F.ceil(n).cast("int") - 1)
    of = lambda k: F.get(F.expr(f"array({', '.join(str(b[k]) for b in best)})"), at)
    return F.when(n <= most * most, F.struct(*(of(k).alias(name) for k, name in enumerate(("cells", "skew", "columns", "rows")))))
