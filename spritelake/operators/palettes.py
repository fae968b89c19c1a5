"""One palette for all frames of a clip: median cut over a colour histogram, box by box as a table.

The histogram combines before its shuffle and holds a row a colour.  At each level every box is
summed to at most 256 values a channel, so cuts come from small groups however many colours or
pixels a box holds; the boxes are written between levels.  Nothing reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import drop, written


def histogram(pixels: DataFrame, group: str = "clip", threshold: int = 20) -> DataFrame:
    """Opaque pixels of each colour of each group; fully clear ones, and null colours, are none."""
    return pixels.where((F.col("a") > threshold) & F.col("r").isNotNull()).groupBy(group, "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))


def _cuts(boxes: DataFrame, group: str) -> DataFrame:
    """channel and cut of each box of several colours: its widest channel at the weighted median, so
    that both sides have colours."""
    values = boxes.select(group, "box", "n", F.posexplode(F.array("r", "g", "b")).alias("channel", "v"))
    bins = values.groupBy(group, "box", "channel", "v").agg(F.sum("n").alias("n"))
    of = Window.partitionBy(group, "box", "channel")
    seen = bins.select(group, "box", "channel", "v", F.sum("n").over(of.orderBy("v")).alias("below"), F.sum("n").over(of).alias("total"), F.max("v").over(of).alias("top"), F.min("v").over(of).alias("low"))
    middle, under = F.min(F.when(F.col("below") * 2 >= F.col("total"), F.col("v"))), F.max(F.when(F.col("v") < F.col("top"), F.col("v")))
    per = seen.groupBy(group, "box", "channel").agg(F.first(F.col("top") - F.col("low")).alias("range"), F.least(middle, under).alias("cut"))
    best = per.where("range > 0").groupBy(group, "box").agg(F.max(F.struct("range", -F.col("channel"), "cut")).alias("x"))
    return best.select(group, "box", (-F.col("x.col2")).alias("channel"), "x.cut")


def median_cut(colours: DataFrame, k: int, group: str = "clip") -> DataFrame:
    """The histogram's rows with their ``box``, for groups of more than ``k`` colours; at most ``k`` boxes a group.

    ``k`` below 2 is an error.  Groups of up to ``k`` colours need no palette and have no rows.
    """
    if k < 2:
        raise ValueError("a palette has two colours at least")
    many = colours.groupBy(group).agg(F.count(F.lit(1)).alias("colours")).where(F.col("colours") > k)
    boxes = written(colours.join(many.select(group), group, "left_semi").withColumn("box", F.lit(1).cast("long")))
    for _ in range(k.bit_length() - 1):
        value = F.when(F.col("channel") == 0, F.col("r")).when(F.col("channel") == 1, F.col("g")).otherwise(F.col("b"))
        side = F.when(value > F.col("cut"), 1).otherwise(0)
        after = written(boxes.join(_cuts(boxes, group), [group, "box"], "left").select(group, "r", "g", "b", "n", (F.col("box") * 2 + side).alias("box")))
        drop(boxes)
        boxes = after
    return boxes


def shared_palette(colours: DataFrame, k: int, group: str = "clip") -> DataFrame:
    """entry, r, g, b of each group's palette: the means of its boxes, numbered in their order."""
    mean = lambda c: F.floor(F.sum(F.col(c) * F.col("n")) / F.sum("n") + 0.5).cast("int").alias(c)
    boxes = median_cut(colours, k, group).groupBy(group, "box").agg(*map(mean, "rgb"), F.sum("n").alias("pixels"))
    return boxes.select(group, (F.row_number().over(Window.partitionBy(group).orderBy("box")) - 1).alias("entry"), "r", "g", "b", "pixels")


def _nearest(r: Column, g: Column, b: Column) -> Column:
    """The entry of the row's ``palette`` at the least squared distance, the first of equals."""
    far = lambda p: (p["r"] - r) * (p["r"] - r) + (p["g"] - g) * (p["g"] - g) + (p["b"] - b) * (p["b"] - b)
    return F.array_min(F.transform("palette", lambda p: F.struct(far(p).alias("far"), p["entry"].alias("entry"), p["r"].alias("r"), p["g"].alias("g"), p["b"].alias("b"))))


def recoloured(pixels: DataFrame, palette: DataFrame, group: str = "clip") -> DataFrame:
    """Pixels with the nearest colour of their group's palette; groups without one, and alpha, stay.

    Each different colour is looked up once; pixels meet the answers by an equi-join, which
    combines a hot group's colours with their pixels on group and colour, not on the group alone.
    """
    entries = palette.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("entry", "r", "g", "b"))).alias("palette"))  # at most k
    found = pixels.select(group, "r", "g", "b").distinct().join(entries, group).withColumn("near", _nearest(F.col("r"), F.col("g"), F.col("b"))).select(group, "r", "g", "b", "near")
    rest = [c for c in pixels.columns if c not in ("r", "g", "b")]
    return pixels.join(found, [group, "r", "g", "b"], "left").select(*rest, *(F.coalesce(f"near.{c}", F.col(c)).alias(c) for c in "rgb")).select(pixels.columns)
