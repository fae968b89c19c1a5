"""One picture's parts as rows: masked crops that reach to their pivots, and how well they make the picture again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def foreground(pixels: DataFrame, image: str = "frame", cleaned: str = "clean_a") -> DataFrame:
    """Opaque pixels of pictures: by their own alpha where any of it is below 255, else by that of the column ``cleaned``
    (the picture with its background taken off)."""
    own = pixels.groupBy(image).agg(F.bool_or(F.col("a") < 255).alias("clear"))
    return pixels.join(own, image).where(F.when(F.col("clear"), F.col("a") > 0).otherwise(F.col(cleaned) > 0)).drop("clear")


def world_point(low: Column, high: Column, share: Column) -> Column:
    """The pixel at a share of a side from ``low`` to ``high`` (outside), rounded half to even."""
    return F.bround(low + (high - low - 1) * share).cast("int")


def cut_parts(pixels: DataFrame, pivots: DataFrame, image: str = "frame") -> DataFrame:
    """image, part, left, top, right, bottom, pivot_x, pivot_y, pixels: boxes of labelled pixels (image, part, x, y), grown to
    their pivots; these are given as shares of the whole figure's box (part, share_x, share_y) and returned within the part's.

    Parts without pixels have no rows, nor have parts without a pivot.
    """
    figure = pixels.groupBy(image).agg(F.min("x").alias("fx0"), F.min("y").alias("fy0"), (F.max("x") + 1).alias("fx1"), (F.max("y") + 1).alias("fy1"))
    own = pixels.groupBy(image, "part").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.count(F.lit(1)).alias("pixels"))
    rows = own.join(figure, image).join(pivots, "part").withColumns({"px": world_point(F.col("fx0"), F.col("fx1"), F.col("share_x")), "py": world_point(F.col("fy0"), F.col("fy1"), F.col("share_y"))})
    rows = rows.withColumns({"left": F.least("x0", "px"), "top": F.least("y0", "py"), "right": F.greatest("x1", F.col("px") + 1), "bottom": F.greatest("y1", F.col("py") + 1)})
    return rows.select(image, "part", "left", "top", "right", "bottom", (F.col("px") - F.col("left")).alias("pivot_x"), (F.col("py") - F.col("top")).alias("pivot_y"), "pixels")


def rest_overlap(source: DataFrame, pixels: DataFrame, parts: DataFrame, image: str = "frame") -> DataFrame:
    """image, iou of the figure that the ``parts`` (image, part, left, top, right, bottom) make at rest, from their labelled
    ``pixels``, with its ``source`` (image, x, y); 1 where both are empty."""
    inside = (F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom"))
    again = pixels.join(parts, [image, "part"]).where(inside).select(image, "x", "y").distinct().withColumn("again", F.lit(1))
    both = source.select(image, "x", "y").distinct().withColumn("was", F.lit(1)).join(again, [image, "x", "y"], "full")
    either = F.count(F.lit(1))
    return both.groupBy(image).agg((F.sum(F.coalesce("was", F.lit(0)) * F.coalesce("again", F.lit(0))) / either).alias("iou"))
