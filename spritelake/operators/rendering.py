"""Pictures from layers, and clips from posed parts, as tables: compositing in ordered segments, rendering in two passes.

*Compositing.*  Alpha-over on premultiplied colours is associative, so an image's layers, numbered
by their order, are folded ``SEGMENT`` at a time, the results again, until one is left.  No
group holds more layers than that, however many an image has.

*Rendering.*  The first pass composes every frame on a canvas with room around it and keeps its box; frames of
grounded clips are shifted so that their lowest row is that of the reference frame, and what breaks a gate is a
row.  The second pass cuts all frames of all clips by one box, so nothing jumps from clip to clip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import drop, written
from .ordinals import ordinals

SEGMENT = 16


def _over(below: Column, above: Column) -> Column:
    """A premultiplied pixel over another; alpha is from 0 to 1."""
    left = 1 - above["a"]
    return F.struct(*((above[c] + below[c] * left).alias(c) for c in "rgba"))


def composited(layers: DataFrame, image: list[str], order: list[str], segment: int = SEGMENT) -> DataFrame:
    """The image columns, x, y, r, g, b, a of layers' pixels (with those columns and those of ``order``) put over each other.

    Layers lie in ``order``, the last on top; layers equal in it are one, whose pixels at one place lie in order of
    their colours.  Channels are from 0 to 255 and come back rounded.  Clear pixels, and places without others, have no rows.
    """
    alpha = F.col("a") / F.lit(255.0)
    pixel = F.struct(*((F.col(c) * alpha).alias(c) for c in "rgb"), alpha.alias("a"))
    rows = layers.where("a > 0").select(*image, "x", "y", F.struct(*order).alias("key"), pixel.alias("p"))
    numbers = ordinals(rows.select(*image, "key").distinct(), ["key"], image, "z", "layers")
    most = numbers.agg(F.max("layers")).first()[0] or 0
    rows = rows.join(numbers.select(*image, "key", "z"), [*image, "key"]).select(*image, "x", "y", "z", "p")
    clear = F.struct(*(F.lit(0.0).alias(c) for c in "rgba"))
    held: list[DataFrame] = []
    while True:
        pile = F.transform(F.array_sort(F.collect_list(F.struct("z", "p"))), lambda e: e["p"])  # a segment
        rows = rows.groupBy(*image, "x", "y", F.floor(F.col("z") / segment).alias("z")).agg(F.aggregate(pile, clear, _over).alias("p"))
        most = -(-most // segment)
        if most <= 1:
            break
        rows = written(rows)
        drop(*held)
        held = [rows]
    whole = lambda c: F.floor(c + 0.5).cast("int")
    return rows.select(*image, "x", "y", *(whole(F.col(f"p.{c}") / F.col("p.a")).alias(c) for c in "rgb"), whole(F.col("p.a") * 255.0).alias("a"))


def posed(parts: DataFrame, poses: DataFrame) -> DataFrame:
    """Pixels of parts (part, x, y, r, g, b, a) where each pose (clip, i, part, z, dx, dy) puts them."""
    return parts.join(poses, "part").select("clip", "i", "z", "part", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "r", "g", "b", "a")


def boxes(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """clip, i and the box (x0, y0, x1, y1, ends outside) of each of ``frames`` (clip, i); null for frames without pixels."""
    found = pixels.groupBy("clip", "i").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    return frames.select("clip", "i").distinct().join(found, ["clip", "i"], "left")


def grounded(measured: DataFrame, clips: DataFrame, reference: tuple, height: int) -> DataFrame:
    """Boxes with ``shift``: how far down a frame of a grounded clip (clip, grounded) goes so that its lowest row is
    the reference frame's (clip, i), and the rows (top, bottom) that its box then has on the canvas.

    A reference that is empty or isn't there is an error when the rows are read.
    """
    of = measured.where((F.col("clip") == F.lit(reference[0])) & (F.col("i") == reference[1])).agg(F.max("y1").alias("ground"))
    ground = of.select(F.when(F.col("ground").isNotNull(), F.col("ground")).otherwise(F.raise_error(F.lit("the reference frame is empty")).cast("int")).alias("ground"))
    rows = measured.join(clips.select("clip", "grounded"), "clip", "left").join(F.broadcast(ground), how="cross")  # one row
    rows = rows.withColumn("shift", F.when(F.col("grounded") & F.col("y1").isNotNull(), F.col("ground") - F.col("y1")).otherwise(0))
    there = lambda c: F.when(F.col("y0").isNotNull(), c)  # noqa: E731  the least of null and a number is the number
    return rows.withColumns({"top": there(F.greatest(F.lit(0), F.col("y0") + F.col("shift"))), "bottom": there(F.least(F.lit(height), F.col("y1") + F.col("shift")))}).drop("ground")


def gate_faults(locked: DataFrame, canvas: tuple[int, int], keep: tuple[int, int, int, int] | None = None) -> DataFrame:
    """clip, i, rule, told: empty frames, frames that touch the canvas (edge), that do so once grounded (ground), and, if
    the box ``keep`` is to be kept, by how many pixels frames leave it (overflow)."""
    w, h = canvas
    edge = (F.col("x0") <= 0) | (F.col("y0") <= 0) | (F.col("x1") >= w) | (F.col("y1") >= h)
    ground = (F.col("shift") != 0) & ((F.col("top") <= 0) | (F.col("bottom") >= h))
    rules = [("empty", F.col("x0").isNull(), F.lit("")), ("edge", edge, F.lit("")), ("ground", ground, F.col("shift").cast("string"))]
    if keep:
        beyond = {"left": keep[0] - F.col("x0"), "top": keep[1] - F.col("top"), "right": F.col("x1") - keep[2], "bottom": F.col("bottom") - keep[3]}
        told = F.concat_ws(", ", *(F.when(n > 0, F.concat(F.lit(f"{s}="), n.cast("string"), F.lit("px"))) for s, n in beyond.items()))
        rules.append(("overflow", told != "", told))
    found = F.array_compact(F.array(*(F.when(broken, F.struct(F.lit(n).alias("rule"), t.alias("told"))) for n, broken, t in rules)))
    return locked.select("clip", "i", F.explode(found).alias("x")).select("clip", "i", "x.*")


def crop(locked: DataFrame, reference: tuple, canvas: tuple[int, int], keep: tuple[int, int, int, int] | None = None) -> DataFrame:
    """One row: the box that all frames are cut by (left, top, right, bottom), the reference frame's foot and the bounds of
    all content within it.  Without ``keep`` it is the union of all boxes and a padding of 3.5 % of its longer side,
    2 pixels at least, within the canvas."""
    is_reference = (F.col("clip") == F.lit(reference[0])) & (F.col("i") == reference[1])
    facts = locked.agg(F.min("x0").alias("u0"), F.min("top").alias("v0"), F.max("x1").alias("u1"), F.max("bottom").alias("v1"), *(F.max(F.when(is_reference, F.col(c))).alias(f"r_{c}") for c in ("x0", "x1", "y1")))
    pad = F.greatest(F.lit(2), F.bround(F.greatest(F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0")) * F.lit(0.035)).cast("int"))
    sides = [F.lit(k) for k in keep] if keep else [F.greatest(F.lit(0), F.col("u0") - pad), F.greatest(F.lit(0), F.col("v0") - pad), F.least(F.lit(canvas[0]), F.col("u1") + pad), F.least(F.lit(canvas[1]), F.col("v1") + pad)]
    rows = facts.withColumns(dict(zip(("left", "top", "right", "bottom"), sides, strict=True)))
    foot = {"anchor_x": F.floor((F.col("r_x0") + F.col("r_x1") - 1) / 2).cast("int") - F.col("left"), "anchor_y": F.col("r_y1") - 1 - F.col("top")}
    content = {"content_x0": F.col("u0") - F.col("left"), "content_y0": F.col("v0") - F.col("top"), "content_x1": F.col("u1") - F.col("left"), "content_y1": F.col("v1") - F.col("top")}
    return rows.select("left", "top", "right", "bottom", *(c.alias(n) for n, c in (foot | content).items()))


def cut(pixels: DataFrame, locked: DataFrame, by: DataFrame) -> DataFrame:
    """Pixels of all frames, shifted to the ground and cut by the one box of ``crop``."""
    rows = pixels.join(locked.select("clip", "i", "shift"), ["clip", "i"]).join(F.broadcast(by), how="cross")  # one row
    rows = rows.withColumn("y", F.col("y") + F.col("shift")).where((F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom")))
    return rows.select("clip", "i", (F.col("x") - F.col("left")).alias("x"), (F.col("y") - F.col("top")).alias("y"), "r", "g", "b", "a", (F.col("right") - F.col("left")).alias("w"), (F.col("bottom") - F.col("top")).alias("h"))
