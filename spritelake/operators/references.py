"""Reference pictures: whether one can be used as it is, one put on a background, and parts with too many holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import assembly, regions


def usable(packed: DataFrame, most_side: int = 512, most_colours: int = 256, threshold: int = 20) -> DataFrame:
    """frame, side, clear, colours, usable: no side above the most, some pixel below full alpha, and 1 to so many colours."""
    opaque = F.filter(F.arrays_zip("r", "g", "b", "a"), lambda p: p["a"] > threshold)
    colours = F.size(F.array_distinct(F.transform(opaque, lambda p: p["r"] * 65536 + p["g"] * 256 + p["b"])))
    rows = packed.select("frame", F.greatest("w", "h").alias("side"), F.exists("a", lambda a: a < 255).alias("clear"), colours.alias("colours"))
    return rows.withColumn("usable", (F.col("side") <= most_side) & F.col("clear") & F.col("colours").between(1, most_colours))


def on_background(packed: DataFrame, canvas: tuple[int, int], fill: float = 0.94, background: tuple[int, int, int] = (236, 244, 241)) -> DataFrame:
    """Frames by the nearest pixel at ``fill`` of a canvas, 0.1 to 1 of it, in the middle of a background of one colour.

    frame, clip, w, h, r, g, b, a and name, ``reference-`` and the first 16 digits of the digest of all pixels.  Colours of the background are
    held within 0 to 255.
    """
    w, h = canvas
    if w <= 0 or h <= 0:
        raise ValueError("a canvas has sides above 0")
    share = max(0.1, min(1.0, fill))
    scale = F.least(F.lit(w * share) / F.col("w"), F.lit(h * share) / F.col("h"))
    target = lambda c: F.when(F.abs(scale - 1) > 1e-9, F.greatest(F.lit(1), F.bround(F.col(c) * scale).cast("int"))).otherwise(F.col(c))
    places = packed.select("frame", "clip", F.lit(w).alias("canvas_w"), F.lit(h).alias("canvas_h"), target("w").alias("target_w"), target("h").alias("target_h"))
    places = places.withColumns({"left": F.floor((F.col("canvas_w") - F.col("target_w")) / 2).cast("int"), "top": F.floor((F.col("canvas_h") - F.col("target_h")) / 2).cast("int")})
    drawn = assembly.redrawn(packed, places)

    def over(c: str, ground: int) -> Column:
        return F.zip_with(c, "a", lambda x, a: F.floor((x * a + ground * (255 - a)) / 255 + 0.5).cast("int"))

    colours = {c: over(c, max(0, min(255, g))) for c, g in zip("rgb", background, strict=True)}
    done = drawn.select("frame", "clip", "w", "h", *(v.alias(c) for c, v in colours.items()), F.transform("a", lambda _: F.lit(255)).alias("a"))
    two = lambda x: F.lpad(F.hex(x), 2, "0")
    raw = F.unhex(F.array_join(F.transform(F.arrays_zip("r", "g", "b"), lambda p: F.concat(two(p["r"]), two(p["g"]), two(p["b"]), F.lit("FF"))), ""))
    return done.withColumn("name", F.concat(F.lit("reference-"), F.substring(F.sha2(raw, 256), 1, 16)))


def hole_offenders(packed: DataFrame, most: int, owner: str = "clip", part: str = "frame") -> DataFrame:
    """owner, parts, pixels, told: owners of parts whose enclosed clear pixels are more than ``most``, and those parts in
    the order of their names, as ``part=pixels px in regions``."""
    clear = packed.withColumn("mask", F.transform("a", lambda a: a <= 20)).withColumn("image", F.struct(owner, part, "w", "h"))
    found = regions.measured(regions.regions(regions.runs(clear, "image")))
    inner = regions.touching(found, F.col("image.w"), F.col("image.h")).where(~F.col("edge"))
    per = inner.groupBy(f"image.{owner}", f"image.{part}").agg(F.sum("area").alias("pixels"), F.count(F.lit(1)).alias("regions")).where(F.col("pixels") > most)
    one = F.struct(F.col(part).alias("part"), F.concat(F.col(part).cast("string"), F.lit("="), F.col("pixels").cast("string"), F.lit(" px in "), F.col("regions").cast("string")).alias("told"))
    return per.groupBy(owner).agg(F.count(F.lit(1)).alias("parts"), F.sum("pixels").alias("pixels"), F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["told"]), ", ").alias("told"))


def first_rows(rows: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first ``n`` rows in order, all without ``n``; fewer rows than that are an error when they are read."""
    if n is None:
        return rows
    if n < 1:
        raise ValueError("a limit is 1 or more")
    held = rows.limit(n).agg(F.count(F.lit(1)).alias("held"))
    enough = held.select(F.when(F.col("held") == n, True).otherwise(F.raise_error(F.lit("fewer rows than the limit")).cast("boolean")).alias("enough"))
    return rows.orderBy(*order).limit(n).join(F.broadcast(enough), how="cross").where("enough").drop("enough")  # one row
