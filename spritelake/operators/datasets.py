"""Datasets of boards from a spec and its folders, and finished boards back to frames, each step a table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import written
from . import assembly, regions, specs
from . import sequences as S

IMAGE = ("w", "h", "r", "g", "b", "a")


class Dataset(NamedTuple):
    """faults: what is wrong with spec and folders (subject, rule, told); a dataset is good without any.  samples: sample,
    split, character, direction, clip.  boards: pixels of the input and target of each sample.  entries: each sample's place in its
    split, its prompt and the paths of its three files."""

    faults: DataFrame
    samples: DataFrame
    boards: DataFrame
    entries: DataFrame


def build(characters: DataFrame, files: DataFrame, validation: list[str], columns: int = 4, prompts: int = 8) -> Dataset:
    """The dataset that a spec asks for.

    characters: id, root, reference (a pattern), directions and clips as ``specs.expanded`` has them.  files: root, path, regular and a packed
    image (w, h, r, g, b, a).  Cell 0 of a board is the character's reference in that direction, then the clip's frames follow in natural order; names
    meet names first and only then their images.  ``validation`` names characters of that split, the others are train.
    """
    asked = specs.expanded(characters)
    names = files.select("root", "path", "regular")
    place = F.replace("reference", F.lit("{direction}"), F.col("direction"))
    wanted = characters.select("id", "root", "reference", F.explode("directions").alias("direction")).distinct().select(F.col("id").alias("character"), "direction", "root", specs.resolved(F.replace(place, F.lit("{clip}"), F.lit("reference"))).alias("path"))
    first = wanted.join(names.where("regular"), ["root", "path"], "left_semi")
    lost = wanted.join(first, ["character", "direction"], "left_anti").select(F.concat_ws("__", "character", "direction").alias("subject"), F.lit("reference").alias("rule"), F.coalesce("path", F.lit("")).alias("told"))
    faults = specs.spec_faults(characters, names).unionByName(lost)

    split = F.when(F.col("character").isin(validation), "validation").otherwise("train") if validation else F.lit("train")
    samples = asked.select("sample", split.alias("split"), "character", "direction", "clip").dropDuplicates(["sample"])
    order = Window.partitionBy("sample").orderBy(C.natural_key(F.col("file")), "file")  # a clip's frames: as many as a board has cells
    roots = asked.select("sample", "root").dropDuplicates(["sample"])
    poses = specs.matched(asked.dropDuplicates(["sample"]), names).where("regular").join(roots, "sample").select("sample", "root", F.col("file").alias("path"), F.row_number().over(order).alias("cell"))
    identity = samples.join(first, ["character", "direction"]).select("sample", "root", "path", F.lit(0).alias("cell"))
    cells = poses.unionByName(identity).join(files.select("root", "path", *IMAGE), ["root", "path"])
    boards = assembly.guide_boards(cells.select(F.col("sample").alias("board"), "cell", *IMAGE), columns).withColumnRenamed("board", "sample")

    numbered = S.numbered(samples.select("sample", "split"), "split", "sample", prompts)
    path = lambda end: F.concat(F.lit("mflux/"), F.col("split"), F.lit("/"), F.col("stem"), F.lit(end))
    entries = numbered.select("sample", "split", "ordinal", "prompt_index", path("_in.png").alias("input"), path("_out.png").alias("target"), path("_in.txt").alias("prompt"))
    return Dataset(faults, samples, boards, entries)


def delivered(boards: DataFrame, columns: int, frames: int, cell: tuple[int, int], native: tuple[int, int], canvas: tuple[int, int], tolerance: int = 42) -> tuple[DataFrame, DataFrame]:
    """(pixels, faults) of the frames 1 to ``frames`` of finished boards (board, w, h and arrays r, g, b).

    Each cell is brought to its native size by the nearest pixel and the canvas cut from its middle, in one expression; what is like
    the median of a frame's corners and connected with a side becomes clear, by runs.  pixels: board, frame, x, y, r, g, b of what is left.  faults:
    board, frame, rule: boards of another size (size) and frames that nothing is left of (empty).
    """
    (cw, ch), (nw, nh), (w, h) = cell, native, canvas
    left, top = (nw - w) // 2, (nh - h) // 2
    fits = (F.col("w") % cw == 0) & (F.col("h") % ch == 0) & (F.col("w") == cw * columns) & (F.col("h") / ch * columns > frames)
    odd = boards.where(~fits).select("board", F.lit(None).cast("int").alias("frame"), F.lit("size").alias("rule"))

    def source(p: Column) -> Column:
        x, y = F.floor(((p % w + left) * 2 + 1) * cw / (2 * nw)), F.floor(((F.floor(p / w) + top) * 2 + 1) * ch / (2 * nh))
        column, row = F.col("frame") % columns, F.floor(F.col("frame") / columns)
        return ((row * ch + y) * F.col("w") + column * cw + x).cast("int")

    cut = boards.where(fits).withColumn("frame", F.explode(F.sequence(F.lit(1), F.lit(frames)))).withColumn("at", F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), source))
    taken = lambda c: F.transform("at", lambda i: F.get(F.col(c), i)).alias(c)
    images = written(cut.select("board", "frame", *map(taken, "rgb")))
    masked = images.select(F.struct("board", "frame").alias("image"), F.lit(w).alias("w"), regions.like_corners(w, h, tolerance).alias("mask"))
    labelled = regions.regions(regions.runs(masked, "image"))
    outer = regions.touching(regions.measured(labelled), F.lit(w), F.lit(h)).where("edge").select("image", "region")
    gone = labelled.join(outer, ["image", "region"], "left_semi").select("image", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    px = images.select(F.struct("board", "frame").alias("image"), F.posexplode(F.arrays_zip("r", "g", "b")).alias("i", "p")).select("image", (F.col("i") % w).alias("x"), F.floor(F.col("i") / w).cast("int").alias("y"), "p.*")
    kept = px.join(gone, ["image", "x", "y"], "left_anti")
    empty = images.select("board", "frame").join(kept.select("image.board", "image.frame").distinct(), ["board", "frame"], "left_anti").withColumn("rule", F.lit("empty"))
    return kept.select("image.board", "image.frame", "x", "y", "r", "g", "b"), empty.unionByName(odd)
