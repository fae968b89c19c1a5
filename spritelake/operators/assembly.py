"""Putting rasters together: sheets, layouts, boards, mosaics, rigs and their clips."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import rasters as R
from . import sequences as S


def sheet_cells(sheets: DataFrame, columns: int, rows: int = 1) -> DataFrame:
    """Bounds of the cells of sheets (w, h): cut at whole pixels, all on the largest cell's canvas."""
    n = F.col("cell")
    c, r = n % columns, F.floor(n / columns).cast("int")
    edge = lambda size, k, parts: F.floor(F.col(size) * k / parts).cast("int")
    cut = sheets.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(columns * rows - 1))))
    cut = cut.select("*", edge("w", c, columns).alias("x0"), edge("h", r, rows).alias("y0"), edge("w", c + 1, columns).alias("x1"), edge("h", r + 1, rows).alias("y1"))
    return cut.withColumn("canvas_w", F.ceil(F.col("w") / columns).cast("int")).withColumn("canvas_h", F.ceil(F.col("h") / rows).cast("int"))


def cut_sheet(sheet: np.ndarray, columns: int, rows: int = 1) -> list[np.ndarray]:
    """The cells as images of one size."""
    h, w = sheet.shape[:2]
    out = []
    for k in range(columns * rows):
        c, r = k % columns, k // columns
        part = sheet[h * r // rows : h * (r + 1) // rows, w * c // columns : w * (c + 1) // columns]
        cell = np.zeros((-(-h // rows), -(-w // columns), 4), np.uint8)
        cell[: part.shape[0], : part.shape[1]] = part
        out.append(cell)
    return out


def layout(frames: DataFrame, canvas: tuple[int, int] | None = None, anchor: tuple[int, int] | None = None, padding: int = 2, allow_upscale: bool = False) -> DataFrame:
    """How each clip's frames share one canvas, all scaled alike and held at their feet.

    clip, canvas_w, canvas_h, anchor_x, anchor_y, scale, target_w, target_h and fault.  Frames have
    their own canvas (w, h), box and foot.  What a clip needs are the common bounds of its boxes; from
    the foot they reach left, right, up and down, and the canvas leaves its room beside the anchor less the
    padding, but for the side below, where a foot stands close to the edge on purpose.  The least ratio of room to
    reach is the scale, at most 1 unless it may grow.  Without ``canvas`` the largest frame and its padding make one,
    and without ``anchor`` that is its middle above the padding.

    Faults are rows, not errors: frames of different canvases, feet outside of them, and bounds
    that would shrink below 4 pixels (such clips have the scale that says so).
    """
    side = lambda given, size: F.lit(given) if given is not None else (F.max(size) + 2 * padding)
    wide, high = canvas or (None, None)
    bounds = [F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1")]
    feet = [f(c).alias(f"{n}_{c}") for n, f in (("least", F.min), ("most", F.max)) for c in ("foot_x", "foot_y", "w", "h")]
    per = frames.groupBy("clip").agg(side(wide, "w").alias("canvas_w"), side(high, "h").alias("canvas_h"), *bounds, *feet)
    at = (F.lit(anchor[0]), F.lit(anchor[1])) if anchor else (F.floor(F.col("canvas_w") / 2), F.col("canvas_h") - padding - 1)
    per = per.withColumns({"anchor_x": at[0].cast("int"), "anchor_y": at[1].cast("int")})
    sides = [
        (F.col("most_foot_x") - F.col("bx0"), F.col("anchor_x") - padding), (F.col("bx1") - 1 - F.col("least_foot_x"), F.col("canvas_w") - padding - 1 - F.col("anchor_x")),
        (F.col("most_foot_y") - F.col("by0"), F.col("anchor_y") - padding), (F.col("by1") - 1 - F.col("least_foot_y"), F.col("canvas_h") - 1 - F.col("anchor_y")),
    ]
    none = F.lit(float("inf"))
    scale = F.least(*(F.when(reach > 0, F.greatest(F.lit(0.0), room.cast("double")) / reach).otherwise(none) for reach, room in sides))
    scale = F.when(scale == none, 1.0).otherwise(scale)
    per = per.withColumn("scale", scale if allow_upscale else F.least(F.lit(1.0), scale))
    least = F.least(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")) * F.col("scale")
    fault = (
        F.when((F.col("least_w") != F.col("most_w")) | (F.col("least_h") != F.col("most_h")), "frames have different canvases")
        .when((F.col("least_foot_x") < 0) | (F.col("least_foot_y") < 0) | (F.col("most_foot_x") >= F.col("most_w")) | (F.col("most_foot_y") >= F.col("most_h")), "a foot lies outside its canvas")
        .when((F.col("scale") <= 0) | (least < 4), "bounds would shrink below 4 pixels")
    )
    target = lambda c: F.greatest(F.lit(1), F.bround(F.col(f"most_{c}") * F.col("scale")).cast("int")).alias(f"target_{c}")
    return per.select("clip", F.col("canvas_w").cast("int"), F.col("canvas_h").cast("int"), "anchor_x", "anchor_y", "scale", target("w"), target("h"), fault.alias("fault"))


def placed(frames: DataFrame, solved: DataFrame) -> DataFrame:
    """Where each frame, scaled whole, goes on its clip's canvas; clips with a fault have no rows."""
    at = lambda c: (F.col(f"anchor_{c}") - F.bround(F.col(f"foot_{c}") * F.col("scale"))).cast("int")
    return frames.join(solved.where("fault IS NULL"), "clip").select("frame", "clip", "canvas_w", "canvas_h", "target_w", "target_h", at("x").alias("left"), at("y").alias("top"))


def fitted(frames: DataFrame, canvas: tuple[int, int] | None = None, anchor: tuple[int, int] | None = None, padding: int = 2, content: tuple[int, int] | None = None, allow_upscale: bool = False) -> DataFrame:
    """Where each frame's own box goes when frames are cut out, fitted one by one and stood on the anchor.

    frame, clip, canvas_w, canvas_h, target_w, target_h, left, top.  A box larger than ``content`` is reduced to it,
    then it is fitted to the canvas within the padding and above the anchor; it grows only if it may.
    Without ``canvas`` the largest box of the clip and its padding make one.
    """

    def fit(w: Column, h: Column, most_w: Column, most_h: Column, grow: bool) -> tuple[Column, Column]:
        scale = F.least(most_w / w, most_h / h)
        to = lambda n: F.greatest(F.lit(1), F.bround(n * scale).cast("int"))
        keep = (F.abs(scale - 1) < 1e-9) if grow else (scale >= 1) | (F.abs(scale - 1) < 1e-9)
        return F.when(keep, w).otherwise(to(w)), F.when(keep, h).otherwise(to(h))

    own = frames.select("frame", "clip", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    if content:
        w, h = fit(F.col("w"), F.col("h"), F.lit(content[0]), F.lit(content[1]), False)
        own = own.select("frame", "clip", w.alias("w"), h.alias("h"))
    if canvas:
        own = own.withColumns({"canvas_w": F.lit(canvas[0]), "canvas_h": F.lit(canvas[1])})
    else:
        own = own.join(own.groupBy("clip").agg((F.max("w") + 2 * padding).alias("canvas_w"), (F.max("h") + 2 * padding).alias("canvas_h")), "clip")
    at = (F.lit(anchor[0]), F.lit(anchor[1])) if anchor else (F.floor(F.col("canvas_w") / 2).cast("int"), F.col("canvas_h") - padding - 1)
    own = own.withColumns({"ax": at[0], "ay": at[1]})
    w, h = fit(F.col("w"), F.col("h"), F.greatest(F.lit(1), F.col("canvas_w") - 2 * padding), F.greatest(F.lit(1), F.col("ay") - padding + 1), allow_upscale)
    own = own.withColumns({"target_w": w.cast("int"), "target_h": h.cast("int")})
    return own.select("frame", "clip", "canvas_w", "canvas_h", "target_w", "target_h", (F.col("ax") - F.floor(F.col("target_w") / 2)).cast("int").alias("left"), (F.col("ay") - F.col("target_h") + 1).cast("int").alias("top"))


def redrawn(packed: DataFrame, places: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Packed frames on their new canvases by the nearest pixel, all in one expression a channel; with
    ``boxes`` (frame, x0, y0, x1, y1) only that part of each frame, else the whole."""
    rows = packed.join(places.drop("clip"), "frame")
    if boxes is not None:
        rows = rows.join(boxes.select("frame", "x0", "y0", "x1", "y1"), "frame")
    else:
        rows = rows.withColumns({"x0": F.lit(0), "y0": F.lit(0), "x1": F.col("w"), "y1": F.col("h")})
    place = F.sequence(F.lit(0), F.col("canvas_w") * F.col("canvas_h") - 1)
    from_ = lambda k, low, size, target: low + F.floor((k * 2 + 1) * size / (target * 2)).cast("int")

    def source(p: Column) -> Column:
        x, y = p % F.col("canvas_w") - F.col("left"), F.floor(p / F.col("canvas_w")).cast("int") - F.col("top")
        inside = (x >= 0) & (y >= 0) & (x < F.col("target_w")) & (y < F.col("target_h"))
        return F.when(inside, from_(y, F.col("y0"), F.col("y1") - F.col("y0"), F.col("target_h")) * F.col("w") + from_(x, F.col("x0"), F.col("x1") - F.col("x0"), F.col("target_w")))

    rows = rows.withColumn("source", F.transform(place, source))
    channel = lambda c: F.transform("source", lambda i: F.coalesce(F.get(F.col(c), i), F.lit(0))).alias(c)
    return rows.select("frame", "clip", F.col("canvas_w").alias("w"), F.col("canvas_h").alias("h"), *map(channel, "rgba"))


def board_pixels(pixels: DataFrame, columns: int, cell: int, inner: int) -> DataFrame:
    """Pixels of frames (with ``cell`` numbers) at their place on a board, each centred in its cell."""
    off = (cell - inner) // 2
    x = F.col("cell") % columns * cell + off + F.col("x")
    y = F.floor(F.col("cell") / columns).cast("int") * cell + off + F.col("y")
    return pixels.withColumn("bx", x.cast("int")).withColumn("by", y.cast("int"))


def guide(alpha: np.ndarray) -> np.ndarray:
    """Silhouette (70, 104, 138) with its edge in (244, 238, 192)."""
    mask = np.pad(alpha > 20, 1)
    h, w = alpha.shape
    around = [mask[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)]
    grown, shrunk = np.logical_or.reduce(around), np.logical_and.reduce(around)
    out = np.zeros((h, w, 4), np.uint8)
    out[mask[1:-1, 1:-1]] = (70, 104, 138, 255)
    out[grown & ~shrunk] = (244, 238, 192, 255)
    return out


def board(frames: list[np.ndarray], columns: int, rows: int, cell: int, background: tuple[int, int, int]) -> np.ndarray:
    """A board with each frame centred in its cell; too many or too large frames are an error."""
    if len(frames) > columns * rows or any(max(f.shape[:2]) > cell for f in frames):
        raise ValueError("the frames don't fit the board")
    out = np.zeros((rows * cell, columns * cell, 4), np.uint8)
    out[:, :] = (*background, 255)
    for k, f in enumerate(frames):
        out = K.composed(out, f, k % columns * cell + (cell - f.shape[1]) // 2, k // columns * cell + (cell - f.shape[0]) // 2)
    return out


def mosaic(frames: list[np.ndarray], most_columns: int = 6) -> np.ndarray:
    """Frames side by side, in up to so many columns."""
    columns = min(most_columns, max(1, len(frames)))
    side = max((max(f.shape[:2]) for f in frames), default=1)
    return board(frames, columns, max(1, -(-len(frames) // columns)), side, (0, 0, 0))


def nearest_scaled(image: np.ndarray, by: int) -> np.ndarray:
    return image.repeat(by, 0).repeat(by, 1)


def gif(frames: list[np.ndarray], fps: float, loop: bool) -> bytes:
    """An animation with up to 255 colours and one transparent entry; LZW codes are sent unpacked."""
    h, w = frames[0].shape[:2]
    opaque = np.concatenate([f[f[:, :, 3] > 20][:, :3] for f in frames])
    palette = K.median_cut(opaque, 255) if len(opaque) else np.zeros((1, 3), np.uint8)
    table = np.zeros((256, 3), np.uint8)
    table[: len(palette)] = palette
    delay = max(2, round(100 / fps))
    out = [b"GIF89a", int(w).to_bytes(2, "little"), int(h).to_bytes(2, "little"), b"\xf7\xff\x00", table.tobytes()]
    if loop:
        out.append(b"!\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    for f in frames:
        index = ((f[:, :, :3].reshape(-1, 1, 3).astype(int) - palette.astype(int)) ** 2).sum(2).argmin(1)
        index[f[:, :, 3].ravel() <= 20] = 255
        codes: list[int] = []
        for i in range(0, len(index), 250):  # a clear code before the table would grow to 10-bit codes
            codes += [256, *index[i : i + 250].tolist()]
        codes.append(257)
        bits = "".join(format(c, "09b")[::-1] for c in codes)
        data = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        out += [b"!\xf9\x04\x09", delay.to_bytes(2, "little"), b"\xff\x00", b",\x00\x00\x00\x00", int(w).to_bytes(2, "little"), int(h).to_bytes(2, "little"), b"\x00\x08"]
        out += [bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)] + [b"\x00"]
    return b"".join([*out, b";"])


def poses(joints: DataFrame, keys: DataFrame, clips: DataFrame) -> DataFrame:
    """clip, i, joint, angle, x, y: the world transform of every joint at every sample of each clip.

    ``keys``: clip, joint, channel (rotation, offset_x or offset_y), k, t, value; ``clips``: clip,
    frames, loop.  Keys are interpolated by an interval join, then the tree is walked one level a
    step, as many steps as it has levels.
    """
    times = clips.select("clip", "loop", F.posexplode(S.sample_times(F.col("frames"), F.col("loop"))).alias("i", "at"))
    tracks = keys.select("clip", "joint", "channel").distinct()
    values = S.interpolated(keys, tracks.join(times, "clip").select("clip", "joint", "channel", "loop", "at").distinct(), ["clip", "joint", "channel"])
    wide = values.groupBy("clip", "joint", "at").agg(*(F.coalesce(F.max(F.when(F.col("channel") == c, F.col("value"))), F.lit(0.0)).alias(c) for c in ("rotation", "offset_x", "offset_y")))
    # every joint has a pose at every sample; a rig's joints are a few dozen rows
    rig = F.lit(0).alias("rig")
    local = joints.select("*", rig).join(times.drop("loop").select("*", rig), "rig").drop("rig").join(wide, ["clip", "joint", "at"], "left").select("clip", "i", "joint", "parent", (F.col("angle") + F.coalesce("rotation", F.lit(0.0))).alias("angle"), (F.col("ox") + F.coalesce("offset_x", F.lit(0.0))).alias("ox"), (F.col("oy") + F.coalesce("offset_y", F.lit(0.0))).alias("oy"))
    found = level = local.where("parent IS NULL").select("clip", "i", "joint", "angle", F.col("ox").alias("x"), F.col("oy").alias("y"))
    depth = S.world_transforms(joints).agg(F.max("depth")).first()[0] or 0
    for _ in range(depth):
        up = level.select("clip", "i", F.col("joint").alias("parent"), F.col("angle").alias("pa"), F.col("x").alias("px"), F.col("y").alias("py"))
        t = F.radians("pa")
        level = local.join(up, ["clip", "i", "parent"]).select("clip", "i", "joint", (F.col("pa") + F.col("angle")).alias("angle"), (F.col("px") + F.col("ox") * F.cos(t) + F.col("oy") * F.sin(t)).alias("x"), (F.col("py") - F.col("ox") * F.sin(t) + F.col("oy") * F.cos(t)).alias("y"))
        found = found.unionByName(level)
    return found


def rendered(parts: DataFrame, posed: DataFrame, canvas: tuple[int, int], origin: tuple[int, int]) -> DataFrame:
    """Frames of posed parts, composed in order of (z, part): clip, i, w, h, rgba.

    ``parts``: part, joint, z, w, h, rgba, pivot_x, pivot_y.  A frame's parts are a handful of
    rows, so a group is small whatever the number of frames.
    """
    joined = posed.join(F.broadcast(parts), "joint")  # a rig's parts: a few dozen rows

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["z"], r["part"]))
        out = np.zeros((canvas[1], canvas[0], 4), np.uint8)
        for r in rows:
            image = np.frombuffer(r["rgba"], np.uint8).reshape(r["h"], r["w"], 4)
            turned = K.rotated(image, r["angle"], (r["pivot_x"], r["pivot_y"]))
            reach = turned.shape[0] // 2
            out = K.composed(out, turned, int(np.rint(origin[0] + r["x"])) - reach, int(np.rint(origin[1] + r["y"])) - reach)
        return pa.table({"clip": [rows[0]["clip"]], "i": pa.array([rows[0]["i"]], pa.int32()), "w": pa.array([canvas[0]], pa.int32()), "h": pa.array([canvas[1]], pa.int32()), "rgba": [out.tobytes()]})

    return joined.groupBy("clip", "i").applyInArrow(run, "clip string, i int, w int, h int, rgba binary")


def opaque_boxes(frames: DataFrame) -> DataFrame:
    """Adds the half-open box of each packed rgba frame; null where nothing is opaque."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = []
            for w, h, data in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("w", "h", "rgba")), strict=True):
                y, x = np.nonzero(np.frombuffer(data, np.uint8).reshape(h, w, 4)[:, :, 3] > 20)
                boxes.append([int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1] if len(x) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(boxes, pa.list_(pa.int32()))], [*batch.schema.names, "box"])

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    return frames.mapInArrow(run, StructType(list(frames.schema.fields)).add("box", ArrayType(IntegerType())))


def cropped_clips(frames: DataFrame) -> DataFrame:
    """Frames cut to the union of all boxes: first the boxes of all, then one row that is joined back."""
    boxed = opaque_boxes(frames)
    union = boxed.where("box IS NOT NULL").agg(*(f(F.col("box")[k]).alias(c) for k, (c, f) in enumerate((("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = [np.frombuffer(r["rgba"], np.uint8).reshape(r["h"], r["w"], 4)[r["y0"] : r["y1"], r["x0"] : r["x1"]] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.shape[1] for a in out], pa.int32()), pa.array([a.shape[0] for a in out], pa.int32()), pa.array([a.tobytes() for a in out], pa.binary())], ["clip", "i", "w", "h", "rgba"])

    return boxed.crossJoin(F.broadcast(union)).select("clip", "i", "w", "h", "rgba", "x0", "y0", "x1", "y1").mapInArrow(run, "clip string, i int, w int, h int, rgba binary")


def scaled_offsets(keys: DataFrame, height: Column, rest: float = 256.0) -> DataFrame:
    """Offsets of keys drawn for one height at another; turns stay."""
    return keys.withColumn("value", F.when(F.startswith("channel", F.lit("offset")), F.round(F.col("value") * height / rest, 6)).otherwise(F.col("value")))


def first_of(rows: DataFrame, key: str, priority: Column) -> DataFrame:
    """The row of least priority of each key."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(priority))).where("_at = 1").drop("_at")


#: The colours of a guide's silhouette and of its edge.
SILHOUETTE, EDGE = (70, 104, 138), (244, 238, 192)


def guide_boards(frames: DataFrame, columns: int = 4) -> DataFrame:
    """Pixels of two boards for each ``board``: ``input`` with the identity in cell 0 and guides of the poses, ``target`` with the poses.

    frames: board, cell, w, h and arrays r, g, b, a.  A cell is the longer side of its board's largest frame, rounded up to 16
    pixels, and frames are centred in it; the board has the rows that its cells need.  Returns board, kind, bx, by, r,
    g, b, a, board_w, board_h; clear pixels have no rows.  A board without cell 0 has poses only.
    """
    size = frames.groupBy("board").agg((F.ceil(F.max(F.greatest("w", "h")) / 16) * 16).cast("int").alias("side"), (F.floor(F.max("cell") / columns) + 1).cast("int").alias("rows"))
    rows = frames.join(size, "board")
    places = F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)
    # 2 on the edge, between the mask grown and shrunk by a pixel, 1 within, 0 outside
    drawn = F.transform(places, lambda i: F.when(R.dilated(i) & ~R.eroded(i), 2).when(F.get("a", i) > 20, 1).otherwise(0))
    channel = lambda edge, inner: F.transform("guide", lambda g: F.when(g == 2, edge).when(g == 1, inner).otherwise(0))
    shown = {c: channel(e, s) for c, e, s in zip("rgb", EDGE, SILHOUETTE, strict=True)}
    guides = rows.where("cell > 0").withColumn("guide", drawn).withColumns(shown | {"a": F.transform("guide", lambda g: F.when(g > 0, 255).otherwise(0))}).drop("guide")
    both = guides.unionByName(rows.where("cell = 0")).withColumn("kind", F.lit("input")).unionByName(rows.withColumn("kind", F.lit("target")))
    px = both.select("board", "kind", "cell", "w", "h", "side", "rows", F.posexplode(F.arrays_zip("r", "g", "b", "a")).alias("i", "p")).where("p.a > 0")
    off = lambda c: F.floor((F.col("side") - F.col(c)) / 2)
    bx = F.col("cell") % columns * F.col("side") + off("w") + F.col("i") % F.col("w")
    by = F.floor(F.col("cell") / columns) * F.col("side") + off("h") + F.floor(F.col("i") / F.col("w"))
    return px.select("board", "kind", bx.cast("int").alias("bx"), by.cast("int").alias("by"), "p.*", (F.col("side") * columns).alias("board_w"), (F.col("side") * F.col("rows")).alias("board_h"))
