"""Gates of clips and boards as violation rows: every rule of a profile, and boards against their targets.

Images are measured within the row by numpy on Arrow batches, so only a row of numbers a frame or
board goes on; clips are judged from aggregates of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from . import kernels as K
from .manifests import ERROR, WARNING
from .rasters import drift_ratio

MEASURES = "canvas_w int, canvas_h int, x0 int, y0 int, x1 int, y1 int, colors int, hole_pixels int, holes int, fringe int"


def measures(packed: DataFrame, threshold: int = 20, least: int = 235, spread: int = 18) -> DataFrame:
    """frame, clip and the numbers that clip gates need; the box is null where nothing is opaque."""

    def rows(image: np.ndarray) -> list[tuple]:
        alpha, rgb = image[:, :, 3], image[:, :, :3]
        opaque = alpha > threshold
        h, w = opaque.shape
        if not opaque.any():
            return [(w, h, None, None, None, None, 0, 0, 0, 0)]
        xs, ys = np.flatnonzero(opaque.any(0)), np.flatnonzero(opaque.any(1))
        areas = K.holes(alpha, threshold)
        beside = K.around(~opaque, False, np.logical_or)
        fringe = opaque & beside & (rgb.min(2) >= least) & (np.ptp(rgb.astype(int), axis=2) <= spread)
        colours = len(np.unique(rgb[opaque].astype(int) @ (1 << 16, 1 << 8, 1)))
        return [(w, h, int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1, colours, sum(areas), len(areas), int(fringe.sum()))]

    return K.by_frame(packed, MEASURES, rows)


def _faults(*rules: tuple[str, str, Column | bool, Column]) -> Column:
    """Array of (gate, severity, value) of the rules that are broken."""
    return F.array_compact(F.array(*(F.when(F.coalesce(F.lit(when), F.lit(False)), F.struct(F.lit(gate).alias("gate"), F.lit(severity).alias("severity"), value.cast("string").alias("value"))) for gate, severity, when, value in rules)))


def measured(packed: DataFrame, profile: dict) -> DataFrame:
    """The measures that a profile's gates need, as a written table: each image is looked at once, for all tiers and placements."""
    quality = profile.get("quality", {})
    matte = quality.get("edgeMatte", {})
    return written(measures(packed, quality.get("alphaThreshold", 20), matte.get("minRgb", 235), matte.get("maxChannelSpread", 18)))


def clip_gates(packed: DataFrame, profile: dict, tier: str, placement: str = "per-frame-anchor", wanted: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """clip, frame (null for the clip as a whole), gate, severity, value: all that breaks the profile.

    ``placement`` is ``per-frame-anchor``, where each foot has to be near the anchor's line, or
    ``shared-motion``, where the first one has to and a loop's must not drift, and enclosed holes
    are not judged.  ``known`` is what ``measured`` found before, for further tiers.  Clips named in ``wanted`` that have no frames break ``selection``.  Frames
    without an opaque pixel break ``empty_frame`` and take no part in the other gates.  ``known`` is what
    ``measured`` found before; without it the frames are measured now.
    """
    if placement not in ("per-frame-anchor", "shared-motion"):
        raise ValueError(f"unknown placement {placement!r}")
    rules, quality, contracts = profile["tiers"][tier], profile.get("quality", {}), profile.get("animations", {})
    shared, matte, ground = placement == "shared-motion", quality.get("edgeMatte", {}), quality.get("background", {})

    def of_clip(pick, default) -> Column:
        """A clip's own value from the profile's (bounded) list of clips, else the common one."""
        out = F.lit(default)
        for name, contract in contracts.items():
            out = F.when(F.col("clip").cast("string") == name, F.lit(pick(contract, default))).otherwise(out)
        return out

    def limit(group: str, key: str, default) -> Column:
        return of_clip(lambda c, d: c.get(group, {}).get(key, d), quality.get(group, {}).get(key, default))

    tolerance = limit("anchor", "maxFootDrift", 1)
    m = measured(packed, profile) if known is None else known
    m = m.withColumn("foot", F.col("y1") - 1).withColumn("w", F.col("x1") - F.col("x0")).withColumn("h", F.col("y1") - F.col("y0"))
    full, no = F.col("x0").isNotNull(), F.lit(False)
    canvas, content, anchor = rules.get("canvas"), rules.get("contentMin"), rules.get("anchor")
    fixed, lined = rules.get("canvasPolicy", "fixed") == "fixed", bool(anchor) and not rules.get("preservePlacement", False)
    over = lambda c, most: F.col(c) > most if most is not None else no
    size = F.concat_ws("x", F.col("w").cast("string"), F.col("h").cast("string"))
    single = _faults(
        ("empty_frame", ERROR, ~full, F.lit("")),
        ("edge_matte", ERROR, full & over("fringe", matte.get("maxPixels")), F.col("fringe")),
        ("enclosed_holes", ERROR, full & over("hole_pixels", None if shared else ground.get("maxEnclosedTransparentPixels")), F.col("hole_pixels")),
        ("canvas", ERROR, full & ((F.col("canvas_w") != canvas[0]) | (F.col("canvas_h") != canvas[1])) if fixed and canvas else no, F.concat_ws("x", F.col("canvas_w").cast("string"), F.col("canvas_h").cast("string"))),
        ("content_min", ERROR, full & ((F.col("w") < content[0]) | (F.col("h") < content[1])) if content else no, size),
        ("foot", ERROR, full & (F.abs(F.col("foot") - anchor[1]) > tolerance) if lined and not shared else no, F.col("foot")),
        ("colors", ERROR, full & over("colors", quality.get("palette", {}).get("maxColors", 256)), F.col("colors")),
    )
    per = m.where(full).groupBy("clip").agg(
        F.count(F.lit(1)).alias("frames"), F.min_by("foot", "frame").alias("first_foot"), (F.max("foot") - F.min("foot")).alias("feet"), drift_ratio("h").alias("heights"), drift_ratio("w").alias("widths"),
    )
    clips = m.select("clip").distinct().join(per, "clip", "left").fillna(0, ["frames"])
    loop = of_clip(lambda c, d: c.get("loop", d), True)
    least, most = of_clip(lambda c, d: c.get("minFrames", 1), 0), of_clip(lambda c, d: c.get("maxFrames", 999), 1 << 30)
    drifts = F.col("feet") > tolerance
    whole = _faults(
        ("initial_foot", ERROR, F.abs(F.col("first_foot") - anchor[1]) > tolerance if lined and shared else no, F.col("first_foot")),
        ("foot_drift", ERROR, (drifts & loop if shared else no) if lined else drifts, F.col("feet")),
        ("height_drift", ERROR, F.col("heights") > limit("identity", "maxHeightDriftRatio", 1.0), F.round("heights", 3)),
        ("width_drift", WARNING, F.col("widths") > limit("identity", "maxWidthDriftRatio", 1.0), F.round("widths", 3)),
        ("frame_count", ERROR, ~F.col("frames").between(least, most), F.col("frames")),
    )
    rows = m.select("clip", "frame", F.explode(single).alias("f")).unionByName(clips.select("clip", F.lit(None).cast("long").alias("frame"), F.explode(whole).alias("f")))
    if wanted:
        asked = packed.sparkSession.createDataFrame([(w,) for w in wanted], "clip string").withColumn("clip", F.col("clip").cast(dict(packed.dtypes)["clip"]))
        lost = asked.join(packed.select("clip").distinct(), "clip", "left_anti")
        rows = rows.unionByName(lost.select("clip", F.lit(None).cast("long").alias("frame"), F.struct(F.lit("selection").alias("gate"), F.lit(ERROR).alias("severity"), F.lit("").alias("value")).alias("f")))
    return rows.select("clip", "frame", "f.gate", "f.severity", "f.value")


def clip_verdicts(clips: DataFrame, found: DataFrame) -> DataFrame:
    """clip, errors, warnings, ok for each of ``clips``; a clip of which nothing was found is fine."""
    count = lambda s: F.coalesce(F.count_if(F.col("severity") == s), F.lit(0)).alias(f"{s}s")
    per = found.groupBy("clip").agg(count(ERROR), count(WARNING))
    return clips.select("clip").distinct().join(per, "clip", "left").fillna(0).withColumn("ok", F.col("errors") == 0)


# The thresholds of board grading and the two colours of pose guides.
THRESHOLDS = {
    "background_foreground_distance": 32.0,
    "background_drift_distance": 28.0,
    "max_background_drift_ratio": 0.025,
    "identity_min_mask_iou": 0.78,
    "identity_min_color_similarity": 0.86,
    "identity_min_score": 0.82,
    "guide_color_distance": 24.0,
    "max_pose_guide_residual": 0.05,
    "min_cell_silhouette_iou": 0.55,
    "min_cell_occupancy_ratio": 0.65,
    "max_cell_occupancy_ratio": 1.45,
    "max_unused_foreground_ratio": 0.003,
}
GUIDE_COLOURS = ((70, 104, 138), (244, 238, 192))

GRADE = pa.schema([
    ("identity_iou", pa.float64()), ("color_similarity", pa.float64()), ("identity_score", pa.float64()), ("guide_residual", pa.float64()), ("completed", pa.int32()), ("background_drift", pa.float64()), ("background_distance", pa.float64()),
    ("faults", pa.list_(pa.struct([("cell", pa.int32()), ("gate", pa.string()), ("value", pa.float64())]))), ("passed", pa.bool_()),
])


def _ratio(a: np.ndarray, b: np.ndarray, empty: float) -> np.ndarray:
    return np.where(b > 0, a / np.maximum(b, 1), empty)


def grade(given: np.ndarray, target: np.ndarray, made: np.ndarray, columns: int, rows: int, frames: int, thresholds: dict[str, float] = THRESHOLDS, background: tuple[int, int, int] | None = None) -> dict:
    """One generated board (height x width x 3) against its target and the input it was made from.

    Cell 0 holds the identity, the next ``frames`` cells poses, the rest nothing.  All cells are
    measured at once.  Without a ``background`` the median of the corners of input and target counts.
    A generated board of another size breaks ``dimensions``, and boards that don't fit their grid break ``grid``; neither is measured.
    """
    t = thresholds
    h, w = target.shape[:2]
    other = target.ndim != 3 or given.shape != target.shape or h % rows or w % columns or not 0 < frames < rows * columns
    if made.shape != target.shape or other:
        gate = "grid" if other else "dimensions"
        return {**dict.fromkeys(GRADE.names), "faults": [{"cell": None, "gate": gate, "value": None}], "passed": False}
    given, target, made = (x.astype(np.float64) for x in (given, target, made))
    ground = np.median(np.concatenate([x[[0, 0, -1, -1], [0, -1, 0, -1]] for x in (given, target)]), axis=0) if background is None else np.array(background, float)
    square = lambda a, b: ((a - b) ** 2).sum(-1)
    cells = lambda a: a.reshape(rows, h // rows, columns, w // columns).swapaxes(1, 2).reshape(rows * columns, -1)
    far = t["background_foreground_distance"] ** 2
    masks = [square(x, ground) > far for x in (given, target, made)]
    asked, wanted, found = map(cells, masks)
    both, either = (wanted & found).sum(1), (wanted | found).sum(1)
    overlap = _ratio(both, either, 1.0)
    occupancy = np.where((wanted.sum(1) == 0) & (found.sum(1) > 0), np.inf, _ratio(found.sum(1), wanted.sum(1), 1.0))
    near_guide = cells(np.min([square(made, np.array(c, float)) for c in GUIDE_COLOURS], axis=0) <= t["guide_color_distance"] ** 2)
    left = (near_guide & asked).sum(1)
    residual = _ratio(left, asked.sum(1), 0.0)
    widest = np.sqrt(3 * 255.0**2)
    apart = cells(np.sqrt(square(target, made)))[0][wanted[0] & found[0]]
    alike = max(0.0, 1 - apart.mean() / widest) if len(apart) else 0.0
    score = 0.65 * overlap[0] + 0.35 * alike
    pose, unused = np.arange(1, frames + 1), np.arange(frames + 1, rows * columns)
    fits = (occupancy >= t["min_cell_occupancy_ratio"]) & (occupancy <= t["max_cell_occupancy_ratio"])
    gates = {
        "cell_foreground": ((wanted.sum(1) > 0) & (found.sum(1) > 0), found.sum(1)), "cell_occupancy": (fits, occupancy),
        "cell_silhouette": (overlap >= t["min_cell_silhouette_iou"], overlap), "cell_guide": (residual <= t["max_pose_guide_residual"], residual),
    }
    faults = [(int(k), name, value[k]) for name, (ok, value) in gates.items() for k in pose if not ok[k]]
    spare = found.mean(1)
    faults += [(int(k), "unused_cell", spare[k]) for k in unused if spare[k] > t["max_unused_foreground_ratio"]]
    total = left[pose].sum() / max(1, asked[pose].sum())
    still = ~K.around(masks[0] | masks[1], False, np.logical_or)
    drift = square(made, ground)[still]
    moved, distance = (float((drift > t["background_drift_distance"] ** 2).mean()), float(np.sqrt(drift).mean())) if len(drift) else (1.0, np.inf)
    board = [("identity_mask", overlap[0] >= t["identity_min_mask_iou"], overlap[0]), ("identity_color", alike >= t["identity_min_color_similarity"], alike), ("identity_score", score >= t["identity_min_score"], score), ("guide_residual", total <= t["max_pose_guide_residual"], total), ("background", moved <= t["max_background_drift_ratio"], moved)]
    faults = [(None, name, value) for name, ok, value in board if not ok] + faults
    done = np.all([ok[pose] for ok, _ in gates.values()], axis=0).sum()
    return {
        "identity_iou": float(overlap[0]), "color_similarity": float(alike), "identity_score": float(score), "guide_residual": float(total), "completed": int(done), "background_drift": moved, "background_distance": distance,
        "faults": [{"cell": c, "gate": g, "value": float(v)} for c, g, v in faults], "passed": not faults,
    }


def board_grades(boards: DataFrame, columns: int = 3, rows: int = 3, thresholds: dict[str, float] = THRESHOLDS, background: tuple[int, int, int] | None = None) -> DataFrame:
    """Adds the grade of each board, one pass and no shuffle.

    ``boards``: board, w, h, frames and arrays ``given``, ``target`` and ``made`` of colours as
    numbers (red << 16 | green << 8 | blue) in row order.  A null array counts as one of another size.
    """
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            flat = [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy(), c.is_valid().to_numpy(zero_copy_only=False)) for c in (batch.column(i) for i in (4, 5, 6))]
            for k, (w, h, frames) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                a = [values[at[k] : at[k + 1]].astype(np.int64) if valid[k] else np.zeros(0, np.int64) for values, at, valid in flat]
                a = [np.stack([x >> 16 & 255, x >> 8 & 255, x & 255], -1) for x in a]
                a = [x.reshape(h, w, 3) if len(x) and len(x) == w * h else x for x in a]
                out.append(grade(*a, columns, rows, frames, thresholds, background))
            yield pa.RecordBatch.from_arrays([batch.column(0), *pa.RecordBatch.from_pylist(out, schema=GRADE).columns], ["board", *GRADE.names])

    chosen = boards.select(F.col("board").cast("long"), F.col("w").cast("int"), F.col("h").cast("int"), F.col("frames").cast("int"), "given", "target", "made")
    schema = from_arrow_schema(pa.schema([("board", pa.int64()), *GRADE]))
    return chosen.mapInArrow(run, schema)


def board_faults(graded: DataFrame) -> DataFrame:
    """board, cell (null for the board), gate, value."""
    return graded.select("board", F.explode("faults").alias("f")).select("board", "f.cell", "f.gate", "f.value")
