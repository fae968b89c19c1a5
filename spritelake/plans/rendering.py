"""Queries that render clips from parts and take a picture apart; every vector is a part of some frame of its label's clip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parts, rendering
from ..operators import rasters as R
from ..sources import adapters as A
from ..sources.tables import written
from .catalogue import SEEDS, query, raster_sql

CANVAS, KEEP, REFERENCE = (40, 40), (12, 12, 28, 29), (0, 0)
ALPHA = "CASE WHEN a > 20 AND frame % 41 <> 7 THEN 255 - (r % 3) * 60 ELSE 0 END"
POSE = {"i": "CASE WHEN frame % 41 = 7 THEN 100 + frame ELSE frame // 10 % 4 END", "dx": "CASE WHEN frame % 97 = 5 THEN 0 ELSE 13 + frame % 7 END", "dy": "CASE WHEN clip = 3 THEN 33 - frame % 3 WHEN clip = 4 THEN 1 + frame % 30 ELSE 12 + frame // 7 % 9 END"}
COMPOSED = f"""WITH {raster_sql(A.MEDIUM)}, ly AS (SELECT clip, ({POSE['i']})::INT AS i, frame AS z, (x + {POSE['dx']})::INT AS x, (y + {POSE['dy']})::INT AS y, r, g, b, ({ALPHA})::INT AS a FROM raster),
        pm AS (SELECT clip, i, x, y, list(struct_pack(r := r * (a / 255.0::DOUBLE), g := g * (a / 255.0::DOUBLE), b := b * (a / 255.0::DOUBLE), a := a / 255.0::DOUBLE) ORDER BY z) AS p FROM ly WHERE a > 0 GROUP BY ALL),
        fo AS (SELECT clip, i, x, y, list_reduce(p, lambda d, u: struct_pack(r := u.r + d.r * (1 - u.a), g := u.g + d.g * (1 - u.a), b := u.b + d.b * (1 - u.a), a := u.a + d.a * (1 - u.a))) AS p FROM pm),
        cp AS (SELECT clip, i, x, y, floor(p.r / p.a + 0.5)::INT AS r, floor(p.g / p.a + 0.5)::INT AS g, floor(p.b / p.a + 0.5)::INT AS b, floor(p.a * 255.0::DOUBLE + 0.5)::INT AS a FROM fo),
        bx AS (SELECT clip, i, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM cp GROUP BY ALL), fr AS (SELECT DISTINCT clip, i FROM ly),
        gd AS (SELECT fr.clip, fr.i, x0, y0, x1, y1, CASE WHEN fr.clip % 2 = 0 AND y1 IS NOT NULL THEN (SELECT y1 FROM bx WHERE clip = 0 AND i = 0) - y1 ELSE 0 END AS shift FROM fr LEFT JOIN bx ON bx.clip = fr.clip AND bx.i = fr.i),
        lk AS (SELECT *, CASE WHEN y0 IS NOT NULL THEN greatest(0, y0 + shift) END AS top, CASE WHEN y1 IS NOT NULL THEN least(40, y1 + shift) END AS bottom FROM gd)"""
CROP = """un AS (SELECT min(x0) AS u0, min(top) AS v0, max(x1) AS u1, max(bottom) AS v1 FROM lk), pd AS (SELECT *, greatest(2, round_even(greatest(u1 - u0, v1 - v0) * 0.035::DOUBLE, 0))::INT AS pad FROM un),
        cr AS (SELECT greatest(0, u0 - pad) AS l, greatest(0, v0 - pad) AS t, least(40, u1 + pad) AS r, least(40, v1 + pad) AS b, u0, v0, u1, v1 FROM pd)"""


def _pixels(spark: SparkSession, sf_dir: str, segment: int = 4) -> tuple[DataFrame, DataFrame]:
    """Composed pixels of all frames, and the frames; a few frames have clear parts only."""
    px = A.pixels(spark, sf_dir, A.MEDIUM)
    expr = {n: F.expr(e.replace("frame // 10", "floor(frame / 10)").replace("frame // 7", "floor(frame / 7)")).cast("int") for n, e in POSE.items()}
    poses = px.select("frame", "clip").distinct().select("clip", expr["i"].alias("i"), F.col("frame").alias("part"), F.col("frame").alias("z"), expr["dx"].alias("dx"), expr["dy"].alias("dy"))
    kit = px.select(F.col("frame").alias("part"), "x", "y", "r", "g", "b", F.expr(ALPHA).alias("a"))
    return rendering.composited(rendering.posed(kit, poses), ["clip", "i"], ["z"], segment), poses


def _locked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pixels, poses = _pixels(spark, sf_dir)
    pixels = written(pixels)
    clips = poses.select("clip").distinct().withColumn("grounded", F.col("clip") % 2 == 0)
    return pixels, written(rendering.grounded(rendering.boxes(pixels, poses), clips, REFERENCE, CANVAS[1]))


@query(f"{COMPOSED} SELECT clip, i, count(*)::BIGINT AS pixels, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b, sum(a)::BIGINT AS a FROM cp GROUP BY clip, i")
def composited_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of each frame over each other, four at a time."""
    pixels, _ = _pixels(spark, sf_dir)
    return pixels.groupBy("clip", "i").agg(F.count(F.lit(1)).alias("pixels"), *(F.sum(c).alias(c) for c in "rgba"))


@query(COMPOSED + """, ov AS (SELECT clip, i, concat_ws(', ', CASE WHEN 12 - x0 > 0 THEN 'left=' || (12 - x0) || 'px' END, CASE WHEN 12 - top > 0 THEN 'top=' || (12 - top) || 'px' END, CASE WHEN x1 - 28 > 0 THEN 'right=' || (x1 - 28) || 'px' END, CASE WHEN bottom - 29 > 0 THEN 'bottom=' || (bottom - 29) || 'px' END) AS told FROM lk)
        SELECT clip, i, 'empty' AS rule, '' AS told FROM lk WHERE x0 IS NULL UNION ALL SELECT clip, i, 'edge', '' FROM lk WHERE x0 <= 0 OR y0 <= 0 OR x1 >= 40 OR y1 >= 40
        UNION ALL SELECT clip, i, 'ground', shift::VARCHAR FROM lk WHERE shift <> 0 AND (top <= 0 OR bottom >= 40) UNION ALL SELECT clip, i, 'overflow', told FROM ov WHERE told <> ''""")
def render_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of rendering that frames break, on a canvas to be kept."""
    return rendering.gate_faults(_locked(spark, sf_dir)[1], CANVAS, KEEP)


@query(f"""{COMPOSED}, {CROP} SELECT l::INT AS "left", t::INT AS top, r::INT AS "right", b::INT AS bottom, ((SELECT (x0 + x1 - 1) // 2 FROM bx WHERE clip = 0 AND i = 0) - l)::INT AS anchor_x, ((SELECT y1 - 1 FROM bx WHERE clip = 0 AND i = 0) - t)::INT AS anchor_y,
        (u0 - l)::INT AS content_x0, (v0 - t)::INT AS content_y0, (u1 - l)::INT AS content_x1, (v1 - t)::INT AS content_y1 FROM cr""")
def rendered_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one box of all frames, and the reference frame's foot in it."""
    return rendering.crop(_locked(spark, sf_dir)[1], REFERENCE, CANVAS)


@query(f"""{COMPOSED}, {CROP} SELECT clip, i, (cr.r - l)::INT AS w, (cr.b - t)::INT AS h, count(*)::BIGINT AS pixels, sum((cp.r * 65536 + cp.g * 256 + cp.b)::BIGINT * (1 + (y + shift - t) * (cr.r - l) + x - l))::BIGINT AS digest
        FROM cp JOIN lk USING (clip, i), cr WHERE x >= l AND x < cr.r AND y + shift >= t AND y + shift < cr.b GROUP BY ALL""")
def rendered_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames on the ground and cut by one box."""
    pixels, locked = _locked(spark, sf_dir)
    done = rendering.cut(pixels, locked, rendering.crop(locked, REFERENCE, CANVAS))
    place = 1 + F.col("y") * F.col("w") + F.col("x")
    return done.groupBy("clip", "i", "w", "h").agg(F.count(F.lit(1)).alias("pixels"), F.sum((F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("long") * place).alias("digest"))


PIVOTS = [("head", 0.5, 0.45), ("torso", 0.5, 0.5), ("arm", 0.25, 0.3), ("leg", 0.45, 0.75)]
PARTS = f"""WITH {raster_sql(A.MEDIUM)}, s(k, part, sx, sy, sw) AS (VALUES {', '.join(f"({k}, '{n}', {x}::DOUBLE, {y}::DOUBLE, {w}::DOUBLE)" for k, (n, x, y, w) in enumerate(SEEDS))}), pv(part, ux, uy) AS (VALUES {', '.join(f"('{n}', {x}::DOUBLE, {y}::DOUBLE)" for n, x, y in PIVOTS)}),
        n AS (SELECT frame, x, y, part FROM raster, s WHERE a > 20 QUALIFY row_number() OVER (PARTITION BY frame, i ORDER BY ((x - sx) * (x - sx) + (y - sy) * (y - sy)) / (sw * sw), k) = 1),
        f AS (SELECT frame, min(x) AS fx0, min(y) AS fy0, max(x) + 1 AS fx1, max(y) + 1 AS fy1 FROM n GROUP BY frame), o AS (SELECT frame, part, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*)::BIGINT AS pixels FROM n GROUP BY ALL),
        w AS (SELECT o.*, round_even(fx0 + (fx1 - fx0 - 1) * ux, 0)::INT AS px, round_even(fy0 + (fy1 - fy0 - 1) * uy, 0)::INT AS py FROM o JOIN f USING (frame) JOIN pv USING (part)),
        cut AS (SELECT frame, part, least(x0, px)::INT AS "left", least(y0, py)::INT AS top, greatest(x1, px + 1)::INT AS "right", greatest(y1, py + 1)::INT AS bottom, (px - least(x0, px))::INT AS pivot_x, (py - least(y0, py))::INT AS pivot_y, pixels FROM w)"""


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labelled = R.voronoi(A.pixels(spark, sf_dir, A.MEDIUM), SEEDS)
    return labelled, parts.cut_parts(labelled, spark.createDataFrame(PIVOTS, "part string, share_x double, share_y double"))


@query(f"{PARTS} SELECT * FROM cut")
def picture_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a picture, by the nearest of four seeds, cut out to their pivots."""
    return _parts(spark, sf_dir)[1]


@query(f"{PARTS}, again AS (SELECT DISTINCT n.frame, x, y FROM n JOIN cut USING (frame, part) WHERE pixels >= 3) SELECT n.frame, (count(again.frame)::DOUBLE / count(*))::DOUBLE AS iou FROM n LEFT JOIN again ON again.frame = n.frame AND again.x = n.x AND again.y = n.y GROUP BY n.frame")
def rest_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each picture its parts of three pixels and more make again."""
    labelled, cut = _parts(spark, sf_dir)
    return parts.rest_overlap(labelled, labelled, cut.where("pixels >= 3"))
