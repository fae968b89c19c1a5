"""All queries of the raster and manifest operators by name, with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import grading as G
from ..operators import integrity as I
from ..operators import kernels as K
from ..operators import manifests as M
from ..operators import rasters as R
from ..operators import rigs as B
from ..operators import sequences as S
from ..operators.ordinals import ordinals
from ..sources import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def raster_sql(threshold: float | str) -> str:
    return f"""px AS (SELECT vec_id AS frame, label AS clip, (k - 1)::INT AS i, ((k - 1) % 8)::INT AS x, ((k - 1) // 8)::INT AS y, embedding[k]::DOUBLE AS v FROM embeddings, range(1, 65) t(k)),
        lv AS (SELECT *, floor(least(255.0, greatest(0.0, (v + 1) * 128)))::INT AS r FROM px),
        raster AS (SELECT frame, clip, i, x, y, r, least(255, r + (i % 3) * 6)::INT AS g, least(255, r + (i % 5) * 8)::INT AS b, (CASE WHEN v > {threshold} THEN 255 ELSE 0 END)::INT AS a FROM lv)"""


METRICS = """fm AS (SELECT frame, clip, min(x)::INT AS x0, min(y)::INT AS y0, (max(x) + 1)::INT AS x1, (max(y) + 1)::INT AS y1, count(*)::BIGINT AS opaque, count(DISTINCT r * 65536 + g * 256 + b)::BIGINT AS colors FROM raster WHERE a > 20 GROUP BY ALL),
        metrics AS (SELECT frame, clip, x0, y0, x1, y1, (x1 - x0)::INT AS w, (y1 - y0)::INT AS h, ((x0 + x1 - 1) // 2)::INT AS foot_x, (y1 - 1)::INT AS foot_y, opaque, colors FROM fm)"""
SPARSE = f"WITH {raster_sql(A.SPARSE)}, {METRICS}"
SEQ = "seqs AS (SELECT frame, clip, (row_number() OVER (PARTITION BY clip ORDER BY frame))::INT AS seq FROM (SELECT DISTINCT vec_id AS frame, label AS clip FROM embeddings))"
BOARDS = "bd AS (SELECT *, (frame // 9)::INT AS board, (frame % 9)::INT AS cell FROM raster)"


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frame_metrics(A.packed(spark, sf_dir, A.SPARSE))


# ---- rasters


@query(f"{SPARSE} SELECT * FROM metrics")
def frame_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir)


@query(f"{SPARSE} SELECT f.frame, f.clip, m.x0, m.y0, m.x1, m.y1, coalesce(m.opaque, 0)::BIGINT AS opaque FROM (SELECT vec_id AS frame, label AS clip FROM embeddings) f LEFT JOIN metrics m USING (frame)")
def alpha_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.boxes(A.packed(spark, sf_dir, A.SPARSE)).select("frame", "clip", "box.x0", "box.y0", "box.x1", "box.y1", "opaque")


@query(f"WITH {raster_sql(A.DENSE)} SELECT clip, count(*) FILTER (WHERE r > 128)::BIGINT AS opaque, count(*) FILTER (WHERE r <= 128)::BIGINT AS transparent FROM raster GROUP BY clip")
def harden_alpha_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.alpha_counts(A.pixels(spark, sf_dir, A.DENSE), "r", 128)


@query(f"""WITH {raster_sql(A.OPAQUE)}, c AS (SELECT frame, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM raster WHERE x IN (0, 7) AND y IN (0, 7) GROUP BY frame),
        d AS (SELECT frame, (r - mr) * (r - mr) + (g - mg) * (g - mg) + (b - mb) * (b - mb) AS d FROM raster JOIN c USING (frame))
        SELECT frame, count(*) FILTER (WHERE d > 784)::BIGINT AS foreground, max(d)::DOUBLE AS farthest_sq FROM d GROUP BY frame""")
def foreground_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.foreground(A.pixels(spark, sf_dir, A.OPAQUE), 8, 28)


@query(f"""WITH {raster_sql(A.DENSE)} SELECT frame, clip, count(*) FILTER (WHERE a > 20 AND least(r, g, b) >= 140 AND greatest(r, g, b) - least(r, g, b) <= 18
        AND EXISTS (SELECT 1 FROM raster n WHERE n.frame = p.frame AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1 AND n.a <= 20))::BIGINT AS fringe FROM raster p GROUP BY frame, clip""")
def fringe_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fringe(A.packed(spark, sf_dir, A.DENSE), 140, 18)


@query(f"""WITH {raster_sql(A.MEDIUM)}, n AS (SELECT p.frame, p.i, p.a, count(*) FILTER (WHERE q.a > 20) AS o FROM raster p JOIN raster q ON q.frame = p.frame AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY ALL)
        SELECT frame, count(*) FILTER (WHERE a > 20)::BIGINT AS silhouette, count(*) FILTER (WHERE o BETWEEN 1 AND 8)::BIGINT AS edge, coalesce(sum(i) FILTER (WHERE o BETWEEN 1 AND 8), 0)::BIGINT AS edge_places FROM n GROUP BY frame""")
def pose_guide_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pose_guide(A.packed(spark, sf_dir, A.MEDIUM))


@query(f"WITH {raster_sql(A.MEDIUM)} SELECT frame, (7 - x)::INT AS x, y, (r * 17 // 20)::INT AS r, (g * 17 // 20)::INT AS g, (b * 17 // 20)::INT AS b, a FROM raster")
def mirror_darken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mirrored(A.pixels(spark, sf_dir, A.MEDIUM), 8)


@query(f"""WITH {raster_sql(A.MEDIUM)}, {SEQ}, m AS (SELECT seqs.frame, seqs.clip, seq, i, a > 20 AS o FROM raster JOIN seqs USING (frame))
        SELECT p.frame, p.clip, p.seq, (CASE WHEN count(*) FILTER (WHERE p.o OR q.o) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE p.o AND q.o)::DOUBLE / count(*) FILTER (WHERE p.o OR q.o) END)::DOUBLE AS iou
        FROM m p JOIN m q ON q.clip = p.clip AND q.seq = p.seq - 1 AND q.i = p.i GROUP BY ALL""")
def mask_iou_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.consecutive_iou(A.packed(spark, sf_dir, A.MEDIUM))


@query(f"{SPARSE} SELECT clip, min(x0)::INT AS x0, min(y0)::INT AS y0, max(x1)::INT AS x1, max(y1)::INT AS y1, count(*)::BIGINT AS frames FROM metrics GROUP BY clip")
def clip_union_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.union_box(_sparse(spark, sf_dir))


DRIFT = "CASE WHEN count({0}) < 2 OR median({0}) <= 0 THEN 0.0 ELSE (max({0}) - min({0})) / median({0}) END"
DRIFT_SQL = DRIFT.format


@query(f"{SPARSE} SELECT clip, ({DRIFT.format('h')})::DOUBLE AS height_drift, ({DRIFT.format('w')})::DOUBLE AS width_drift, (max(foot_x) - min(foot_x))::INT AS foot_x_drift, (max(foot_y) - min(foot_y))::INT AS foot_y_drift FROM metrics GROUP BY clip")
def clip_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.clip_drift(_sparse(spark, sf_dir))


@query(f"{SPARSE}, u AS (SELECT clip, min(x0) ux, min(y0) uy, max(x1) vx, max(y1) vy FROM metrics GROUP BY clip) SELECT frame, clip, (foot_x - ux)::INT AS anchor_x, (foot_y - uy)::INT AS anchor_y, (vx - ux)::INT AS envelope_w, (vy - uy)::INT AS envelope_h FROM metrics JOIN u USING (clip)")
def anchors_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.anchors(_sparse(spark, sf_dir))


@query(f"""{SPARSE}, d AS (SELECT clip, {DRIFT.format('h')} AS hd, {DRIFT.format('w')} AS wd, max(foot_y) - min(foot_y) AS fd, max(colors) AS mc FROM metrics GROUP BY clip),
        e AS (SELECT label AS clip, count(*) AS n FROM embeddings WHERE vec_id NOT IN (SELECT frame FROM metrics) GROUP BY label),
        v AS (SELECT clip, 'error' AS s, 'foot_drift: ' || fd AS t FROM d WHERE fd > 2 UNION ALL SELECT clip, 'error', 'height_drift: above limit' FROM d WHERE hd > 0.2
              UNION ALL SELECT clip, 'warning', 'width_drift: above limit' FROM d WHERE wd > 0.2 UNION ALL SELECT clip, 'error', 'palette: ' || mc FROM d WHERE mc > 24 UNION ALL SELECT clip, 'error', 'empty_frame: ' || n FROM e)
        SELECT c.clip::VARCHAR AS subject, array_to_string(coalesce(list(t ORDER BY t) FILTER (WHERE s = 'error'), []), '; ') AS errors, array_to_string(coalesce(list(t ORDER BY t) FILTER (WHERE s = 'warning'), []), '; ') AS warnings, count(*) FILTER (WHERE s = 'error') = 0 AS ok
        FROM (SELECT DISTINCT label AS clip FROM embeddings) c LEFT JOIN v USING (clip) GROUP BY c.clip""")
def clip_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates of a clip as violation rows: heights and feet are errors, widths a warning."""
    frames = A.packed(spark, sf_dir, A.SPARSE)
    metrics = R.frame_metrics(frames)
    drift = R.clip_drift(metrics).join(metrics.groupBy("clip").agg(F.max("colors").alias("most_colors")), "clip")
    empty = R.boxes(frames).where("box IS NULL").groupBy("clip").agg(F.count(F.lit(1)).alias("n"))
    clip = F.col("clip")
    found = [
        M.violations(drift, clip, "foot_drift", F.col("foot_y_drift") > 2, F.col("foot_y_drift").cast("string")),
        M.violations(drift, clip, "height_drift", F.col("height_drift") > 0.2, F.lit("above limit")),
        M.violations(drift, clip, "width_drift", F.col("width_drift") > 0.2, F.lit("above limit"), M.WARNING),
        M.violations(drift, clip, "palette", F.col("most_colors") > 24, F.col("most_colors").cast("string")),
        M.violations(empty, clip, "empty_frame", F.col("n") > 0, F.col("n").cast("string")),
    ]
    out = M.verdict(frames.select("clip").distinct(), "clip", *found)
    return out.select("subject", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "ok")


@query(f"""WITH {raster_sql(A.MEDIUM)}, o AS (SELECT clip, r * 65536 + g * 256 + b AS c, row_number() OVER (PARTITION BY clip ORDER BY frame, i) - 1 AS rn, count(*) OVER (PARTITION BY clip) AS n FROM raster WHERE a > 20)
        SELECT clip, n::BIGINT AS opaque, count(*)::BIGINT AS sampled, count(DISTINCT c)::BIGINT AS colors, count(DISTINCT c) > 32 AS needs_palette FROM o WHERE rn % greatest(1, ceil(n / 200.0)::BIGINT) = 0 GROUP BY clip, n""")
def shared_palette_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.palette_gate(A.pixels(spark, sf_dir, A.MEDIUM), 32, 200)


@query(f"""WITH {raster_sql(A.DENSE)}, e AS (SELECT * FROM raster p WHERE a > 20 AND EXISTS (SELECT 1 FROM raster n WHERE n.frame = p.frame AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1 AND n.a <= 20)),
        c AS (SELECT frame, r, g, b, a, count(*) AS n FROM e GROUP BY ALL) SELECT frame, r, g, b, a, n::BIGINT AS n FROM c QUALIFY row_number() OVER (PARTITION BY frame ORDER BY n DESC, a DESC, 299 * r + 587 * g + 114 * b DESC, r DESC, g DESC, b DESC) = 1""")
def boundary_mode_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mode_colour(A.packed(spark, sf_dir, A.DENSE))


PALETTE = [(32, 32, 32), (64, 72, 80), (96, 104, 112), (120, 128, 140), (136, 140, 150), (160, 170, 180), (200, 205, 210), (240, 244, 248)]


@query(f"""WITH {raster_sql(A.MEDIUM)}, p(k, pr, pg, pb) AS (VALUES {', '.join(f'({k}, {r}, {g}, {b})' for k, (r, g, b) in enumerate(PALETTE))}),
        n AS (SELECT frame, i, arg_min(k, ((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) * 100 + k) AS k FROM raster, p WHERE a > 20 GROUP BY ALL)
        SELECT k::INT AS entry, count(*)::BIGINT AS pixels, count(DISTINCT frame)::BIGINT AS frames FROM n GROUP BY k""")
def nearest_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = A.pixels(spark, sf_dir, A.MEDIUM).where("a > 20")
    return px.select("frame", R.nearest(F.col("r"), F.col("g"), F.col("b"), PALETTE).alias("entry")).groupBy("entry").agg(F.count(F.lit(1)).alias("pixels"), F.count_distinct("frame").alias("frames"))


RUNS = f"""WITH {raster_sql(A.MEDIUM)}, isl AS (SELECT frame, clip, y, x - row_number() OVER (PARTITION BY frame, y ORDER BY x) AS g FROM raster WHERE a > 20),
        runs AS (SELECT frame, y, count(*) AS n FROM isl GROUP BY frame, y, g),
        rws AS (SELECT p.frame, p.clip, p.y, count(*) FILTER (WHERE a > 20) AS opaque, coalesce((SELECT max(n) FROM runs r WHERE r.frame = p.frame AND r.y = p.y), 0) AS longest FROM raster p GROUP BY p.frame, p.clip, p.y)"""


@query(f"{RUNS} SELECT frame, clip, y, opaque::BIGINT AS opaque, longest::INT AS longest FROM rws")
def row_longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rows_of(A.packed(spark, sf_dir, A.MEDIUM)).drop("w")


@query(f"""{RUNS}, f AS (SELECT frame, y, y - row_number() OVER (PARTITION BY frame ORDER BY y) AS g FROM rws WHERE opaque >= 4 OR longest >= 3)
        SELECT frame, min(y)::INT AS first, max(y)::INT AS last, count(*)::BIGINT AS length FROM f GROUP BY frame, g HAVING count(*) <= 4""")
def separator_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.separator_bands(A.packed(spark, sf_dir, A.MEDIUM), 0.5, 0.4)


def reach_sql(threshold: float, candidate: str) -> str:
    """Border-connected candidates by recursive UNION."""
    return f"""WITH RECURSIVE {raster_sql(threshold)}, cand AS (SELECT frame, clip, x, y FROM raster WHERE {candidate}),
        hit AS (SELECT frame, x, y FROM cand WHERE x IN (0, 7) OR y IN (0, 7) UNION SELECT c.frame, c.x, c.y FROM hit h JOIN cand c ON c.frame = h.frame AND abs(c.x - h.x) <= 1 AND abs(c.y - h.y) <= 1)"""


def label_sql(threshold: float, base: str) -> str:
    """Components of the rows of ``base`` named by their smallest place, by recursive UNION over reachable places."""
    return f"""WITH RECURSIVE {raster_sql(threshold)}, cand AS ({base}),
        walk AS (SELECT frame, y * 8 + x AS root, x, y FROM cand UNION SELECT c.frame, w.root, c.x, c.y FROM walk w JOIN cand c ON c.frame = w.frame AND abs(c.x - w.x) <= 1 AND abs(c.y - w.y) <= 1),
        lab AS (SELECT frame, x, y, min(root) AS root FROM walk GROUP BY ALL)"""


@query(reach_sql(A.DENSE, "a <= 20") + """, inn AS (SELECT * FROM cand WHERE (frame, x, y) NOT IN (SELECT (frame, x, y) FROM hit)),
        walk AS (SELECT frame, y * 8 + x AS root, x, y FROM inn UNION SELECT c.frame, w.root, c.x, c.y FROM walk w JOIN inn c ON c.frame = w.frame AND abs(c.x - w.x) <= 1 AND abs(c.y - w.y) <= 1),
        lab AS (SELECT frame, x, y, min(root) AS root FROM walk GROUP BY ALL), ar AS (SELECT frame, root, count(*) AS n FROM lab GROUP BY ALL)
        SELECT frame, count(*)::BIGINT AS holes, sum(n)::BIGINT AS area, string_agg(n::VARCHAR, ',' ORDER BY n DESC) AS areas FROM ar GROUP BY frame""")
def enclosed_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda image: [(len(h), sum(h), ",".join(map(str, h)))] if (h := K.holes(image[:, :, 3])) else []
    return K.by_frame(A.packed(spark, sf_dir, A.DENSE), "holes long, area long, areas string", rows).drop("clip")


@query(label_sql(A.MEDIUM, "SELECT frame, clip, x, y FROM raster WHERE a > 20") + """, box AS (SELECT frame, root, count(*) AS area, min(y) AS t, min(x) AS l, max(y) + 1 AS b, max(x) + 1 AS r FROM lab GROUP BY ALL)
        SELECT frame, (row_number() OVER (PARTITION BY frame ORDER BY area DESC, t, l, root))::INT AS rank, area::BIGINT AS area, t::INT AS top, l::INT AS "left", b::INT AS bottom, r::INT AS "right" FROM box WHERE area >= 2""")
def components_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda image: [(k + 1, *c) for k, c in enumerate(x for x in K.component_boxes(image[:, :, 3] > 20) if x[0] >= 2)]
    return K.by_frame(A.packed(spark, sf_dir, A.MEDIUM), "rank int, area long, top int, left int, bottom int, right int", rows).drop("clip")


@query(label_sql(A.MEDIUM, "SELECT frame, clip, x, y FROM raster WHERE a > 20") + """, comp AS (SELECT frame, root, count(*) AS area, bool_or(x IN (0, 7) OR y IN (0, 7)) AS edge FROM lab GROUP BY ALL),
        k AS (SELECT *, area <= 2 OR (area < 0.2 * max(area) OVER (PARTITION BY frame) AND edge) AS gone, row_number() OVER (PARTITION BY frame ORDER BY area DESC, root) AS rk FROM comp),
        s AS (SELECT frame, root, area FROM (SELECT *, bool_and(gone) OVER (PARTITION BY frame) AS all_gone FROM k) WHERE NOT gone OR (all_gone AND rk = 1))
        SELECT frame, sum(area)::BIGINT AS pixels, count(*)::BIGINT AS components FROM s GROUP BY frame""")
def component_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(image):
        mask = image[:, :, 3] > 20
        kept = K.kept_components(mask, small=2) & mask
        return [(int(kept.sum()), int(K.labels(kept).max()))] if kept.any() else []

    return K.by_frame(A.packed(spark, sf_dir, A.MEDIUM), "pixels long, components long", rows).drop("clip")


@query("WITH RECURSIVE " + raster_sql(A.OPAQUE) + """, c AS (SELECT frame, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM raster WHERE x IN (0, 7) AND y IN (0, 7) GROUP BY frame),
        cand AS (SELECT frame, x, y FROM raster JOIN c USING (frame) WHERE abs(r - mr) + abs(g - mg) + abs(b - mb) <= 42),
        hit AS (SELECT frame, x, y FROM cand WHERE x IN (0, 7) OR y IN (0, 7) UNION SELECT c.frame, c.x, c.y FROM hit h JOIN cand c ON c.frame = h.frame AND abs(c.x - h.x) <= 1 AND abs(c.y - h.y) <= 1)
        SELECT f.frame, count(h.frame)::BIGINT AS cleared FROM (SELECT vec_id AS frame FROM embeddings) f LEFT JOIN hit h USING (frame) GROUP BY f.frame""")
def corner_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda image: [(int((K.cleared_background(image, 42)[:, :, 3] == 0).sum()),)]
    return K.by_frame(A.packed(spark, sf_dir, A.OPAQUE), "cleared long", rows).drop("clip")


@query(reach_sql(A.DENSE, "a > 20 AND least(r, g, b) >= 130 AND greatest(r, g, b) - least(r, g, b) <= 40") + " SELECT f.frame, count(h.frame)::BIGINT AS cleared FROM (SELECT vec_id AS frame FROM embeddings) f LEFT JOIN hit h USING (frame) GROUP BY f.frame")
def neutral_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda image: [(int(((K.without_halo(image, 130, 40)[:, :, 3] == 0) & (image[:, :, 3] > 20)).sum()),)]
    return K.by_frame(A.packed(spark, sf_dir, A.DENSE), "cleared long", rows).drop("clip")


@query(reach_sql(A.DENSE, "a <= 20") + """, inn AS (SELECT * FROM cand WHERE (frame, x, y) NOT IN (SELECT (frame, x, y) FROM hit)),
        walk AS (SELECT frame, y * 8 + x AS root, x, y FROM inn UNION SELECT c.frame, w.root, c.x, c.y FROM walk w JOIN inn c ON c.frame = w.frame AND abs(c.x - w.x) <= 1 AND abs(c.y - w.y) <= 1),
        lab AS (SELECT frame, x, y, min(root) AS root FROM walk GROUP BY ALL), ar AS (SELECT frame, root, count(*) AS n FROM lab GROUP BY ALL)
        SELECT f.vec_id AS frame, f.label AS clip, coalesce(sum(n) FILTER (WHERE n <= 3), 0)::BIGINT AS filled, (count(*) FILTER (WHERE n > 3))::BIGINT AS left_over FROM embeddings f LEFT JOIN ar ON ar.frame = f.vec_id GROUP BY ALL""")
def hole_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled pixels and holes that are left, for holes of up to 3 pixels."""
    rows = lambda image: [(int(((out := K.filled_holes(image, 3))[:, :, 3] > image[:, :, 3]).sum()), len(K.holes(out[:, :, 3])))]
    return K.by_frame(A.packed(spark, sf_dir, A.DENSE), "filled long, left_over long", rows)


@query(f"""WITH RECURSIVE {raster_sql(A.DENSE)}, op AS (SELECT frame, x, y, least(r, g, b) >= 140 AND greatest(r, g, b) - least(r, g, b) <= 18 AS nt FROM raster WHERE a > 20),
        reach AS (SELECT frame, x, y, 0 AS k FROM op WHERE NOT nt UNION SELECT n.frame, n.x, n.y, r.k + 1 FROM reach r JOIN op n ON n.frame = r.frame AND n.nt AND abs(n.x - r.x) <= 1 AND abs(n.y - r.y) <= 1 WHERE r.k < 4),
        fr AS (SELECT frame, count(*) AS n FROM (SELECT DISTINCT frame, x, y FROM reach WHERE k > 0) p WHERE EXISTS (SELECT 1 FROM raster q WHERE q.frame = p.frame AND q.a <= 20 AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1) GROUP BY frame),
        lo AS (SELECT frame, max(y) AS low FROM op GROUP BY frame), ln AS (SELECT frame, low, x, x - row_number() OVER (PARTITION BY frame ORDER BY x) AS g FROM op JOIN lo USING (frame) WHERE y = low AND nt),
        ru AS (SELECT frame, low, min(x) AS f, max(x) AS t FROM ln GROUP BY frame, low, g), hit AS (SELECT frame, sum(t - f + 1) AS n FROM ru WHERE EXISTS (SELECT 1 FROM op q WHERE q.frame = ru.frame AND NOT q.nt AND q.y BETWEEN low - 3 AND low - 1 AND q.x BETWEEN f - 1 AND t + 1) GROUP BY frame)
        SELECT e.vec_id AS frame, e.label AS clip, coalesce(fr.n, 0)::BIGINT AS fringe, coalesce(hit.n, 0)::BIGINT AS line FROM embeddings e LEFT JOIN fr ON fr.frame = e.vec_id LEFT JOIN hit ON hit.frame = e.vec_id""")
def fringe_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recoloured pixels of fringes and detached bottom lines."""
    rows = lambda image: [(int((K.recoloured_fringe(image, 140) != image).any(2).sum()), int((K.detached_line(image, 140) != image).any(2).sum()))]
    return K.by_frame(A.packed(spark, sf_dir, A.DENSE), "fringe long, line long", rows)


SEEDS = [("head", 3.5, 1.0, 1.0), ("torso", 3.5, 4.0, 1.5), ("arm", 0.5, 4.0, 1.0), ("leg", 3.5, 7.0, 1.0)]


@query(f"""WITH {raster_sql(A.MEDIUM)}, s(k, part, sx, sy, sw) AS (VALUES {', '.join(f"({k}, '{n}', {x}::DOUBLE, {y}::DOUBLE, {w}::DOUBLE)" for k, (n, x, y, w) in enumerate(SEEDS))}),
        n AS (SELECT frame, i, x, y, part FROM raster, s WHERE a > 20 QUALIFY row_number() OVER (PARTITION BY frame, i ORDER BY ((x - sx) * (x - sx) + (y - sy) * (y - sy)) / (sw * sw), k) = 1)
        SELECT frame, part, count(*)::BIGINT AS pixels, min(x)::INT AS x0, min(y)::INT AS y0, (max(x) + 1)::INT AS x1, (max(y) + 1)::INT AS y1 FROM n GROUP BY frame, part""")
def voronoi_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.voronoi(A.pixels(spark, sf_dir, A.MEDIUM), SEEDS).groupBy("frame", "part").agg(F.count(F.lit(1)).alias("pixels"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


# ---- boards

CELLS = f"""WITH {raster_sql(A.MEDIUM)}, {BOARDS}, m AS (SELECT board, cell, i, r > 140 AS o, a > 20 AS t FROM bd),
        cells AS (SELECT board, cell, count(*) FILTER (WHERE o)::BIGINT AS opaque,
            (CASE WHEN count(*) FILTER (WHERE t) > 0 THEN count(*) FILTER (WHERE o)::DOUBLE / count(*) FILTER (WHERE t) WHEN count(*) FILTER (WHERE o) = 0 THEN 1.0 ELSE 'inf'::DOUBLE END)::DOUBLE AS occupancy,
            (CASE WHEN count(*) FILTER (WHERE o OR t) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE o AND t)::DOUBLE / count(*) FILTER (WHERE o OR t) END)::DOUBLE AS iou FROM m GROUP BY ALL)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose pixels above a grey level are held against the opaque ones."""
    target = A.boards(spark, sf_dir, A.MEDIUM)
    return R.board_cells(target.withColumn("a", F.transform("r", lambda r: F.when(r > 140, 255).otherwise(0))), target)


@query(f"{CELLS} SELECT * FROM cells")
def board_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query(f"{CELLS}, s AS (SELECT *, (board // 100)::INT AS shelf FROM cells) SELECT shelf, board, sum(opaque)::BIGINT AS opaque, count(*)::BIGINT AS cells, min(iou) AS least_iou FROM s GROUP BY ROLLUP (shelf, board)")
def board_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.board_totals(_cells(spark, sf_dir))


@query(f"""{CELLS}, q AS (SELECT board, count(*) = 9 AS full_board, coalesce(min(occupancy) FILTER (WHERE cell > 0) >= 0.65 AND max(occupancy) FILTER (WHERE cell > 0) <= 1.45, false) AS occupancy_ok, coalesce(avg(iou) FILTER (WHERE cell > 0) >= 0.55, false) AS overlap_ok FROM cells GROUP BY board)
        SELECT *, full_board AND occupancy_ok AND overlap_ok AS passed FROM q""")
def board_quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = lambda c: F.when(F.col("cell") > 0, F.col(c))
    gates = _cells(spark, sf_dir).groupBy("board").agg((F.count(F.lit(1)) == 9).alias("full_board"), ((F.min(other("occupancy")) >= 0.65) & (F.max(other("occupancy")) <= 1.45)).alias("occupancy_ok"), (F.avg(other("iou")) >= 0.55).alias("overlap_ok"))
    names = ("full_board", "occupancy_ok", "overlap_ok")
    filled = gates.select("board", *(F.coalesce(n, F.lit(False)).alias(n) for n in names))
    return filled.withColumn("passed", F.col(names[0]) & F.col(names[1]) & F.col(names[2]))


def _d2(p: str, q: str) -> str:
    return f"(({p}r - {q}r) * ({p}r - {q}r) + ({p}g - {q}g) * ({p}g - {q}g) + ({p}b - {q}b) * ({p}b - {q}b))"


GRADED = f"""WITH {raster_sql(A.MEDIUM)}, {BOARDS}, whole AS (SELECT board FROM bd GROUP BY board HAVING count(DISTINCT cell) = 9),
        c0 AS (SELECT board, cell, i, (cell % 3) * 8 + x AS bx, (cell // 3) * 8 + y AS dy, board % 8 AS kind, a > 20 AS o, r, g, b FROM bd JOIN whole USING (board)),
        tr AS (SELECT *, CASE WHEN o AND cell < 8 THEN r ELSE 200 END AS tr, CASE WHEN o AND cell < 8 THEN g ELSE 210 END AS tg, CASE WHEN o AND cell < 8 THEN b ELSE 220 END AS tb,
            CASE WHEN o AND cell = 0 THEN r WHEN o AND cell < 8 THEN 70 ELSE 200 END AS nr, CASE WHEN o AND cell = 0 THEN g WHEN o AND cell < 8 THEN 104 ELSE 210 END AS ng, CASE WHEN o AND cell = 0 THEN b WHEN o AND cell < 8 THEN 138 ELSE 220 END AS nb FROM c0),
        pz AS (SELECT t.*, CASE WHEN t.tr = 200 AND t.tg = 210 AND t.tb = 220 THEN true ELSE false END AS clear, CASE WHEN u.o THEN u.r ELSE 200 END AS ur, CASE WHEN u.o THEN u.g ELSE 210 END AS ug, CASE WHEN u.o THEN u.b ELSE 220 END AS ub FROM tr t JOIN c0 u ON u.board = t.board AND u.cell = t.cell AND u.i = CASE WHEN t.kind = 7 AND t.cell = 3 THEN 63 - t.i ELSE t.i END),
        m0 AS (SELECT *, CASE WHEN kind = 1 AND cell = 2 THEN [200, 210, 220] WHEN kind = 2 THEN [nr, ng, nb] WHEN kind = 3 AND clear THEN [230, 240, 250] WHEN kind = 4 AND cell = 0 AND NOT clear THEN [255 - tr, 255 - tg, 255 - tb]
            WHEN kind = 5 AND cell = 8 THEN [ur, ug, ub] WHEN kind = 6 AND cell = 1 THEN [0, 0, 0] WHEN kind = 7 AND cell = 3 THEN [ur, ug, ub] ELSE [tr, tg, tb] END AS mm FROM pz),
        co AS (SELECT board, median(v[1]) AS zr, median(v[2]) AS zg, median(v[3]) AS zb FROM (SELECT board, unnest([[nr, ng, nb], [tr, tg, tb]]) AS v FROM m0 WHERE bx IN (0, 23) AND dy IN (0, 23)) GROUP BY board),
        m1 AS (SELECT board, cell, kind, bx, dy, tr, tg, tb, nr, ng, nb, mm[1] AS mr, mm[2] AS mg, mm[3] AS mb, zr, zg, zb FROM m0 JOIN co USING (board)),
        m2 AS (SELECT *, {_d2('t', 'z')} > 1024 AS tm, {_d2('n', 'z')} > 1024 AS nm, {_d2('m', 'z')} > 1024 AS mk, {_d2('m', 'z')} AS md, sqrt({_d2('t', 'm')}) AS ap,
            least((mr - 70) * (mr - 70) + (mg - 104) * (mg - 104) + (mb - 138) * (mb - 138), (mr - 244) * (mr - 244) + (mg - 238) * (mg - 238) + (mb - 192) * (mb - 192)) <= 576 AS gd FROM m1),
        cl AS (SELECT board, cell, count(*) FILTER (WHERE tm) AS wanted, count(*) FILTER (WHERE mk) AS found, count(*) FILTER (WHERE nm) AS asked, count(*) FILTER (WHERE nm AND gd) AS lft,
            CASE WHEN count(*) FILTER (WHERE tm OR mk) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE tm AND mk)::DOUBLE / count(*) FILTER (WHERE tm OR mk) END AS iou, avg(ap) FILTER (WHERE tm AND mk) AS ap FROM m2 GROUP BY ALL),
        ce AS (SELECT *, CASE WHEN wanted > 0 THEN found::DOUBLE / wanted WHEN found = 0 THEN 1.0 ELSE 'inf'::DOUBLE END AS occ, CASE WHEN asked > 0 THEN lft::DOUBLE / asked ELSE 0.0 END AS res FROM cl),
        st AS (SELECT p.board, count(*) AS n, count(*) FILTER (WHERE md > 784) AS far, avg(sqrt(md)) AS mean FROM m2 p WHERE NOT EXISTS (SELECT 1 FROM m2 q WHERE q.board = p.board AND abs(q.bx - p.bx) <= 1 AND abs(q.dy - p.dy) <= 1 AND (q.tm OR q.nm)) GROUP BY p.board),
        gr AS (SELECT c.board, c.iou AS identity_iou, CASE WHEN c.ap IS NULL THEN 0.0 ELSE greatest(0.0, 1 - c.ap / sqrt(195075.0)) END AS color_similarity, p.res AS guide_residual, p.done AS completed, coalesce(s.far::DOUBLE / s.n, 1.0) AS background_drift, coalesce(s.mean, 'inf'::DOUBLE) AS background_distance
            FROM ce c JOIN (SELECT board, CASE WHEN sum(asked) > 0 THEN sum(lft)::DOUBLE / sum(asked) ELSE 0.0 END AS res, count(*) FILTER (WHERE wanted > 0 AND found > 0 AND occ BETWEEN 0.65 AND 1.45 AND iou >= 0.55 AND res <= 0.05) AS done FROM ce WHERE cell BETWEEN 1 AND 7 GROUP BY board) p USING (board) LEFT JOIN st s USING (board) WHERE c.cell = 0),
        gs AS (SELECT *, 0.65 * identity_iou + 0.35 * color_similarity AS identity_score FROM gr),
        fl AS (SELECT board, NULL::INT AS cell, 'identity_mask' AS gate, identity_iou AS value FROM gs WHERE identity_iou < 0.78 UNION ALL SELECT board, NULL, 'identity_color', color_similarity FROM gs WHERE color_similarity < 0.86 UNION ALL SELECT board, NULL, 'identity_score', identity_score FROM gs WHERE identity_score < 0.82
            UNION ALL SELECT board, NULL, 'guide_residual', guide_residual FROM gs WHERE guide_residual > 0.05 UNION ALL SELECT board, NULL, 'background', background_drift FROM gs WHERE background_drift > 0.025
            UNION ALL SELECT board, cell, 'cell_foreground', found FROM ce WHERE cell BETWEEN 1 AND 7 AND (wanted = 0 OR found = 0) UNION ALL SELECT board, cell, 'cell_occupancy', occ FROM ce WHERE cell BETWEEN 1 AND 7 AND NOT occ BETWEEN 0.65 AND 1.45
            UNION ALL SELECT board, cell, 'cell_silhouette', iou FROM ce WHERE cell BETWEEN 1 AND 7 AND iou < 0.55 UNION ALL SELECT board, cell, 'cell_guide', res FROM ce WHERE cell BETWEEN 1 AND 7 AND res > 0.05 UNION ALL SELECT board, cell, 'unused_cell', found / 64.0 FROM ce WHERE cell = 8 AND found / 64.0 > 0.003)"""


@query(f"{GRADED} SELECT board::BIGINT AS board, cell::INT AS cell, gate, round(value, 6)::DOUBLE AS value FROM fl")
def board_gate_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.board_faults(G.board_grades(A.board_triples(spark, sf_dir, A.MEDIUM))).withColumn("value", F.round("value", 6))


@query(f"""{GRADED} SELECT board::BIGINT AS board, round(identity_iou, 6)::DOUBLE AS identity_iou, round(color_similarity, 6)::DOUBLE AS color_similarity, round(identity_score, 6)::DOUBLE AS identity_score, round(guide_residual, 6)::DOUBLE AS guide_residual, completed::INT AS completed,
        round(background_drift, 6)::DOUBLE AS background_drift, round(background_distance, 6)::DOUBLE AS background_distance, board NOT IN (SELECT board FROM fl) AS passed FROM gs""")
def board_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = G.board_grades(A.board_triples(spark, sf_dir, A.MEDIUM)).drop("faults")
    return graded.select("board", *(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in graded.dtypes if c != "board"))


#: Thresholds by frame, so that each gate of a clip is broken by some.
MIXED = "CASE WHEN frame % 23 = 0 THEN 9.0 WHEN frame % 4 = 0 THEN -0.1 WHEN frame % 4 = 1 THEN 0.1 ELSE 0.02 END"
PROFILE = {
    "tiers": {"hd": {"canvasPolicy": "fixed", "canvas": [8, 8], "anchor": [4, 7], "contentMin": [8, 8]}, "sd": {"canvasPolicy": "fixed", "canvas": [8, 9], "anchor": [4, 9]}, "free": {"canvasPolicy": "union"}},
    "animations": {"1": {"minFrames": 1, "maxFrames": 3, "loop": True}, "2": {"minFrames": 1, "maxFrames": 1 << 20, "loop": False, "anchor": {"maxFootDrift": 0}, "identity": {"maxHeightDriftRatio": 0.01}}},
    "quality": {"alphaThreshold": 20, "palette": {"maxColors": 24}, "anchor": {"maxFootDrift": 1}, "identity": {"maxWidthDriftRatio": 0.05}, "edgeMatte": {"minRgb": 150, "maxChannelSpread": 40, "maxPixels": 2}, "background": {"maxEnclosedTransparentPixels": 0}},
}
GATES = f"""WITH RECURSIVE {raster_sql(MIXED)}, {METRICS}, cand AS (SELECT frame, x, y FROM raster WHERE a <= 20),
        hit AS (SELECT frame, x, y FROM cand WHERE x IN (0, 7) OR y IN (0, 7) UNION SELECT c.frame, c.x, c.y FROM hit h JOIN cand c ON c.frame = h.frame AND abs(c.x - h.x) <= 1 AND abs(c.y - h.y) <= 1),
        hl AS (SELECT frame, count(*) AS holes FROM cand WHERE (frame, x, y) NOT IN (SELECT (frame, x, y) FROM hit) GROUP BY frame),
        fr AS (SELECT frame, count(*) AS fringe FROM raster p WHERE a > 20 AND least(r, g, b) >= 150 AND greatest(r, g, b) - least(r, g, b) <= 40 AND EXISTS (SELECT 1 FROM raster n WHERE n.frame = p.frame AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1 AND n.a <= 20) GROUP BY frame),
        m AS (SELECT metrics.*, coalesce(holes, 0) AS holes, coalesce(fringe, 0) AS fringe, CASE WHEN clip = 2 THEN 0 ELSE 1 END AS tol FROM metrics LEFT JOIN hl USING (frame) LEFT JOIN fr USING (frame)),
        p(placement) AS (VALUES ('hd'), ('sd'), ('free')),
        cp AS (SELECT clip, count(*) AS n, arg_min(foot_y, frame) AS ff, max(foot_y) - min(foot_y) AS fd, any_value(tol) AS tol, {DRIFT_SQL('h')} AS hd, {DRIFT_SQL('w')} AS wd FROM m GROUP BY clip),
        v AS (SELECT placement, label AS clip, vec_id AS frame, 'empty_frame' AS gate, 'error' AS severity, '' AS value FROM embeddings, p WHERE vec_id NOT IN (SELECT frame FROM m)
            UNION ALL SELECT placement, clip, frame, 'edge_matte', 'error', fringe::VARCHAR FROM m, p WHERE fringe > 2
            UNION ALL SELECT placement, clip, frame, 'enclosed_holes', 'error', holes::VARCHAR FROM m, p WHERE holes > 0 AND placement <> 'sd'
            UNION ALL SELECT 'sd', clip, frame, 'canvas', 'error', '8x8' FROM m
            UNION ALL SELECT 'hd', clip, frame, 'content_min', 'error', w || 'x' || h FROM m WHERE w < 8 OR h < 8
            UNION ALL SELECT 'hd', clip, frame, 'foot', 'error', foot_y::VARCHAR FROM m WHERE abs(foot_y - 7) > tol
            UNION ALL SELECT placement, clip, frame, 'colors', 'error', colors::VARCHAR FROM m, p WHERE colors > 24
            UNION ALL SELECT 'sd', clip, NULL, 'initial_foot', 'error', ff::VARCHAR FROM cp WHERE abs(ff - 9) > tol
            UNION ALL SELECT placement, clip, NULL, 'foot_drift', 'error', fd::VARCHAR FROM cp, p WHERE fd > tol AND (placement = 'free' OR placement = 'sd' AND clip <> 2)
            UNION ALL SELECT placement, clip, NULL, 'height_drift', 'error', round(hd, 3)::VARCHAR FROM cp, p WHERE hd > CASE WHEN clip = 2 THEN 0.01 ELSE 1.0 END
            UNION ALL SELECT placement, clip, NULL, 'width_drift', 'warning', round(wd, 3)::VARCHAR FROM cp, p WHERE wd > 0.05
            UNION ALL SELECT placement, clip, NULL, 'frame_count', 'error', n::VARCHAR FROM cp, p WHERE clip = 1 AND n NOT BETWEEN 1 AND 3
            UNION ALL SELECT placement, 77, NULL, 'selection', 'error', '' FROM p)"""


def _gates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    frame = F.col("frame")
    frames = A.packed(spark, sf_dir, F.when(frame % 23 == 0, 9.0).when(frame % 4 == 0, -0.1).when(frame % 4 == 1, 0.1).otherwise(0.02))
    found, known = None, G.measured(frames, PROFILE)
    for tier, placement in (("hd", "per-frame-anchor"), ("sd", "shared-motion"), ("free", "per-frame-anchor")):
        rows = G.clip_gates(frames, PROFILE, tier, placement, ["1", "77"], known).select(F.lit(tier).alias("placement"), "*")
        found = rows if found is None else found.unionByName(rows)
    return frames, found


@query(f"{GATES} SELECT * FROM v")
def clip_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gate of a profile, in both placements and without an anchor."""
    return _gates(spark, sf_dir)[1]


@query(f"{GATES} SELECT c.clip, count(*) FILTER (WHERE severity = 'error')::BIGINT AS errors, count(*) FILTER (WHERE severity = 'warning')::BIGINT AS warnings, count(*) FILTER (WHERE severity = 'error') = 0 AS ok FROM (SELECT DISTINCT label AS clip FROM embeddings) c LEFT JOIN v USING (clip) GROUP BY c.clip")
def clip_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.clip_verdicts(*_gates(spark, sf_dir))


@query("""WITH n AS (SELECT p_partkey, (1 + p_partkey * 7 % 144)::INT AS cells FROM part), s AS (SELECT unnest(range(1, 13)) AS v), g AS (SELECT a.v AS c, b.v AS r FROM s a, s b)
        SELECT p_partkey, cells, c::INT AS columns, r::INT AS rows FROM n JOIN g ON c * r >= cells QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY c * r, abs(c - r), c) = 1""")
def grid_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of every part's number of cells."""
    n = A.table(spark, sf_dir, "part").select("p_partkey", (1 + F.col("p_partkey") * 7 % 144).cast("int").alias("cells"))
    return n.select("p_partkey", "cells", R.grid_for(F.col("cells")).alias("g")).select("p_partkey", "cells", "g.columns", "g.rows")


# ---- names, sequences and graphs


@query("""WITH n AS (SELECT p_partkey, p_name || ' ' || p_partkey AS name FROM part), k AS (SELECT *, list_transform(regexp_extract_all(lower(name), '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN struct_pack(t := '', n := p::HUGEINT) ELSE struct_pack(t := p, n := (-1)::HUGEINT) END) AS key FROM n)
        SELECT p_partkey, name, (row_number() OVER (ORDER BY key, p_partkey))::INT AS place FROM k""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = A.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"))
    return ordinals(parts, [C.natural_key(F.col("name")), "p_partkey"], name="place").withColumn("place", (F.col("place") + 1).cast("int"))


@query("SELECT event_type, count(*)::BIGINT AS rows FROM events WHERE event_type = 'click' OR starts_with(event_type, 'click_') GROUP BY event_type")
def requested_clip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.table(spark, sf_dir, "events").select("event_type")
    return M.clip_gate(events, "event_type", "click", ["click", "view", "error"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


KEYS = """keys AS (SELECT user_id AS joint, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch_us(ts) AS us, value, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS f, max(epoch_us(ts)) OVER (PARTITION BY user_id) AS l FROM events),
        keyed AS (SELECT joint, k, CASE WHEN l > f THEN (us - f)::DOUBLE / (l - f) ELSE 0.0 END AS t, value FROM keys)"""


@query(f"""WITH {KEYS}, tm AS (SELECT DISTINCT joint, n / 8.0::DOUBLE AS "at", joint % 2 = 0 AS loop FROM keyed, range(-1, 11) r(n)),
        q AS (SELECT joint, "at", CASE WHEN loop THEN "at" - floor("at") WHEN "at" >= 1 THEN 'inf'::DOUBLE ELSE greatest(0.0, "at") END AS t FROM tm),
        n AS (SELECT q.joint, q."at", q.t, max(k.k) FILTER (WHERE k.t < q.t) AS a, min(k.k) FILTER (WHERE k.t >= q.t) AS b FROM q JOIN keyed k USING (joint) GROUP BY ALL)
        SELECT n.joint, n."at"::DOUBLE AS "at", round(CASE WHEN x.k IS NULL THEN y.value WHEN y.k IS NULL THEN x.value ELSE x.value + (y.value - x.value) * ((n.t - x.t) / (y.t - x.t)) END, 6)::DOUBLE AS value
        FROM n LEFT JOIN keyed x ON x.joint = n.joint AND x.k = n.a LEFT JOIN keyed y ON y.joint = n.joint AND y.k = n.b""")
def keyframe_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second track loops; times run past both ends."""
    keys = A.keyframes(spark, sf_dir)
    times = keys.select("joint").distinct().select("joint", (F.col("joint") % 2 == 0).alias("loop"), F.explode(F.transform(F.sequence(F.lit(-1), F.lit(10)), lambda i: i / F.lit(8.0))).alias("at"))
    return S.interpolated(keys, times, ["joint"]).select("joint", "at", F.round("value", 6).alias("value"))


@query(f"""WITH {KEYS}, r AS (SELECT joint, k, floor(value) % 2 AS v, arg_min(floor(value) % 2, k) OVER (PARTITION BY joint) AS a, max(k) OVER (PARTITION BY joint) AS last FROM keyed WHERE k <= 1 + joint % 6),
        p AS (SELECT joint, bool_or(v <> a) AS moves, bool_or(v <> a AND k < last) AS between_, bool_or(v = a AND k = last) AS back FROM r GROUP BY joint)
        SELECT joint, (CASE WHEN joint % 4 = 0 OR NOT moves THEN 1 WHEN between_ AND back THEN 3 ELSE 2 END)::INT AS frames FROM p""")
def min_useful_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of one to six keys that take two values, every fourth in a loop."""
    keys = A.keyframes(spark, sf_dir).where(F.col("k") <= 1 + F.col("joint") % 6).withColumn("value", F.floor("value") % 2)
    return S.least_frames(keys, ["joint"], F.col("joint") % 4 == 0)


@query("SELECT o_orderkey, i::INT AS i, (CASE WHEN n = 1 THEN 0.0 WHEN loop THEN i::DOUBLE / n ELSE i::DOUBLE / (n - 1) END)::DOUBLE AS t FROM (SELECT o_orderkey, 1 + o_orderkey % 16 AS n, o_custkey % 2 = 0 AS loop FROM orders) a, range(0, 16) r(i) WHERE i < n")
def sample_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants of clips of one to sixteen frames, in loops and not."""
    clips = A.table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 16).cast("int").alias("n"), (F.col("o_custkey") % 2 == 0).alias("loop"))
    return clips.select("o_orderkey", F.posexplode(S.sample_times(F.col("n"), F.col("loop"))).alias("i", "t"))


JOINTS = "sk(name, above, ox, oy, angle) AS (VALUES " + ", ".join(f"('{a}', {'NULL' if p is None else repr(p)}, {x}::DOUBLE, {y}::DOUBLE, {r}::DOUBLE)" for a, p, x, y, r in S.SKELETON) + "), j AS (SELECT s_suppkey || '/' || name AS joint, s_suppkey || '/' || above AS parent, ox * (1 + s_suppkey % 3) AS ox, oy, angle FROM supplier, sk)"


def _joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skeleton for each supplier."""
    one = F.explode(F.array(*(F.struct(F.lit(a).alias("name"), F.lit(p).cast("string").alias("above"), F.lit(x).alias("ox"), F.lit(y).alias("oy"), F.lit(r).alias("angle")) for a, p, x, y, r in S.SKELETON))).alias("j")
    rows = A.table(spark, sf_dir, "supplier").select("s_suppkey", one).select("s_suppkey", "j.*")
    named = lambda c: F.concat(F.col("s_suppkey").cast("string"), F.lit("/"), F.col(c))
    return rows.select(named("name").alias("joint"), named("above").alias("parent"), (F.col("ox") * (1 + F.col("s_suppkey") % 3)).alias("ox"), "oy", "angle")


@query(f"WITH RECURSIVE {JOINTS}, up AS (SELECT joint, parent FROM j WHERE ends_with(joint, '/hand_front') OR ends_with(joint, '/leg_back') UNION SELECT j.joint, j.parent FROM up JOIN j ON j.joint = up.parent) SELECT joint FROM up")
def skeleton_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    joints = _joints(spark, sf_dir)
    return S.ancestors(joints, joints.where(F.col("joint").rlike("/(hand_front|leg_back)$")).select("joint"))


@query(f"""WITH RECURSIVE {JOINTS}, w AS (SELECT joint, 0 AS depth, angle, ox AS x, oy AS y FROM j WHERE parent IS NULL UNION ALL
        SELECT j.joint, w.depth + 1, w.angle + j.angle, w.x + j.ox * cos(radians(w.angle)) + j.oy * sin(radians(w.angle)), w.y - j.ox * sin(radians(w.angle)) + j.oy * cos(radians(w.angle)) FROM w JOIN j ON j.parent = w.joint)
        SELECT joint, depth::INT AS depth, angle, round(x, 6) AS x, round(y, 6) AS y FROM w""")
def world_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.world_transforms(_joints(spark, sf_dir)).select("joint", "depth", "angle", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""WITH RECURSIVE j AS (SELECT 's' || s_suppkey AS joint, CASE WHEN s_suppkey = 0 THEN NULL WHEN s_suppkey % 11 = 5 THEN 'nowhere' WHEN s_suppkey % 13 = 6 THEN 's' || s_suppkey ELSE 's' || (s_suppkey // 3) END AS parent FROM supplier),
        w AS (SELECT joint FROM j WHERE parent IS NULL UNION SELECT j.joint FROM w JOIN j ON j.parent = w.joint)
        SELECT joint AS subject, 'parent_exists' AS gate FROM j WHERE parent IS NOT NULL AND parent NOT IN (SELECT joint FROM j) UNION ALL SELECT joint, 'reaches_root' FROM j WHERE joint NOT IN (SELECT joint FROM w)
        UNION ALL SELECT 'skeleton', 'one_root' FROM (SELECT count(*) AS n FROM j WHERE parent IS NULL) WHERE n <> 1""")
def skeleton_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as joints of one tree, some with a parent that isn't there and some in a cycle."""
    k = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    parent = F.when(k == 0, None).when(k % 11 == 5, "nowhere").when(k % 13 == 6, name(k)).otherwise(name(F.floor(k / 3)))
    zero = F.lit(0.0)
    return S.tree_faults(A.table(spark, sf_dir, "supplier").select(name(k).alias("joint"), parent.alias("parent"), zero.alias("ox"), zero.alias("oy"), zero.alias("angle")))


# ---- manifests

DATASET = "samples AS (SELECT doc_id AS sample, source AS character, CASE WHEN source = (SELECT max(source) FROM documents) THEN 'validation' ELSE 'train' END AS split, sha256(text) AS pixel_hash, lang AS direction FROM documents)"


@query(f"WITH {DATASET} SELECT pixel_hash, count(DISTINCT split)::BIGINT AS splits, count(*)::BIGINT AS rows FROM samples WHERE pixel_hash IS NOT NULL GROUP BY pixel_hash HAVING count(DISTINCT split) > 1")
def leak_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.shared_across(A.samples(spark, sf_dir), "split", "pixel_hash")


@query(f"WITH {DATASET} SELECT character, count(DISTINCT split)::BIGINT AS splits, count(*)::BIGINT AS rows FROM samples WHERE character IS NOT NULL GROUP BY character HAVING count(DISTINCT split) > 1")
def leak_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.shared_across(A.samples(spark, sf_dir), "split", "character")


@query(f"WITH {DATASET} SELECT split, pixel_hash, count(*)::BIGINT AS rows FROM samples GROUP BY ALL HAVING count(*) > 1")
def duplicate_within_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.duplicated(A.samples(spark, sf_dir), "split", "pixel_hash")


@query("SELECT l_orderkey, count(*)::BIGINT AS rows, min(l_linenumber)::INT AS least, max(l_linenumber)::INT AS most FROM lineitem GROUP BY l_orderkey HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)")
def ordinal_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.broken_ordinals(A.table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("""WITH d AS (SELECT o_orderkey AS k, (o_orderkey % 5)::BIGINT AS want FROM orders), a AS (SELECT l_orderkey AS k, (count(*) % 5)::BIGINT AS have FROM lineitem GROUP BY 1)
        SELECT coalesce(d.k, a.k) AS k, CASE WHEN a.k IS NULL THEN 'missing' WHEN d.k IS NULL THEN 'unexpected' ELSE 'changed' END AS state FROM d FULL JOIN a ON a.k = d.k WHERE a.k IS NULL OR d.k IS NULL OR want <> have""")
def declared_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5).alias("digest"))
    actual = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.count(F.lit(1)) % 5).alias("digest"))
    return M.reconciled(declared, actual, "k", "digest")


REPORT = """rep AS (SELECT o_orderkey AS k, coalesce(ok, false) AS passed, CASE WHEN ok IS NULL THEN 'missing' WHEN NOT ok THEN 'failed' END AS reason FROM orders LEFT JOIN (SELECT l_orderkey, count(*) >= 3 AS ok FROM lineitem GROUP BY 1) b ON l_orderkey = o_orderkey)"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.count(F.lit(1)) >= 3).alias("ok"))
    return M.outer_report(A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), boards, "k", "ok")


@query(f"WITH {REPORT} SELECT * FROM rep")
def missing_side_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


@query(f"WITH {REPORT} SELECT count(*)::BIGINT AS required, count(*) FILTER (WHERE passed)::BIGINT AS passed, count(*) FILTER (WHERE NOT passed)::BIGINT AS failed, bool_and(passed) AS ok FROM rep")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.batch_summary(_report(spark, sf_dir))


@query(f"WITH {DATASET} SELECT sample, split, n::INT AS ordinal, lpad(n::VARCHAR, greatest(4, length(m::VARCHAR))::INT, '0') AS stem, ((n - 1) % 8)::INT AS prompt_index FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sample) AS n, count(*) OVER (PARTITION BY split) AS m FROM samples)")
def split_export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.numbered(A.samples(spark, sf_dir), "split", "sample").select("sample", "split", "ordinal", "stem", "prompt_index")


@query(f"WITH {DATASET} SELECT split, direction, count(*)::BIGINT AS files, sha256(string_agg(sample || '|' || pixel_hash, chr(10) ORDER BY sample || '|' || pixel_hash)) AS fingerprint FROM samples GROUP BY ALL")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fingerprint(A.samples(spark, sf_dir), ["split", "direction"], "sample", "pixel_hash")


@query(f"""WITH {DATASET}, f AS (SELECT character, direction, count(*) AS files, sha256(string_agg(sample || '|' || pixel_hash, chr(10) ORDER BY sample || '|' || pixel_hash)) AS fp FROM samples GROUP BY ALL)
        SELECT character, sum(files)::BIGINT AS files, count(*)::BIGINT AS clips, sha256(string_agg(direction || '|' || fp, chr(10) ORDER BY direction || '|' || fp)) AS fingerprint FROM f GROUP BY character""")
def release_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = M.fingerprint(A.samples(spark, sf_dir), ["character", "direction"], "sample", "pixel_hash")
    total = clips.groupBy("character").agg(F.sum("files").alias("files"), F.count(F.lit(1)).alias("clips"))
    return total.join(M.fingerprint(clips.drop("files"), ["character"], "direction", "fingerprint").select("character", "fingerprint"), "character")


@query(f"WITH {DATASET}, s AS (SELECT split, count(*) AS n FROM samples GROUP BY split) SELECT split, n::BIGINT AS samples, ceil(n / 4.0)::BIGINT AS updates_per_epoch, ceil(1500.0 / ceil(n / 4.0))::BIGINT AS epochs, (ceil(n / 4.0) * ceil(1500.0 / ceil(n / 4.0)))::BIGINT AS updates, (ceil(n / 4.0) * ceil(1500.0 / ceil(n / 4.0)) - 1500)::BIGINT AS overshoot FROM s")
def schedule_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = A.samples(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("samples"))
    return counts.select("split", "samples", *M.schedule(F.col("samples"), 4, 1500)).select("split", "samples", "updates_per_epoch", "epochs", "updates", "overshoot")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


NAMES = ["torso", "Body", "arm_f", "front-arm", "leg_b", "tail", "head"]
OTHERS = ["leg_f", "back_arm", "torso", "hat", "uarm_f"]
PARTS = f"parts AS (SELECT s_suppkey AS owner, {NAMES}[1 + s_suppkey % 7] AS name FROM supplier UNION ALL SELECT s_suppkey, {OTHERS}[1 + (s_suppkey // 3) % 5] FROM supplier)"
SLOTTED = f"{PARTS}, al(alias, canonical) AS (VALUES {_values(B.BIPED_ALIASES)}), sl(slot, joint, z, px, py) AS (VALUES {_values(B.BIPED_SLOTS)}), named AS (SELECT owner, name, coalesce(canonical, replace(lower(name), '-', '_')) AS slot FROM parts LEFT JOIN al ON alias = replace(lower(name), '-', '_'))"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    suppliers = A.table(spark, sf_dir, "supplier")
    a = suppliers.select(key.alias("owner"), pick(NAMES, key % 7).alias("name"))
    return a.unionByName(suppliers.select(key.alias("owner"), pick(OTHERS, F.floor(key / 3) % 5).alias("name")))


@query(f"WITH {SLOTTED} SELECT owner, name, named.slot, joint, z::INT AS z, px::DOUBLE AS pivot_x, py::DOUBLE AS pivot_y FROM named LEFT JOIN sl ON sl.slot = named.slot")
def alias_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.slotted(_parts(spark, sf_dir), "name").select("owner", "name", "slot", "joint", "z", "pivot_x", "pivot_y")


@query(f"WITH {SLOTTED} SELECT owner, slot, 'unknown' AS rule FROM named WHERE slot NOT IN (SELECT slot FROM sl) UNION ALL SELECT owner, slot, 'repeated' FROM named WHERE slot IN (SELECT slot FROM sl) GROUP BY owner, slot HAVING count(*) > 1")
def slot_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.slot_faults(B.slotted(_parts(spark, sf_dir), "name"), "owner")


@query(f"""WITH {SLOTTED}, own AS (SELECT DISTINCT owner, slot FROM named WHERE slot IN (SELECT slot FROM sl)), pr(slot, other) AS (VALUES {_values(B.BIPED_MIRRORS + [(b, a) for a, b in B.BIPED_MIRRORS])})
        SELECT owner, slot, NULL::VARCHAR AS from_slot, false AS derived FROM own UNION ALL SELECT o.owner, pr.other, o.slot, true FROM own o JOIN pr USING (slot) WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.owner = o.owner AND x.slot = pr.other)""")
def mirrored_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_mirrors(B.slotted(_parts(spark, sf_dir), "name").where("joint IS NOT NULL"))


@query(f"WITH {SLOTTED} SELECT slot, CASE WHEN a THEN 'unmapped' ELSE 'unknown' END AS state FROM (SELECT DISTINCT slot, true AS a FROM named WHERE slot NOT IN (SELECT slot FROM sl) UNION ALL SELECT slot, false FROM sl WHERE slot NOT IN (SELECT slot FROM named))")
def unmapped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.unmapped(B.slotted(_parts(spark, sf_dir), "name").select("slot").distinct(), B.slots(spark).select("slot"), "slot")


@query(f"""WITH kit(slot, joint, k) AS (VALUES {_values([(s, j, k) for k, (s, j, *_) in enumerate(B.BIPED_SLOTS)] + [("hat", None, 18)])}),
        parts AS (SELECT c_custkey AS owner, slot, CASE WHEN (c_custkey + k) % 29 = 0 THEN 'root' ELSE joint END AS joint FROM customer, kit WHERE (c_custkey * 7 + k * k * 5 + c_custkey * k) % 11 > 1),
        h AS (SELECT owner, list(DISTINCT slot) FILTER (WHERE slot NOT IN ('legs', 'hat')) AS s FROM parts GROUP BY owner)
        SELECT owner, 'missing head' AS fault FROM h WHERE NOT coalesce(list_contains(s, 'head'), false) UNION ALL SELECT owner, 'missing torso' FROM h WHERE NOT coalesce(list_contains(s, 'torso'), false)
        UNION ALL SELECT owner, 'missing arms' FROM h WHERE NOT coalesce(list_has_all(s, ['arm_f', 'arm_b']) OR list_has_all(s, ['uarm_f', 'farm_f', 'uarm_b', 'farm_b']), false) UNION ALL SELECT owner, 'missing legs' FROM h WHERE NOT coalesce(list_has_all(s, ['leg_f', 'leg_b']) OR list_has_all(s, ['thigh_f', 'shin_f', 'thigh_b', 'shin_b']), false)
        UNION ALL SELECT owner, 'mixed arms' FROM h WHERE list_has_any(s, ['arm_f', 'arm_b']) AND list_has_any(s, ['uarm_f', 'uarm_b', 'farm_f', 'farm_b']) UNION ALL SELECT owner, 'mixed legs' FROM h WHERE list_has_any(s, ['leg_f', 'leg_b']) AND list_has_any(s, ['thigh_f', 'thigh_b', 'shin_f', 'shin_b'])
        UNION ALL SELECT owner, 'unsupported ' || slot FROM parts WHERE slot IN ('legs', 'hat') UNION ALL SELECT owner, 'joint of ' || slot FROM parts WHERE joint = 'root' AND slot NOT IN ('legs', 'hat')""")
def part_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    kit = spark.createDataFrame([(s, j, k) for k, (s, j, *_) in enumerate(B.BIPED_SLOTS)] + [("hat", None, 18)], "slot string, joint string, k int")
    owners = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.explode(F.sequence(F.lit(0), F.lit(18))).alias("k")).where((F.col("owner") * 7 + F.col("k") * F.col("k") * 5 + F.col("owner") * F.col("k")) % 11 > 1)
    parts = owners.join(F.broadcast(kit), "k").withColumn("joint", F.when((F.col("owner") + F.col("k")) % 29 == 0, "root").otherwise(F.col("joint")))  # 19 rows
    return B.part_faults(parts)


@query("""WITH parts AS (SELECT p_partkey AS owner, p_size + 20 AS a, p_size % 13 + 9 AS b, p_size % 7 + 5 AS c FROM part), e AS (SELECT *, 512 * 0.66 / (a + (b + 4) + (a + c)) AS sc FROM parts),
        f AS (SELECT *, greatest(1, round_even(a * sc, 0)) AS head_h, greatest(1, round_even((b + 4) * sc, 0)) AS torso_h, greatest(1, round_even(b * sc, 0)) AS torso_w, greatest(1, round_even((a + c) * sc, 0)) AS leg_h, greatest(1, round_even(c * sc, 0)) AS arm_h FROM e)
        SELECT owner, 472::INT AS canvas_w, 512::INT AS canvas_h, round(sc, 9)::DOUBLE AS scale, u.joint, u.parent, u.ox::DOUBLE AS ox, u.oy::DOUBLE AS oy FROM f, LATERAL (SELECT unnest([
            {'joint': 'root', 'parent': NULL, 'ox': 236.0::DOUBLE, 'oy': round_even(512 * 0.82 - leg_h * 0.92 * 0.92, 3)::DOUBLE}, {'joint': 'spine', 'parent': 'root', 'ox': 0, 'oy': 0}, {'joint': 'neck', 'parent': 'spine', 'ox': 0, 'oy': round_even(torso_h * -0.55, 3)},
            {'joint': 'sh_f', 'parent': 'spine', 'ox': round_even(torso_w * 0.06, 3), 'oy': round_even(torso_h * -0.50, 3)}, {'joint': 'hip_f', 'parent': 'root', 'ox': round_even(torso_w * 0.10, 3), 'oy': 0}, {'joint': 'hip_b', 'parent': 'root', 'ox': round_even(torso_w * -0.10, 3), 'oy': 0},
            {'joint': 'grip', 'parent': 'sh_f', 'ox': 0, 'oy': round_even(arm_h * 0.75, 3)}]) AS u)""")
def rig_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeletons by the sizes of head, torso, legs, an arm and a weapon."""
    size = F.col("p_size")
    a, b, c = size + 20, size % 13 + 9, size % 7 + 5
    kit = [("head", b, a), ("torso", b, b + 4), ("leg_f", c, a + c), ("leg_b", c, a + c), ("arm_f", c, c), ("weapon", c, c)]
    parts = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("owner"), F.explode(F.array(*(F.struct(F.lit(s).alias("slot"), w.alias("w"), h.alias("h")) for s, w, h in kit))).alias("p")).select("owner", "p.*")
    return B.skeletons(parts, 512).withColumn("scale", F.round("scale", 9))


@query("""WITH s AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split, source || (doc_id % 3) AS character, md5(left(text, 40)) AS ih, md5(text) AS th FROM documents),
        e AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY id) + CASE WHEN id % 97 = 3 THEN 1 ELSE 0 END AS idx, id + CASE WHEN id % 50 = 7 THEN 1000000 ELSE 0 END AS sample FROM s),
        b AS (SELECT split, 'i' AS k, ih AS h FROM s UNION ALL SELECT split, 't', th FROM s), p AS (SELECT h, count(*) FILTER (WHERE split = 'train' AND k = 'i') AS ti, count(*) FILTER (WHERE split = 'train' AND k = 't') AS tt, count(*) FILTER (WHERE split <> 'train' AND k = 'i') AS vi, count(*) FILTER (WHERE split <> 'train' AND k = 't') AS vt FROM b WHERE h IS NOT NULL GROUP BY h)
        SELECT 'train_input_repeats' AS gate, 'error' AS severity, h AS subject FROM p WHERE ti > 1 UNION ALL SELECT 'train_target_repeats', 'error', h FROM p WHERE tt > 1 UNION ALL SELECT 'validation_input_repeats', 'error', h FROM p WHERE vi > 1 UNION ALL SELECT 'validation_target_repeats', 'error', h FROM p WHERE vt > 1
        UNION ALL SELECT 'target_in_both', 'error', h FROM p WHERE tt > 0 AND vt > 0 UNION ALL SELECT 'picture_in_both', 'error', h FROM p WHERE ti + tt > 0 AND vi + vt > 0
        UNION ALL SELECT 'character_in_both', 'error', character FROM s WHERE character IS NOT NULL GROUP BY character HAVING count(DISTINCT split) > 1
        UNION ALL SELECT 'entry_order', 'error', split FROM e GROUP BY split HAVING min(idx) <> 1 OR max(idx) <> count(*) OR count(DISTINCT idx) <> count(*)
        UNION ALL SELECT 'entry_without_sample', 'error', split || '/' || sample FROM e WHERE (split, sample) NOT IN (SELECT (split, id) FROM s) UNION ALL SELECT 'sample_without_entry', 'error', split || '/' || id FROM s WHERE (split, id) NOT IN (SELECT (split, sample) FROM e)
        UNION ALL SELECT 'few_samples', 'warning', count(*)::VARCHAR FROM s WHERE split = 'train' HAVING count(*) < 100000""")
def dataset_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    docs = A.table(spark, sf_dir, "documents")
    samples = docs.select(key.alias("id"), F.when(key % 5 == 0, "validation").otherwise("train").alias("split"), F.concat("source", (key % 3).cast("string")).alias("character"), F.md5(F.left("text", F.lit(40)).cast("binary")).alias("input_hash"), F.md5(F.col("text").cast("binary")).alias("target_hash"))
    entries = S.numbered(samples, "split", "id").select("split", (F.col("ordinal") + F.when(F.col("id") % 97 == 3, 1).otherwise(0)).alias("index"), (F.col("id") + F.when(F.col("id") % 50 == 7, 1_000_000).otherwise(0)).alias("sample"))
    return I.dataset_faults(samples, entries, 100_000)


@query("""WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, (CASE WHEN l_orderkey % 11 = 4 THEN '../' ELSE '' END) || 'w/' || (CASE WHEN l_orderkey % 7 = 2 THEN 9 - l_linenumber WHEN l_orderkey % 7 = 3 THEN 1 ELSE l_linenumber END) || '.bin' AS path, l_quantity::BIGINT AS bytes, CASE WHEN l_orderkey % 13 = 6 THEN upper(sha256(l_partkey::VARCHAR)) ELSE sha256(l_partkey::VARCHAR) END AS sha FROM lineitem),
        g AS (SELECT k, list({'p': path, 'b': bytes, 's': sha} ORDER BY n) AS fs, count(*) AS n, sum(bytes)::BIGINT AS total, '[' || string_agg('{"bytes":' || bytes || ',"path":"' || path || '","sha256":"' || sha || '"}', ',' ORDER BY n) || ']' AS js FROM f GROUP BY k),
        h AS (SELECT k, array_to_string(list_filter([CASE WHEN k % 17 = 5 THEN 'file_count' END, CASE WHEN len(list_distinct(list_transform(fs, lambda x: x.p))) <> n THEN 'unique' END, CASE WHEN list_sort(list_transform(fs, lambda x: x.p)) <> list_transform(fs, lambda x: x.p) THEN 'sorted' END, CASE WHEN k % 19 = 5 THEN 'bytes' END,
            CASE WHEN k % 11 = 4 THEN 'paths' END, CASE WHEN k % 13 = 6 THEN 'digests' END, CASE WHEN k % 23 = 5 THEN 'fingerprint' END], lambda x: x IS NOT NULL), ',') AS faults FROM g) SELECT * FROM h""")
def lock_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locks of an order's lines as files, some of them broken one way or another."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    sha = F.sha2(F.col("l_partkey").cast("string").cast("binary"), 256)
    name = F.when(k % 7 == 2, 9 - n).when(k % 7 == 3, 1).otherwise(n).cast("string")
    path = F.concat(F.when(k % 11 == 4, "../").otherwise(""), F.lit("w/"), name, F.lit(".bin"))
    files = A.table(spark, sf_dir, "lineitem").select(k.alias("k"), n.alias("n"), F.struct(path.alias("path"), F.col("l_quantity").cast("long").alias("bytes"), F.when(k % 13 == 6, F.upper(sha)).otherwise(sha).alias("sha256")).alias("f"))
    locks = files.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "f")))["f"].alias("files"))  # a lock's files: a handful
    total = F.aggregate("files", F.lit(0).cast("long"), lambda s, f: s + f["bytes"])
    locks = locks.select("k", "files", (F.size("files") + F.when(F.col("k") % 17 == 5, 1).otherwise(0)).alias("file_count"), (total + F.when(F.col("k") % 19 == 5, 1).otherwise(0)).alias("total_bytes"), F.sha2(F.concat(I.canonical_files(F.col("files")), F.when(F.col("k") % 23 == 5, " ").otherwise("")).cast("binary"), 256).alias("fingerprint"))
    return I.lock_faults(locks).select("k", F.array_join("faults", ",").alias("faults"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE array_to_string(list_filter(['a', 'b', 'c'], lambda x: (x = 'a' AND c_custkey % 2 = 0) OR (x = 'b' AND c_custkey % 3 = 0) OR (x = 'c' AND c_custkey % 5 = 0)), ',') END AS invalid FROM customer""")
def workflow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    node = lambda name, broken, good, bad: F.concat(F.lit(f'"{name}":'), F.when(broken, F.lit(bad)).otherwise(F.lit(good)))
    good = '{"class_type":"Load","inputs":{"x":1}}'
    text = F.concat(F.lit("{"), node("c", key % 5 == 0, good, '{"class_type":7,"inputs":{}}'), F.lit(","), node("b", key % 3 == 0, good, '{"class_type":"Load","inputs":[1]}'), F.lit(","), node("a", key % 2 == 0, good, '"text"'), F.lit("}"))
    rows = A.table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 6 == 5, "[]").otherwise(text).alias("text"))
    return I.workflow_faults(rows, "text").select("c_custkey", F.array_join("invalid", ",").alias("invalid"))


@query("""WITH c AS (SELECT event_type AS clip, count(*) % 2 = 0 AS loop FROM events GROUP BY 1), p AS (SELECT clip, 6 + length(clip) AS fps, length(clip) % 2 = 0 AS loop FROM c WHERE clip <> 'click')
        SELECT c.clip, c.loop, coalesce(p.fps, 8)::DOUBLE AS fps, CASE WHEN p.clip IS NULL THEN 'no contract' WHEN c.loop <> p.loop THEN 'loop' END AS fault FROM c LEFT JOIN p USING (clip)""")
def profile_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = A.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("clip")).agg((F.count(F.lit(1)) % 2 == 0).alias("loop")).withColumn("fps", F.lit(8.0))
    size = F.length("clip")
    return B.with_speed(clips, clips.where("clip <> 'click'").select("clip", (size + 6).alias("fps"), (size % 2 == 0).alias("loop")))


@query(f"WITH {DATASET} SELECT s.split, count(samples.sample)::BIGINT AS samples FROM (VALUES ('train'), ('validation'), ('test')) s(split) LEFT JOIN samples USING (split) GROUP BY s.split")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.split_counts(A.samples(spark, sf_dir), ("train", "validation", "test"))


@query("""WITH p AS (SELECT p_partkey % 40 AS host, p_name || p_partkey AS label, CASE WHEN p_size % 3 > 0 THEN 'dev' || (p_size % 5) END AS device, CASE WHEN p_size % 2 = 0 THEN '/anchor' END AS anchor, p_size % 4 > 0 AS checked, p_size::DOUBLE AS free FROM part)
        SELECT coalesce(device, anchor, label) AS device, string_agg(label, ',' ORDER BY label) AS labels, min(free) AS free FROM p WHERE checked AND free < 20 GROUP BY 1""")
def low_disk_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    paths = A.table(spark, sf_dir, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("label"), F.when(size % 3 > 0, F.concat(F.lit("dev"), (size % 5).cast("string"))).alias("device"), F.when(size % 2 == 0, "/anchor").alias("anchor"), (size % 4 > 0).alias("checked"), size.cast("double").alias("free"))
    return I.low_disk(paths, 20.0).withColumn("labels", F.array_join("labels", ","))


@query("""WITH n AS (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS k, count(*) OVER (PARTITION BY s_nationkey) AS total FROM supplier)
        SELECT s_nationkey, string_agg(s_name, ', ' ORDER BY k) || CASE WHEN any_value(total) > 5 THEN ', ... (' || any_value(total) || ' total)' ELSE '' END AS text FROM n WHERE k <= 5 GROUP BY s_nationkey""")
def conflicting_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.conflicts(A.table(spark, sf_dir, "supplier"), "s_nationkey", "s_name")


@query("""WITH h AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS have FROM conversations GROUP BY conv_id), w AS (SELECT ['assistant', 'system', 'user'] AS want)
        SELECT conv_id, array_to_string(list_sort(list_filter(want, lambda x: NOT list_contains(have, x))), ',') AS missing, array_to_string(list_sort(list_filter(have, lambda x: NOT list_contains(want, x))), ',') AS unknown FROM h, w""")
def required_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("have"))
    out = M.set_difference(per, F.array(F.lit("assistant"), F.lit("system"), F.lit("user")), F.col("have"))
    return out.select("conv_id", F.array_join("missing", ",").alias("missing"), F.array_join("unknown", ",").alias("unknown"))


@query("""SELECT p_partkey, (64 + p_size * 16)::INT AS w, array_to_string(list_filter([CASE WHEN NOT (64 + p_size * 16 BETWEEN 64 AND 4096 AND (64 + p_size * 16) % 16 = 0) THEN 'width' END, CASE WHEN NOT (p_size * 24 BETWEEN 64 AND 4096 AND (p_size * 24) % 16 = 0) THEN 'height' END,
        CASE WHEN (64 + p_size * 16) % 3 <> 0 THEN 'columns' END, CASE WHEN (p_size * 24) % 3 <> 0 THEN 'rows' END, CASE WHEN p_size > 8 THEN 'capacity' END], lambda x: x IS NOT NULL), ',') AS faults FROM part""")
def board_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    three = F.lit(3)
    return A.table(spark, sf_dir, "part").select("p_partkey", (size * 16 + 64).alias("w"), F.array_join(M.geometry_faults(size * 16 + 64, size * 24, three, three, size), ",").alias("faults"))


# ---- text


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*/', CASE WHEN page_id % 5 = 0 THEN '../' WHEN page_id % 7 = 0 THEN '/' ELSE '' END) AS path FROM pages)
        SELECT page_id, path, path <> '' AND NOT regexp_matches(path, '^([/~]|[A-Za-z]:)|\\|(^|/)\.\.(/|$)') AS safe FROM p""")
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.when(F.col("page_id") % 5 == 0, "../").when(F.col("page_id") % 7 == 0, "/").otherwise("")
    path = F.concat(lead, F.regexp_replace("url", "^https?://[^/]*/", ""))
    # only what the pattern replaces gets the lead
    path = F.when(F.col("url").rlike("^https?://[^/]*/"), path).otherwise(F.col("url"))
    return A.table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("safe", C.safe_path(F.col("path")))


@query("SELECT event_id, json_valid(props) AS valid, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.try_parse_json("props")
    return A.table(spark, sf_dir, "events").select("event_id", parsed.isNotNull().alias("valid"), F.try_variant_get(parsed, "$.k", "bigint").alias("k"))


@query("SELECT n_nationkey, n_name, ((('0x' || left(sha256(n_name), 16))::UBIGINT) % 2147483647)::INT AS seed FROM nation")
def deterministic_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", C.seed(F.col("n_name")).alias("seed"))


def _prompt_sql() -> str:
    told = lambda flag, texts: f"CASE WHEN {flag} THEN '{texts[0]}' ELSE '{texts[1]}' END"
    frames = "(c_nationkey + 1)"
    values = ["'walk'", "c_name", "'left'", frames, "2", "4", told("c_custkey % 2 = 0", C.REFERENCE), told("c_custkey % 3 = 0", C.GUIDE), frames, "'walk'"]
    pieces = C.PROMPT.replace("'", "''").split("%s")
    return " || ".join(x for text, value in zip(pieces, [*values, None], strict=True) for x in (f"'{text}'", value) if x)


@query(f"""SELECT c_custkey, 'res://' || lower(c_mktsegment) || '/clip' AS path, {_prompt_sql()} AS prompt FROM customer""")
def prefix_and_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.joined_prefix(F.concat(F.lit("res://"), F.lower("c_mktsegment"), F.lit("//")), F.lit("/clip/"))
    return A.table(spark, sf_dir, "customer").select("c_custkey", path.alias("path"), C.prompt(F.col("c_name"), F.lit("walk"), F.col("c_nationkey") + 1, F.lit("left"), F.lit(2), F.lit(4), F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3 == 0).alias("prompt"))


@query("""SELECT s_suppkey, s_suppkey % 10 AS a, least(5, greatest(2, s_nationkey))::INT AS clamped, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE (s_nationkey * 10000 + (s_suppkey % 10) * 100 + 7)::INT END AS version FROM supplier""")
def option_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.concat(F.lit("a="), (F.col("s_suppkey") % 10).cast("string"), F.lit(",b="), F.col("s_nationkey").cast("string"))
    told = F.when(F.col("s_suppkey") % 3 == 0, F.lit("unknown")).otherwise(F.concat_ws(".", F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 10).cast("string"), F.lit("7-rc1")))
    v = C.version(told)
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", C.assignments(given)["a"].cast("long").alias("a"), C.clamped(C.assignments(given)["b"], F.lit(2), F.lit(5)).alias("clamped"), (v[0] * 10000 + v[1] * 100 + v[2]).alias("version"))


# ---- assembly


@query("""WITH s AS (SELECT p_partkey, (p_size + 10)::INT AS w, (p_size % 7 + 4)::INT AS h FROM part) SELECT p_partkey, c::INT AS cell, (w * (c % 3) // 3)::INT AS x0, (h * (c // 3) // 2)::INT AS y0, (w * (c % 3 + 1) // 3)::INT AS x1, (h * (c // 3 + 1) // 2)::INT AS y1, ((w + 2) // 3)::INT AS canvas_w, ((h + 1) // 2)::INT AS canvas_h FROM s, range(0, 6) t(c)""")
def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import assembly

    sheets = A.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 10).alias("w"), (F.col("p_size") % 7 + 4).alias("h"))
    return assembly.sheet_cells(sheets, 3, 2).drop("w", "h")


@query(f"WITH {raster_sql(A.MEDIUM)}, {BOARDS} SELECT board, (cell % 3 * 10 + 1 + x)::INT AS bx, (cell // 3 * 10 + 1 + y)::INT AS by, r, g, b FROM bd WHERE a > 20")
def board_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import assembly

    cut = A.boards(spark, sf_dir, A.MEDIUM)
    px = cut.select("board", "cell", "w", F.posexplode(F.arrays_zip("r", "g", "b", "a")).alias("i", "p")).select("board", "cell", (F.col("i") % F.col("w")).alias("x"), F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), "p.*")
    return assembly.board_pixels(px.where("a > 20"), 3, 10, 8).select("board", "bx", "by", "r", "g", "b")
