"""Queries that put frames together: layouts, shared palettes, normalised clips."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly as P
from ..operators import palettes
from ..operators import rasters as R
from ..operators import references, regions
from ..sources import adapters as A
from .catalogue import BOARDS, METRICS, SPARSE, label_sql, query, raster_sql, reach_sql

#: setting, canvas, anchor, padding, may grow
LAYOUTS = [("small", (6, 6), (4, 5), 0, False), ("padded", (40, 40), (20, 37), 3, False), ("wide", (14, 14), (6, 8), 1, False), ("union", None, None, 2, False), ("grown", (40, 40), (20, 37), 3, True), ("tiny", (4, 4), (2, 3), 1, False)]


def _feet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and feet of frames with their own canvas; every seventh clip has two different canvases."""
    metrics = R.frame_metrics(A.packed(spark, sf_dir, A.SPARSE))
    return metrics.withColumns({"w": F.when((F.col("clip") % 7 == 0) & (F.col("frame") % 2 == 0), 9).otherwise(8), "h": F.lit(8)})


def _values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()
    return ", ".join(f"({', '.join(map(show, r))})" for r in rows)


_FLAT = [(n, *(c or (None, None)), *(a or (None, None)), p, g) for n, c, a, p, g in LAYOUTS]
FEET = "ft AS (SELECT * EXCLUDE (w, h), (CASE WHEN clip % 7 = 0 AND frame % 2 = 0 THEN 9 ELSE 8 END)::INT AS w, 8 AS h FROM metrics)"
_RATIO = "CASE WHEN {0} > 0 THEN greatest(0, {1})::DOUBLE / ({0}) ELSE 'inf'::DOUBLE END".format
SOLVED = f"""s(setting, cw0, ch0, ax0, ay0, pad, grow) AS (VALUES {_values(_FLAT)}),
        b AS (SELECT clip, min(x0) AS bl, min(y0) AS bt, max(x1) AS br, max(y1) AS bb, max(w) AS sw, min(w) AS lw, max(h) AS sh FROM ft GROUP BY clip),
        cv AS (SELECT *, coalesce(cw0, sw + 2 * pad)::INT AS cw, coalesce(ch0, sh + 2 * pad)::INT AS ch FROM s, b),
        an AS (SELECT *, coalesce(ax0, cw // 2)::INT AS ax, coalesce(ay0, ch - pad - 1)::INT AS ay FROM cv),
        fr AS (SELECT an.*, least({_RATIO('foot_x - bl', 'ax - pad')}, {_RATIO('br - 1 - foot_x', 'cw - pad - 1 - ax')}, {_RATIO('foot_y - bt', 'ay - pad')}, {_RATIO('bb - 1 - foot_y', 'ch - 1 - ay')}) AS q FROM an JOIN ft USING (clip)),
        mn AS (SELECT setting, clip, cw, ch, ax, ay, grow, bl, bt, br, bb, sw, lw, sh, min(q) AS q FROM fr GROUP BY ALL),
        sc AS (SELECT *, CASE WHEN isinf(q) THEN 1.0::DOUBLE WHEN grow THEN q ELSE least(1.0::DOUBLE, q) END AS scale FROM mn),
        solved AS (SELECT setting, clip, cw AS canvas_w, ch AS canvas_h, ax AS anchor_x, ay AS anchor_y, scale::DOUBLE AS scale, greatest(1, round_even(sw * scale, 0))::INT AS target_w, greatest(1, round_even(sh * scale, 0))::INT AS target_h,
            CASE WHEN sw <> lw THEN 'frames have different canvases' WHEN scale <= 0 OR least(br - bl, bb - bt) * scale < 4 THEN 'bounds would shrink below 4 pixels' END AS fault FROM sc)"""


@query(f"{SPARSE}, {FEET}, {SOLVED} SELECT * FROM solved")
def layout_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips on one canvas, for six settings."""
    feet = _feet(spark, sf_dir)
    every = [P.layout(feet, canvas, anchor, padding, grow).withColumn("setting", F.lit(name)) for name, canvas, anchor, padding, grow in LAYOUTS]
    return reduce(DataFrame.unionByName, every)


@query(f"""{SPARSE}, {FEET}, {SOLVED} SELECT frame, clip, canvas_w, canvas_h, target_w, target_h, (anchor_x - round_even(foot_x * scale, 0))::INT AS "left", (anchor_y - round_even(foot_y * scale, 0))::INT AS top
        FROM ft JOIN solved USING (clip) WHERE setting = 'wide' AND fault IS NULL""")
def shared_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    feet = _feet(spark, sf_dir)
    name, canvas, anchor, padding, grow = LAYOUTS[2]
    return P.placed(feet, P.layout(feet, canvas, anchor, padding, grow))


def fitted_sql(metrics: str, canvas: tuple[int, int] | None, anchor: tuple[int, int] | None, pad: int, content: tuple[int, int] | None, grow: bool) -> str:
    """CTEs up to ``fitted``: boxes of ``metrics`` fitted one by one."""
    cw, ch = canvas or (f"max(w) OVER (PARTITION BY clip) + {2 * pad}", f"max(h) OVER (PARTITION BY clip) + {2 * pad}")
    ax, ay = anchor or ("cw // 2", f"ch - {pad} - 1")
    to = "greatest(1, round_even({0} * q, 0))::INT".format
    small = f"SELECT *, least({content[0]}.0::DOUBLE / w, {content[1]}.0::DOUBLE / h) AS q FROM f0" if content else "SELECT *, 1.0::DOUBLE AS q FROM f0"
    keep = "abs(q - 1) < 1e-9" if grow else "(q >= 1 OR abs(q - 1) < 1e-9)"
    return f"""f0 AS (SELECT frame, clip, x1 - x0 AS w, y1 - y0 AS h FROM {metrics}), f1 AS ({small}),
        f2 AS (SELECT frame, clip, CASE WHEN q < 1 THEN {to('w')} ELSE w END AS w, CASE WHEN q < 1 THEN {to('h')} ELSE h END AS h FROM f1),
        f3 AS (SELECT *, ({cw})::INT AS cw, ({ch})::INT AS ch FROM f2), f4 AS (SELECT *, ({ax})::INT AS ax, ({ay})::INT AS ay FROM f3),
        f5 AS (SELECT *, least(greatest(1, cw - {2 * pad})::DOUBLE / w, greatest(1, ay - {pad} + 1)::DOUBLE / h) AS q FROM f4),
        f6 AS (SELECT *, CASE WHEN {keep} THEN w ELSE {to('w')} END AS tw, CASE WHEN {keep} THEN h ELSE {to('h')} END AS th FROM f5),
        fitted AS (SELECT frame, clip, cw AS canvas_w, ch AS canvas_h, tw::INT AS target_w, th::INT AS target_h, (ax - tw // 2)::INT AS "left", (ay - th + 1)::INT AS top FROM f6)"""


FITS = {"fixed": ((9, 8), (4, 6), 1, (6, 5), False), "common": (None, None, 2, None, False), "grown": ((32, 24), (16, 20), 2, None, True)}


@query(SPARSE + ", " + ", ".join(f"{k} AS (WITH {fitted_sql('metrics', *v)} SELECT '{k}' AS setting, * FROM fitted)" for k, v in FITS.items()) + " SELECT * FROM fixed UNION ALL SELECT * FROM common UNION ALL SELECT * FROM grown")
def anchored_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames cut out, fitted one by one and stood on the anchor, for three settings."""
    metrics = R.frame_metrics(A.packed(spark, sf_dir, A.SPARSE))
    return reduce(DataFrame.unionByName, [P.fitted(metrics, *v).withColumn("setting", F.lit(k)) for k, v in FITS.items()])


def palette_sql(source: str, k: int) -> str:
    """CTEs up to ``palette``: median cut of the opaque pixels of ``source``, all boxes at each level."""
    levels = k.bit_length() - 1
    out = [f"hist AS (SELECT clip, r, g, b, count(*) AS n FROM {source} WHERE a > 20 GROUP BY ALL)", f"b0 AS (SELECT *, 1::BIGINT AS box FROM hist WHERE clip IN (SELECT clip FROM hist GROUP BY clip HAVING count(*) > {k}))"]
    for i in range(levels):
        out.append(f"""v{i} AS (SELECT clip, box, ch, v, sum(n) AS n FROM (SELECT clip, box, 0 AS ch, r AS v, n FROM b{i} UNION ALL SELECT clip, box, 1, g, n FROM b{i} UNION ALL SELECT clip, box, 2, b, n FROM b{i}) GROUP BY ALL),
        w{i} AS (SELECT clip, box, ch, v, sum(n) OVER (PARTITION BY clip, box, ch ORDER BY v) AS below, sum(n) OVER (PARTITION BY clip, box, ch) AS total, max(v) OVER (PARTITION BY clip, box, ch) AS top, min(v) OVER (PARTITION BY clip, box, ch) AS low FROM v{i}),
        c{i} AS (SELECT clip, box, ch, top - low AS wide, least(min(v) FILTER (below * 2 >= total), max(v) FILTER (v < top)) AS cut FROM w{i} WHERE top > low GROUP BY clip, box, ch, top, low),
        s{i} AS (SELECT * FROM c{i} QUALIFY row_number() OVER (PARTITION BY clip, box ORDER BY wide DESC, ch) = 1),
        b{i + 1} AS (SELECT clip, r, g, b, n, box * 2 + (CASE WHEN cut IS NOT NULL AND (CASE ch WHEN 0 THEN r WHEN 1 THEN g ELSE b END) > cut THEN 1 ELSE 0 END) AS box FROM b{i} LEFT JOIN s{i} USING (clip, box))""")
    mean = lambda c: f"floor(sum({c} * n)::DOUBLE / sum(n) + 0.5)::INT AS {c}"
    out.append(f"bx AS (SELECT clip, box, {', '.join(map(mean, 'rgb'))}, sum(n)::BIGINT AS pixels FROM b{levels} GROUP BY clip, box)")
    out.append("palette AS (SELECT clip, (row_number() OVER (PARTITION BY clip ORDER BY box) - 1)::INT AS entry, r, g, b, pixels FROM bx)")
    return ", ".join(out)


@query(f"WITH {raster_sql(A.MEDIUM)}, {palette_sql('raster', 16)} SELECT * FROM palette")
def shared_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palettes.shared_palette(palettes.histogram(A.pixels(spark, sf_dir, A.MEDIUM)), 16)


@query(f"""WITH {raster_sql(A.MEDIUM)}, {METRICS}, {fitted_sql('metrics', (16, 16), (8, 14), 1, None, True)},
        cell AS (SELECT f.*, m.x0, m.y0, m.x1, m.y1, p, p % 16 - "left" AS x, p // 16 - top AS y FROM fitted f JOIN metrics m USING (frame), range(0, 256) t(p)),
        src AS (SELECT frame, clip, p, (y0 + (2 * y + 1) * (y1 - y0) // (2 * target_h)) * 8 + x0 + (2 * x + 1) * (x1 - x0) // (2 * target_w) AS i FROM cell WHERE x BETWEEN 0 AND target_w - 1 AND y BETWEEN 0 AND target_h - 1),
        drawn AS (SELECT src.frame, src.clip, p, r, g, b, a FROM src JOIN raster USING (frame, i)), {palette_sql('drawn', 8)},
        near AS (SELECT h.clip, h.r, h.g, h.b, arg_min(struct_pack(r := q.r, g := q.g, b := q.b), ((q.r - h.r) * (q.r - h.r) + (q.g - h.g) * (q.g - h.g) + (q.b - h.b) * (q.b - h.b)) * 16 + entry) AS c FROM (SELECT DISTINCT clip, r, g, b FROM drawn WHERE a > 20) h JOIN palette q USING (clip) GROUP BY ALL),
        done AS (SELECT d.frame, d.p, coalesce(c.r, d.r) AS r, coalesce(c.g, d.g) AS g, coalesce(c.b, d.b) AS b FROM drawn d LEFT JOIN near USING (clip, r, g, b) WHERE a > 20)
        SELECT frame, count(*)::BIGINT AS opaque, count(DISTINCT r * 65536 + g * 256 + b)::BIGINT AS colours, max(p // 16)::INT AS foot_y, sum((r * 65536 + g * 256 + b)::BIGINT * (p + 1))::BIGINT AS digest FROM done GROUP BY frame""")
def normalised_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames cut to their boxes, fitted to 16 x 16 and stood on an anchor, with eight colours a clip."""
    frames = A.packed(spark, sf_dir, A.MEDIUM)
    metrics = R.frame_metrics(frames)
    drawn = A.exploded(P.redrawn(frames, P.fitted(metrics, (16, 16), (8, 14), 1, None, True), metrics)).where("a > 20")
    done = palettes.recoloured(drawn, palettes.shared_palette(palettes.histogram(drawn), 8))
    colour = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    return done.groupBy("frame").agg(F.count(F.lit(1)).alias("opaque"), F.count_distinct(colour).alias("colours"), F.max("y").alias("foot_y"), F.sum(colour.cast("long") * (F.col("i") + 1)).alias("digest"))


# ---- regions as runs


def _mask(frames: DataFrame, opaque: bool = True) -> DataFrame:
    return frames.withColumn("mask", F.transform("a", lambda a: (a > 20) if opaque else (a <= 20)))


@query(label_sql(A.MEDIUM, "SELECT frame, clip, x, y FROM raster WHERE a > 20") + """, box AS (SELECT frame, root, count(*) AS area, min(y) AS t, min(x) AS l, max(y) + 1 AS b, max(x) + 1 AS r FROM lab GROUP BY ALL)
        SELECT frame, (root // 8)::INT AS y, (root % 8)::INT AS x, area::BIGINT AS area, t::INT AS top, l::INT AS "left", b::INT AS bottom, r::INT AS "right" FROM box""")
def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that touch at corners, named by their first pixel."""
    found = regions.measured(regions.regions(regions.runs(_mask(A.packed(spark, sf_dir, A.MEDIUM)), "frame")))
    return found.select(F.col("image").alias("frame"), F.col("region.y").alias("y"), F.col("region.x0").alias("x"), "area", F.col("y0").alias("top"), F.col("x0").alias("left"), F.col("y1").alias("bottom"), F.col("x1").alias("right"))


@query(reach_sql(A.DENSE, "a <= 20") + """, inn AS (SELECT * FROM cand WHERE (frame, x, y) NOT IN (SELECT (frame, x, y) FROM hit)),
        walk AS (SELECT frame, y * 8 + x AS root, x, y FROM inn UNION SELECT c.frame, w.root, c.x, c.y FROM walk w JOIN inn c ON c.frame = w.frame AND abs(c.x - w.x) <= 1 AND abs(c.y - w.y) <= 1),
        lab AS (SELECT frame, x, y, min(root) AS root FROM walk GROUP BY ALL) SELECT frame, (root // 8)::INT AS y, (root % 8)::INT AS x, count(*)::BIGINT AS area FROM lab GROUP BY ALL""")
def region_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clear regions that reach no side of their image."""
    found = regions.measured(regions.regions(regions.runs(_mask(A.packed(spark, sf_dir, A.DENSE), False), "frame")))
    inner = regions.touching(found, F.lit(A.SIDE), F.lit(A.SIDE)).where(~F.col("edge"))
    return inner.select(F.col("image").alias("frame"), F.col("region.y").alias("y"), F.col("region.x0").alias("x"), "area")


@query("WITH RECURSIVE " + raster_sql(A.OPAQUE) + """, c AS (SELECT frame, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM raster WHERE x IN (0, 7) AND y IN (0, 7) GROUP BY frame),
        cand AS (SELECT frame, x, y FROM raster JOIN c USING (frame) WHERE abs(r - mr) + abs(g - mg) + abs(b - mb) <= 42),
        hit AS (SELECT frame, x, y FROM cand WHERE x IN (0, 7) OR y IN (0, 7) UNION SELECT c.frame, c.x, c.y FROM hit h JOIN cand c ON c.frame = h.frame AND abs(c.x - h.x) <= 1 AND abs(c.y - h.y) <= 1)
        SELECT frame, y::INT AS y, count(*)::BIGINT AS cleared FROM hit GROUP BY frame, y""")
def region_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each row that are like the corners and connected with a side."""
    frames = A.packed(spark, sf_dir, A.OPAQUE)
    labelled = regions.regions(regions.runs(frames.withColumn("mask", regions.like_corners(A.SIDE, A.SIDE, 42)), "frame"))
    outer = regions.touching(regions.measured(labelled), F.lit(A.SIDE), F.lit(A.SIDE)).where("edge").select("image", "region")
    return labelled.join(outer, ["image", "region"], "left_semi").groupBy(F.col("image").alias("frame"), "y").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("cleared"))


@query(f"""WITH RECURSIVE {raster_sql(A.MEDIUM)}, {BOARDS}, cand AS (SELECT board, cell % 3 * 8 + x AS x, cell // 3 * 8 + y AS y FROM bd WHERE a > 20),
        walk AS (SELECT board, y * 24 + x AS root, x, y FROM cand UNION SELECT c.board, w.root, c.x, c.y FROM walk w JOIN cand c ON c.board = w.board AND abs(c.x - w.x) + abs(c.y - w.y) = 1),
        lab AS (SELECT board, x, y, min(root) AS root FROM walk GROUP BY ALL)
        SELECT board, (root // 24)::INT AS y, (root % 24)::INT AS x, count(*)::BIGINT AS area, min(x)::INT AS "left", (max(x) + 1)::INT AS "right" FROM lab GROUP BY board, root""")
def region_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of whole boards, whose cells are tiles in rows of their own; only sides connect."""
    tiles = _mask(A.boards(spark, sf_dir, A.MEDIUM))
    place = (F.col("cell") % 3 * A.SIDE, F.floor(F.col("cell") / 3).cast("int") * A.SIDE)
    found = regions.measured(regions.regions(regions.runs(tiles, "board", left=place[0], top=place[1]), corners=False))
    return found.select(F.col("image").alias("board"), F.col("region.y").alias("y"), F.col("region.x0").alias("x"), "area", F.col("x0").alias("left"), F.col("x1").alias("right"))


@query(label_sql(A.SPARSE, "SELECT DISTINCT c.frame, c.clip, c.x, c.y FROM raster c JOIN raster q ON q.frame = c.frame AND q.a > 20 AND abs(q.x - c.x) <= 2 AND abs(q.y - c.y) <= 2") + """, n AS (SELECT frame, count(DISTINCT root) AS groups FROM lab GROUP BY frame)
        SELECT l.frame, (root // 8)::INT AS y, (root % 8)::INT AS x, count(*) FILTER (WHERE p.a > 20)::BIGINT AS area FROM lab l JOIN raster p ON p.frame = l.frame AND p.x = l.x AND p.y = l.y GROUP BY ALL""")
def region_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opaque pixels of each group of regions that lie within two pixels of each other: the masks are grown before they are labelled."""
    frames = A.packed(spark, sf_dir, A.SPARSE)
    wide = regions.regions(regions.runs(_mask(frames).withColumn("mask", regions.grown(frames, 2)), "frame"))
    px = A.exploded(frames).where("a > 20").select(F.col("frame").alias("image"), "x", "y")
    inside = wide.join(px, ["image", "y"]).where(F.col("x").between(F.col("x0"), F.col("x1")))
    return inside.groupBy(F.col("image").alias("frame"), F.col("region.y").alias("y"), F.col("region.x0").alias("x")).agg(F.count(F.lit(1)).alias("area"))


# ---- fingerprints


def tree_sql(fan: int, levels: int) -> str:
    """CTEs up to ``top``: runs of ``fan`` lines of ``ln`` (g, line), run by run until a group has one node."""
    out = ["n0 AS (SELECT g, line AS d, 1::BIGINT AS c, row_number() OVER (PARTITION BY g ORDER BY line) - 1 AS i, 2 AS n FROM ln WHERE line IS NOT NULL)"]
    for k in range(levels):
        out.append(f"n{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, CASE WHEN max(n) = 1 THEN max(d) ELSE sha256(string_agg(d, chr(10) ORDER BY i)) END AS d, sum(c)::BIGINT AS c, i // {fan} AS i FROM n{k} GROUP BY g, i // {fan}))")
    return ", ".join(out) + f", top AS (SELECT g, c AS lines, d AS fingerprint FROM n{levels})"


@query(f"WITH ln AS (SELECT o_orderstatus AS g, o_orderkey || '|' || o_totalprice::DECIMAL(18, 2) AS line FROM orders), {tree_sql(64, 4)} SELECT g AS o_orderstatus, lines, fingerprint FROM top")
def fingerprint_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.fingerprints import fingerprint_tree

    orders = A.table(spark, sf_dir, "orders")
    return fingerprint_tree(orders, ["o_orderstatus"], F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")), 64)


@query(f"""WITH {raster_sql(A.MEDIUM)}, {BOARDS}, o AS (SELECT board, cell, x, y, a > 20 AS t, r, g, b, a FROM bd), sz AS (SELECT board, max(cell) // 4 + 1 AS rows FROM bd GROUP BY board),
        n AS (SELECT p.board, p.cell, p.x, p.y, p.t, count(*) FILTER (WHERE q.t) AS k FROM o p JOIN o q ON q.board = p.board AND q.cell = p.cell AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 WHERE p.cell > 0 GROUP BY ALL),
        gd AS (SELECT board, cell, x, y, CASE WHEN k BETWEEN 1 AND 8 THEN 2 WHEN t THEN 1 ELSE 0 END AS g FROM n),
        px AS (SELECT board, 'input' AS kind, cell, x, y, CASE g WHEN 2 THEN 244 ELSE 70 END AS r, CASE g WHEN 2 THEN 238 ELSE 104 END AS g2, CASE g WHEN 2 THEN 192 ELSE 138 END AS b FROM gd WHERE g > 0 UNION ALL SELECT board, 'input', cell, x, y, r, g, b FROM o WHERE cell = 0 AND a > 0 UNION ALL SELECT board, 'target', cell, x, y, r, g, b FROM o WHERE a > 0)
        SELECT board, kind, 64 AS board_w, (16 * rows)::INT AS board_h, count(*)::BIGINT AS pixels, sum(r * 65536 + g2 * 256 + b)::BIGINT AS colours, sum((cell // 4 * 16 + 4 + y) * 64 + cell % 4 * 16 + 4 + x)::BIGINT AS places FROM px JOIN sz USING (board) GROUP BY ALL""".replace("px AS (SELECT board, 'input'", "bp AS (SELECT board, 'input'").replace("FROM px JOIN sz", "FROM bp JOIN sz"))
def guide_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of an identity and guides of its poses, beside boards of the poses."""
    px = P.guide_boards(A.boards(spark, sf_dir, A.MEDIUM).drop("frame", "clip"))
    return px.groupBy("board", "kind", "board_w", "board_h").agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("colours"), F.sum(F.col("by") * F.col("board_w") + F.col("bx")).alias("places"))


@query("""WITH b AS (SELECT o_custkey AS image, o_orderkey AS id, (o_orderkey * 37 % 90)::INT AS x0, (o_orderkey * 53 % 70)::INT AS y0, (o_orderkey * 37 % 90 + 2 + o_orderkey % 17)::INT AS x1, (o_orderkey * 53 % 70 + 1 + o_orderkey % 23)::INT AS y1 FROM orders)
        SELECT p.image, p.id AS a, q.id AS b FROM b p JOIN b q ON p.image = q.image AND p.id < q.id WHERE greatest(q.x0 - p.x1, p.x0 - q.x1) <= 9 AND greatest(q.y0 - p.y1, p.y0 - q.y1) <= 9""")
def near_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one customer's orders that are at most nine pixels apart."""
    k = F.col("o_orderkey")
    x0, y0 = (k * 37 % 90).cast("int"), (k * 53 % 70).cast("int")
    boxes = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), k.alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + 2 + k % 17).cast("int").alias("x1"), (y0 + 1 + k % 23).cast("int").alias("y1"))
    return regions.near_boxes(boxes, 9)


# ---- reference pictures


@query(f"WITH {raster_sql(A.MEDIUM)} SELECT frame, 8 AS side, bool_or(a < 255) AS clear, count(DISTINCT r * 65536 + g * 256 + b) FILTER (WHERE a > 20)::INT AS colours, bool_or(a < 255) AND count(DISTINCT r * 65536 + g * 256 + b) FILTER (WHERE a > 20) BETWEEN 1 AND 24 AS usable FROM raster GROUP BY frame")
def usable_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.usable(A.packed(spark, sf_dir, A.MEDIUM), most_colours=24)


@query(f"""WITH {raster_sql(A.MEDIUM)}, c AS (SELECT frame, clip, p, (2 * (p % 12 - 0) + 1) AS x, p // 12 AS y FROM (SELECT vec_id AS frame, label AS clip FROM embeddings), range(0, 168) t(p)),
        d AS (SELECT c.frame, c.clip, c.p, CASE WHEN p % 12 BETWEEN 1 AND 10 AND p // 12 BETWEEN 2 AND 11 THEN ((2 * (p // 12 - 2) + 1) * 8 // 20) * 8 + (2 * (p % 12 - 1) + 1) * 8 // 20 END AS i FROM c),
        o AS (SELECT d.frame, d.clip, d.p, CASE WHEN q.a = 255 THEN q.r ELSE 236 END AS r, CASE WHEN q.a = 255 THEN q.g ELSE 244 END AS g, CASE WHEN q.a = 255 THEN q.b ELSE 241 END AS b FROM d LEFT JOIN raster q ON q.frame = d.frame AND q.i = d.i)
        SELECT frame, clip, 12 AS w, 14 AS h, 'reference-' || left(sha256(unhex(string_agg(printf('%02x%02x%02xff', r, g, b), '' ORDER BY p))), 16) AS name, sum(r + g + b)::BIGINT AS total FROM o GROUP BY frame, clip""")
def references_on_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures at 85 % of a canvas of 12 x 14, named by their pixels."""
    done = references.on_background(A.packed(spark, sf_dir, A.MEDIUM), (12, 14), 0.85)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return done.select("frame", "clip", "w", "h", "name", (total("r") + total("g") + total("b")).alias("total"))


@query(reach_sql(A.DENSE, "a <= 20") + """, inn AS (SELECT * FROM cand WHERE (frame, x, y) NOT IN (SELECT (frame, x, y) FROM hit)),
        walk AS (SELECT frame, clip, y * 8 + x AS root, x, y FROM inn UNION SELECT c.frame, c.clip, w.root, c.x, c.y FROM walk w JOIN inn c ON c.frame = w.frame AND abs(c.x - w.x) <= 1 AND abs(c.y - w.y) <= 1),
        lab AS (SELECT frame, clip, x, y, min(root) AS root FROM walk GROUP BY ALL), per AS (SELECT clip, frame, count(*) AS n, count(DISTINCT root) AS k FROM lab GROUP BY ALL HAVING count(*) > 4)
        SELECT clip, count(*)::BIGINT AS parts, sum(n)::BIGINT AS pixels, string_agg(frame || '=' || n || ' px in ' || k, ', ' ORDER BY frame) AS told FROM per GROUP BY clip""")
def hole_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips with parts that have more than four enclosed clear pixels."""
    return references.hole_offenders(A.packed(spark, sf_dir, A.DENSE), 4)


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 150")
def first_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded number of entries in order, as a limit asks for."""
    return references.first_rows(A.table(spark, sf_dir, "events").select("event_id", "value", (-F.col("value")).alias("key")), ["key", "event_id"], 150).drop("key")
