"""Queries over exported splits, bundles and specs; their rows are derived from orders, part, nation and customer.

Derivations are expressions that Spark and DuckDB read alike, each with faults planted by a remainder of the key;
the rules are written twice, once as operators and once as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bundles, datasets, specs
from ..operators.ordinals import ordinals
from ..sources import adapters as A
from .catalogue import query, raster_sql


def _pad(k: str) -> str:
    return f"lpad(CAST({k} AS STRING), 6, '0')"


def _when(remainder: str, then: str, otherwise: str) -> str:
    return f"CASE WHEN {remainder} THEN {then} ELSE {otherwise} END"


ENTRIES = {
    "position": "k + 1", "index": f"k + 1 + {_when('k % 97 = 13', '1', '0')}", "sample": f"'s' || CAST({_when('k % 89 = 5', 'k - 1', 'k')} AS STRING)", "prompt_index": f"k % 8 + {_when('k % 83 = 7', '8', '0')}",
    "input": f"{_when('k % 79 = 3', chr(39) + 'train/sub/' + chr(39), chr(39) + 'train/' + chr(39))} || {_pad('k + 1')} || {_when('k % 73 = 1', chr(39) + '_on.png' + chr(39), chr(39) + '_in.png' + chr(39))}",
    "target": f"'train/' || {_pad(_when('k % 71 = 2', 'k + 500001', 'k + 1'))} || '_out.png'", "prompt": f"'train/' || {_pad(_when('k % 67 = 4', 'k', 'k + 1'))} || '_in.txt'",
}
SAMPLES = {"sample": "'s' || CAST(k AS STRING)", "split": _when("k % 61 = 6", "'validation'", "'train'"), "character": "'c' || CAST(k % 20 AS STRING)", "input_hash": "md5('i' || CAST(k AS STRING))", "target_hash": "md5('t' || CAST(k AS STRING))"}
INPUTS = {"path": f"'train/' || {_pad('k + 1')} || '_in.png'", "w": f"64 + {_when('k % 59 = 8', '16', '0')}", "h": "64", "hash": f"md5('i' || CAST(k AS STRING) || {_when('k % 53 = 9', chr(39) + 'x' + chr(39), chr(39) * 2)})", "regular": "k % 47 <> 10"}
TARGETS = {"path": f"'train/' || {_pad('k + 1')} || '_out.png'", "w": f"64 + {_when('k % 43 = 11', '16', '0')}", "h": "64", "hash": f"md5('t' || CAST(k AS STRING) || {_when('k % 41 = 12', chr(39) + 'x' + chr(39), chr(39) * 2)})", "regular": "k % 37 <> 14"}
PROMPTS = {"path": f"'train/' || {_pad('k + 1')} || '_in.txt'", "w": "CAST(NULL AS INT)", "h": "CAST(NULL AS INT)", "hash": "md5('p' || CAST(k AS STRING))", "regular": "true"}
NOTES = {"path": "'train/note' || CAST(k AS STRING)", "w": "CAST(NULL AS INT)", "h": "CAST(NULL AS INT)", "hash": "'-'", "regular": "true"}


def _sql(columns: dict[str, str], source: str, where: str = "true") -> str:
    return f'SELECT {", ".join(f"{e} AS {chr(34)}{c}{chr(34)}" for c, e in columns.items())} FROM {source} WHERE {where}'


def _rows(keys: DataFrame, columns: dict[str, str], where: str = "true") -> DataFrame:
    return keys.where(where).select(*(F.expr(e).alias(c) for c, e in columns.items()))


SPLIT = f"""kk AS (SELECT o_orderkey AS k FROM orders), en AS ({_sql(ENTRIES, 'kk')}), sa AS ({_sql(SAMPLES, 'kk')}),
        fi AS ({_sql(INPUTS, 'kk')} UNION ALL {_sql(TARGETS, 'kk', 'k % 31 <> 15')} UNION ALL {_sql(PROMPTS, 'kk')} UNION ALL {_sql(NOTES, 'kk', 'k % 101 = 0')})"""


@query(f"""WITH {SPLIT}, ok AS (SELECT * FROM fi WHERE regular), p AS (SELECT position, 'input' AS field, input AS path FROM en UNION ALL SELECT position, 'target', target FROM en UNION ALL SELECT position, 'prompt', prompt FROM en),
        e AS (SELECT en.*, i.w AS iw, i.h AS ih, i.hash AS ihash, t.w AS tw, t.h AS th, t.hash AS thash, q.hash AS phash, s.input_hash, s.target_hash, regexp_replace(regexp_replace(input, '^.*/', ''), '_in\\.png$', '') AS b1, regexp_replace(regexp_replace(target, '^.*/', ''), '_out\\.png$', '') AS b2, regexp_replace(regexp_replace(prompt, '^.*/', ''), '_in\\.txt$', '') AS b3
            FROM en LEFT JOIN ok i ON i.path = input LEFT JOIN ok t ON t.path = target LEFT JOIN ok q ON q.path = prompt LEFT JOIN sa s ON s.sample = en.sample AND s.split = 'train'),
        r AS (SELECT position::VARCHAR AS subject, 'index' AS rule FROM e WHERE "index" <> position UNION ALL SELECT position::VARCHAR, 'duplicate' FROM e WHERE sample IN (SELECT sample FROM en GROUP BY sample HAVING count(*) > 1)
            UNION ALL SELECT position::VARCHAR, 'unknown' FROM e WHERE input_hash IS NULL UNION ALL SELECT position::VARCHAR, 'prompt_index' FROM e WHERE prompt_index > 7
            UNION ALL SELECT position::VARCHAR, 'parent' FROM e WHERE input NOT SIMILAR TO 'train/[^/]*' OR target NOT SIMILAR TO 'train/[^/]*' OR prompt NOT SIMILAR TO 'train/[^/]*'
            UNION ALL SELECT DISTINCT position::VARCHAR, 'reused' FROM p WHERE path IN (SELECT path FROM p GROUP BY path HAVING count(*) > 1)
            UNION ALL SELECT position::VARCHAR, 'names' FROM e WHERE NOT (ends_with(input, '_in.png') AND ends_with(target, '_out.png') AND ends_with(prompt, '_in.txt')) UNION ALL SELECT position::VARCHAR, 'basenames' FROM e WHERE b1 <> b2 OR b1 <> b3
            UNION ALL SELECT position::VARCHAR, 'number' FROM e WHERE NOT regexp_full_match(b1, '[0-9]+') OR TRY_CAST(b1 AS BIGINT) <> "index" UNION ALL SELECT position::VARCHAR, 'missing' FROM e WHERE ihash IS NULL OR thash IS NULL OR phash IS NULL
            UNION ALL SELECT position::VARCHAR, 'sizes' FROM e WHERE iw <> tw OR ih <> th UNION ALL SELECT position::VARCHAR, 'input_pixels' FROM e WHERE ihash <> input_hash UNION ALL SELECT position::VARCHAR, 'target_pixels' FROM e WHERE thash <> target_hash
            UNION ALL SELECT path, 'surplus' FROM fi WHERE NOT regular OR path NOT IN (SELECT path FROM p) UNION ALL SELECT 'train', 'image_sizes' FROM (SELECT count(DISTINCT (w, h)) AS n FROM ok JOIN p USING (path) WHERE field <> 'prompt' AND w IS NOT NULL) WHERE n > 1)
        SELECT * FROM r""")
def split_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of a split against its samples and its folder."""
    keys = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    files = _rows(keys, INPUTS).unionByName(_rows(keys, TARGETS, "k % 31 <> 15")).unionByName(_rows(keys, PROMPTS)).unionByName(_rows(keys, NOTES, "k % 101 = 0"))
    return bundles.split_faults(_rows(keys, ENTRIES), _rows(keys, SAMPLES), files, "train", "train", 8)


NAMES = {"train": _when("k % 31 = 3", f"'a' || {_pad('k')}", _when("k % 37 = 5", f"'c' || {_pad('k - 1')}", _when("k % 41 = 7", f"' c' || {_pad('k')}", f"'c' || {_pad('k')}"))), "holdout": _when("k % 47 = 2", f"'c' || {_pad('k')}", f"'h' || {_pad('k')}"), "samples": f"'s' || {_pad('k')}"}
PACKED = {
    "position": "k + 1", "index": f"k + 1 + {_when('k % 29 = 4', '1', '0')}", "sample": f"'s' || {_pad('k')}", "character": _when("k % 23 = 6", "'nobody'", f"'c' || {_pad('k')}"), "prompt_index": f"k % 4 + {_when('k % 19 = 8', '4', '0')}",
    **{f: f"'{f}' || {_pad('k')}" for f in bundles.FIELDS}, "input_sha256": f"sha2x('input' || {_pad('k')})", "target_sha256": _when("k % 17 = 9", f"sha2x('other' || {_pad('k')})", f"sha2x('target' || {_pad('k')})"), "prompt_sha256": _when("k % 13 = 10", "'no digest'", f"sha2x('prompt' || {_pad('k')})"),
}
HELD = {f: {"name": f"'{f}' || {_pad('k')}", "w": "CAST(NULL AS INT)" if f == "prompt" else f"32 + {_when('k % 11 = 1', '16', '0')}", "h": "CAST(NULL AS INT)" if f == "prompt" else "48", "sha256": f"sha2x('{f}' || {_pad('k')})", "regular": "k % 53 <> 20"} for f in bundles.FIELDS}
SPARE = {"name": "'spare' || CAST(k AS STRING)", "w": "CAST(NULL AS INT)", "h": "CAST(NULL AS INT)", "sha256": "'-'", "regular": "true"}


def _digest(columns: dict[str, str], spark: bool) -> dict[str, str]:
    import re

    return {c: re.sub(r"sha2x\(((?:[^()]|\([^()]*(?:\([^()]*\))?[^()]*\))*)\)", r"sha2(\1, 256)" if spark else r"sha256(\1)", e) for c, e in columns.items()}


BUNDLE = f"""kk AS (SELECT p_partkey AS k FROM part), nm AS ({" UNION ALL ".join(f"SELECT '{n}' AS list, k + 1 AS position, {e} AS name FROM kk WHERE {'k % 43 <> 9' if n == 'train' else 'true'}" for n, e in NAMES.items())}),
        en AS ({_sql(_digest(PACKED, False), 'kk')}), fi AS ({" UNION ALL ".join(_sql(_digest(c, False), 'kk', 'k % 59 <> 30' if f == 'target' else 'true') for f, c in HELD.items())} UNION ALL {_sql(SPARE, 'kk', 'k % 61 = 0')}), ok AS (SELECT * FROM fi WHERE regular),
        de AS (SELECT count(*) AS train_count, count(*) + 1 AS holdout_count, 4 AS prompts, 32 AS image_w, 40 AS image_h FROM kk)"""
_PATHS = " UNION ALL ".join(f"SELECT position, '{f}' AS field, {f} AS name, {f}_sha256 AS digest FROM en" for f in bundles.FIELDS)


@query(f"""WITH {BUNDLE}, p AS ({_PATHS}), x AS (SELECT p.*, o.w, o.h, o.sha256 FROM p LEFT JOIN ok o USING (name)), b AS (SELECT n.*, m.name AS before, n.list || '/' || n.position AS subject FROM nm n LEFT JOIN nm m ON m.list = n.list AND m.position = n.position - 1)
        SELECT subject, 'order' AS rule FROM b WHERE name < before UNION ALL SELECT subject, 'repeated' FROM b WHERE name = before UNION ALL SELECT subject, 'blank' FROM b WHERE trim(name) <> name OR name = '' UNION ALL SELECT subject, 'gap' FROM b WHERE before IS NULL AND position > 1
        UNION ALL SELECT DISTINCT a.name, 'shared' FROM nm a JOIN nm c ON a.name = c.name AND a.list = 'train' AND c.list = 'holdout'
        UNION ALL SELECT 'bundle', 'holdout_count' FROM de WHERE holdout_count <> (SELECT count(*) FROM nm WHERE list = 'samples') UNION ALL SELECT 'bundle', 'train_count' FROM de WHERE train_count <> (SELECT count(*) FROM en) UNION ALL SELECT 'bundle', 'image_size' FROM de WHERE image_w < 16 OR image_w % 16 <> 0 OR image_h < 16 OR image_h % 16 <> 0
        UNION ALL SELECT position::VARCHAR, 'index' FROM en WHERE "index" <> position UNION ALL SELECT position::VARCHAR, 'character' FROM en WHERE character NOT IN (SELECT name FROM nm WHERE list = 'train') UNION ALL SELECT position::VARCHAR, 'prompt_index' FROM en WHERE prompt_index >= 4
        UNION ALL SELECT DISTINCT position::VARCHAR, 'missing' FROM x WHERE sha256 IS NULL UNION ALL SELECT DISTINCT position::VARCHAR, 'digest' FROM x WHERE NOT regexp_full_match(digest, '[0-9a-f]{{64}}') UNION ALL SELECT DISTINCT position::VARCHAR, 'bytes' FROM x WHERE sha256 <> digest
        UNION ALL SELECT DISTINCT position::VARCHAR, 'size' FROM x, de WHERE field <> 'prompt' AND (w <> image_w OR h <> image_h) UNION ALL SELECT name, 'surplus' FROM fi WHERE name NOT IN (SELECT name FROM p)""")
def bundle_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of a bundle after a transfer."""
    keys = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    names = None
    for n, e in NAMES.items():
        one = keys.where("k % 43 <> 9" if n == "train" else "true").select(F.lit(n).alias("list"), (F.col("k") + 1).alias("position"), F.expr(e).alias("name"))
        names = one if names is None else names.unionByName(one)
    files = _rows(keys, _digest(SPARE, True), "k % 61 = 0")
    for f, columns in HELD.items():
        files = files.unionByName(_rows(keys, _digest(columns, True), "k % 59 <> 30" if f == "target" else "true"))
    declared = keys.agg(F.count(F.lit(1)).alias("train_count"), (F.count(F.lit(1)) + 1).alias("holdout_count"), F.lit(4).alias("prompts"), F.lit(32).alias("image_w"), F.lit(40).alias("image_h"))
    return bundles.bundle_faults(declared, names, _rows(keys, _digest(PACKED, True)), files)


@query(r"""WITH ch AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 11 = 4 THEN 'N' ELSE 'n' END || n_nationkey AS id, '/r' || n_nationkey AS root FROM nation), dr AS (SELECT k, unnest(CASE WHEN k % 7 = 1 THEN ['east', 'west', 'east'] ELSE ['east', 'west'] END) AS direction FROM ch),
        fi AS (SELECT '/r' || c_nationkey AS root, CASE WHEN c_custkey % 2 = 0 THEN 'east' ELSE 'west' END || '/' || CASE c_custkey // 2 % 3 WHEN 0 THEN 'walk' WHEN 1 THEN 'idle' ELSE 'hit' END || '_' || (c_custkey // 6 % 12) || '.png' AS path, c_custkey % 29 <> 3 AS regular FROM customer),
        cl(clip, expected) AS (VALUES ('walk', 4), ('idle', 2), ('hit', 1)),
        sa AS (SELECT id || '__' || direction || '__' || clip AS sample, id, k, root, direction, clip, expected, CASE clip WHEN 'walk' THEN direction || '/walk_[^/]*\.png' WHEN 'idle' THEN direction || '/idle_[^/]\.png' ELSE direction || '/hit_0\.png' END AS pat, clip = 'hit' AND k % 5 = 2 AS out FROM ch JOIN dr USING (k), cl),
        hit AS (SELECT DISTINCT s.sample, f.path, f.regular, f.rowid_ FROM (SELECT DISTINCT sample, root, pat, out FROM sa) s JOIN (SELECT *, row_number() OVER () AS rowid_ FROM fi) f ON f.root = s.root AND NOT out AND regexp_full_match(f.path, s.pat)),
        n AS (SELECT sample, count(DISTINCT path) AS found, count(*) FILTER (WHERE NOT regular) AS odd FROM hit GROUP BY sample), t AS (SELECT sample, count(*) AS times FROM sa GROUP BY sample), r AS (SELECT sa.*, times, coalesce(found, 0) AS found, coalesce(odd, 0) * times AS odd FROM sa JOIN t USING (sample) LEFT JOIN n USING (sample)),
        pt AS (SELECT *, CASE clip WHEN 'walk' THEN direction || '/walk_*.png' WHEN 'idle' THEN './' || direction || '/x/../idle_?.png' WHEN 'hit' THEN CASE WHEN out THEN '../hit.png' ELSE direction || '/hit_0.png' END END AS path FROM r)
        SELECT sample AS subject, 'id' AS rule, path AS told FROM pt WHERE k % 11 = 4 UNION ALL SELECT sample, 'collision', times::VARCHAR FROM pt WHERE times > 1 UNION ALL SELECT sample, 'escapes', path FROM pt WHERE out
        UNION ALL SELECT sample, 'count', 'expected ' || expected || ' found ' || found FROM pt WHERE NOT out AND found <> expected UNION ALL SELECT sample, 'irregular', odd::VARCHAR FROM pt WHERE odd > 0""")
def spec_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What folders have for the samples that a spec asks for: characters x directions x clips."""
    k = F.col("n_nationkey")
    clip = lambda name, pattern, n: F.struct(F.lit(name).alias("id"), pattern.alias("pattern"), F.lit(n).alias("expected"))
    clips = F.array(clip("walk", F.lit("{direction}/{clip}_*.png"), 4), clip("idle", F.lit("./{direction}/x/../{clip}_?.png"), 2), clip("hit", F.when(k % 5 == 2, "../{clip}.png").otherwise("{direction}/{clip}_0.png"), 1))
    twice = F.when(k % 7 == 1, F.array(*map(F.lit, ("east", "west", "east")))).otherwise(F.array(F.lit("east"), F.lit("west")))
    characters = A.table(spark, sf_dir, "nation").select(F.concat(F.when(k % 11 == 4, "N").otherwise("n"), k.cast("string")).alias("id"), F.concat(F.lit("/r"), k.cast("string")).alias("root"), twice.alias("directions"), clips.alias("clips"))
    c = F.col("c_custkey")
    kind = F.floor(c / 2) % 3
    path = F.concat(F.when(c % 2 == 0, "east").otherwise("west"), F.lit("/"), F.when(kind == 0, "walk").when(kind == 1, "idle").otherwise("hit"), F.lit("_"), (F.floor(c / 6) % 12).cast("string"), F.lit(".png"))
    files = A.table(spark, sf_dir, "customer").select(F.concat(F.lit("/r"), F.col("c_nationkey").cast("string")).alias("root"), path.alias("path"), (c % 29 != 3).alias("regular"))
    return specs.spec_faults(characters, files)


@query("""WITH tr AS (SELECT event_type AS clip, user_id AS joint, CASE event_id % 3 WHEN 0 THEN 'rotation' WHEN 1 THEN 'offset_x' ELSE 'offset_y' END AS channel, value FROM events), pl(clip, place) AS (VALUES ('view', 0), ('click', 1))
        SELECT clip, place::INT AS place, joint, channel, count(*)::BIGINT AS keys, round(sum(CASE WHEN channel = 'rotation' THEN value ELSE round(value * 1.5, 6) END), 3)::DOUBLE AS total FROM tr JOIN pl USING (clip) WHERE joint IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 1) GROUP BY ALL""")
def restricted_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of two clips, one asked for twice, for the joints that there are."""
    e = F.col("event_id") % 3
    tracks = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("clip"), F.col("user_id").alias("joint"), F.when(e == 0, "rotation").when(e == 1, "offset_x").otherwise("offset_y").alias("channel"), F.col("event_id").cast("double").alias("t"), "value")
    joints = A.table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 != 1).select(F.col("c_custkey").alias("joint"))
    kept = specs.restricted_tracks(tracks, joints, ["view", "click", "view"], 1.5)
    return kept.groupBy("clip", "place", "joint", "channel").agg(F.count(F.lit(1)).alias("keys"), F.round(F.sum("value"), 3).alias("total"))


# ---- datasets of boards

_PLACE = "(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)"


@query(f"""WITH {raster_sql(A.MEDIUM)}, fl AS (SELECT vec_id AS frame, label, {_PLACE} AS k FROM embeddings), cells AS (SELECT frame, 'c' || label || '__east__walk' AS sample, k AS cell FROM fl WHERE k <= 4 UNION ALL SELECT frame, 'c' || label || '__east__idle', CASE WHEN k = 0 THEN 0 ELSE k - 4 END FROM fl WHERE k = 0 OR k BETWEEN 5 AND 7),
        o AS (SELECT sample, cell, x, y, a > 20 AS t, r, g, b, a FROM cells JOIN raster USING (frame)), n AS (SELECT p.sample, p.cell, p.x, p.y, p.t, count(*) FILTER (WHERE q.t) AS k FROM o p JOIN o q ON q.sample = p.sample AND q.cell = p.cell AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 WHERE p.cell > 0 GROUP BY ALL),
        bp AS (SELECT sample, 'input' AS kind, cell, x, y, CASE WHEN k BETWEEN 1 AND 8 THEN 16051904 ELSE 4614282 END AS c FROM n WHERE k BETWEEN 1 AND 8 OR t UNION ALL SELECT sample, 'input', cell, x, y, r * 65536 + g * 256 + b FROM o WHERE cell = 0 AND a > 0 UNION ALL SELECT sample, 'target', cell, x, y, r * 65536 + g * 256 + b FROM o WHERE a > 0),
        sm AS (SELECT DISTINCT sample, CASE WHEN sample LIKE 'c1\\_\\_%' ESCAPE '\\' OR sample LIKE 'c4\\_\\_%' ESCAPE '\\' THEN 'validation' ELSE 'train' END AS split FROM cells), en AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sample) AS ordinal FROM sm)
        SELECT sample, split, ordinal::INT AS ordinal, ((ordinal - 1) % 8)::INT AS prompt_index, 'mflux/' || split || '/' || lpad(ordinal::VARCHAR, 4, '0') || '_in.png' AS input, kind, count(*)::BIGINT AS pixels, sum(c::BIGINT * (1 + (cell // 4 * 16 + 4 + y) * 64 + cell % 4 * 16 + 4 + x))::BIGINT AS digest FROM bp JOIN en USING (sample) GROUP BY ALL""")
def dataset_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label as a character with a reference, a walk and an idle clip, every vector as a file of its folder."""
    first = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").alias("clip"))
    k = F.col("k")
    name = F.when(k == 0, "reference").when(k <= 4, F.concat(F.lit("walk_"), (k + 7).cast("string"))).when(k <= 7, F.concat(F.lit("idle_"), k.cast("string"))).otherwise(F.concat(F.lit("spare_"), F.col("frame").cast("string")))
    places = ordinals(first, ["frame"], ["clip"], "k").select("frame", F.concat(F.lit("/r"), F.col("clip").cast("string")).alias("root"), F.concat(F.lit("east/"), name, F.lit(".png")).alias("path"))
    files = A.packed(spark, sf_dir, A.MEDIUM).join(places, "frame").withColumn("regular", F.lit(True))
    clip = lambda c, n: F.struct(F.lit(c).alias("id"), F.lit("{direction}/{clip}_*.png").alias("pattern"), F.lit(n).alias("expected"))
    label = F.col("clip").cast("string")
    characters = first.select("clip").distinct().select(F.concat(F.lit("c"), label).alias("id"), F.concat(F.lit("/r"), label).alias("root"), F.lit("{direction}/reference.png").alias("reference"), F.array(F.lit("east")).alias("directions"), F.array(clip("walk", 4), clip("idle", 3)).alias("clips"))
    made = datasets.build(characters, files, ["c1", "c4"])
    colour = (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("long")
    boards = made.boards.groupBy("sample", "kind").agg(F.count(F.lit(1)).alias("pixels"), F.sum(colour * (1 + F.col("by") * F.col("board_w") + F.col("bx"))).alias("digest"))
    return made.entries.join(boards, "sample").select("sample", "split", "ordinal", "prompt_index", "input", "kind", "pixels", "digest")


@query(f"""WITH RECURSIVE {raster_sql(A.OPAQUE)}, c AS (SELECT vec_id AS board, f, p % 5 AS x, p // 5 AS y, (f // 2 * 4 + (2 * (p // 5) + 1) * 4 // 12) * 8 + f % 2 * 4 + (2 * (p % 5) + 1) * 4 // 12 AS i FROM embeddings, range(1, 4) t(f), range(0, 25) q(p)),
        im AS (SELECT board, f AS frame, c.x, c.y, r, g, b FROM c JOIN raster s ON s.frame = c.board AND s.i = c.i), md AS (SELECT board, frame, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM im WHERE x IN (0, 4) AND y IN (0, 4) GROUP BY ALL),
        cand AS (SELECT board, frame, x, y FROM im JOIN md USING (board, frame) WHERE abs(r - mr) + abs(g - mg) + abs(b - mb) <= 42),
        hit AS (SELECT board, frame, x, y FROM cand WHERE x IN (0, 4) OR y IN (0, 4) UNION SELECT c.board, c.frame, c.x, c.y FROM hit h JOIN cand c ON c.board = h.board AND c.frame = h.frame AND abs(c.x - h.x) <= 1 AND abs(c.y - h.y) <= 1),
        kept AS (SELECT im.* FROM im LEFT JOIN hit h ON h.board = im.board AND h.frame = im.frame AND h.x = im.x AND h.y = im.y WHERE h.board IS NULL)
        SELECT b.board, b.frame::INT AS frame, count(k.board)::BIGINT AS pixels, coalesce(sum((r * 65536 + g * 256 + b)::BIGINT * (1 + y * 5 + x)), 0)::BIGINT AS digest, count(k.board) = 0 AS empty FROM (SELECT DISTINCT board, frame FROM im) b LEFT JOIN kept k ON k.board = b.board AND k.frame = b.frame GROUP BY ALL""")
def delivered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three frames of each board of 2 x 2 cells, from 4 x 4 to 6 x 6 pixels, cut to 5 x 5 and cleared of their background."""
    boards = A.packed(spark, sf_dir, A.OPAQUE).withColumnRenamed("frame", "board")
    pixels, faults = datasets.delivered(boards, 2, 3, (4, 4), (6, 6), (5, 5))
    digest = (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("long") * (1 + F.col("y") * 5 + F.col("x"))
    full = pixels.groupBy("board", "frame").agg(F.count(F.lit(1)).alias("pixels"), F.sum(digest).alias("digest"), F.lit(False).alias("empty"))
    zero = F.lit(0).cast("long")
    return full.unionByName(faults.where("rule = 'empty'").select("board", "frame", zero.alias("pixels"), zero.alias("digest"), F.lit(True).alias("empty")))
