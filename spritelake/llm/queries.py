"""Queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame, and their SQL.

Each applies its operator to its whole table with production parameters.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .kneser_ney import train_and_score
from .lexical import ranked
from .media import copies, rendered
from .merkle import verified_manifest
from .ngram_join import jaccard_components
from .packing import pack_documents
from .pieces import PieceTable, round_trip
from .pii import pseudonymise
from .quality import classify
from .sharding import kd_shards
from .vectors import cosine_components
from .warc import archive_round_trip


def tokenizer(spark: SparkSession, setting: str, name: str) -> str:
    """The path of a vocabulary file: the session's setting, else that of the public package."""
    given = spark.conf.get(f"spark.spritelake.{setting}", None)
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def pseudonym_key(spark: SparkSession) -> str:
    """The session's key; without one a fresh key links values within this run only.

    Spark shows settings whose name holds "secret" as redacted, in its pages and in event logs.
    """
    return spark.conf.get("spark.spritelake.pseudonymSecret", None) or secrets.token_hex(16)


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_table(spark, sf_dir, "documents"), pseudonym_key(spark))


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(_table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op6_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op7_pq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_components(_table(spark, sf_dir, "embeddings"))


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images are rendered from the vectors, as no table holds any."""
    return copies(rendered(_table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


def op9_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), PieceTable(tokenizer(spark, "pieceModel", "piece_bpe_32k.model")))


def op10_kneser_ney_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(_table(spark, sf_dir, "documents"))


def op11_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_table(spark, sf_dir, "documents"), bpe.Ranks(tokenizer(spark, "byteRanks", "byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_best_fit_packing, op3_pii_pseudonyms, op4_kd_sharding, op5_ngram_jaccard_join, op6_warc_index_merge, op7_pq_near_duplicates, op8_image_copies, op9_sentencepiece_lattice, op10_kneser_ney_scoring, op11_bpe_merge_replay, op12_merkle_manifest, op13_lexical_search)}


#: Components of the pairs ``link(a, b)`` by recursive UNION; ``node(id)`` holds all ids.
REACH = """both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link), walk AS (SELECT id AS root, id FROM node UNION SELECT w.root, e.b FROM walk w JOIN both_ways e ON e.a = w.id),
        comp AS (SELECT root AS id, min(id) AS component_id FROM walk GROUP BY root), degree AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)"""

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
        node AS (SELECT id FROM s), sh AS (SELECT id, unnest(s) AS g, len(s) AS n FROM s),
        link AS (SELECT p.id AS a, q.id AS b FROM sh p JOIN sh q ON p.g = q.g AND p.id < q.id GROUP BY p.id, q.id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))), {REACH}
        SELECT id AS doc_id, len(s)::BIGINT AS n_shingles, component_id, coalesce(n, 0)::BIGINT AS n_links FROM s JOIN comp USING (id) LEFT JOIN degree USING (id)"""

COSINE = f"""WITH RECURSIVE e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), node AS (SELECT id FROM e),
        f AS (SELECT id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE v IS NOT NULL AND label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        link AS (SELECT p.id AS a, q.id AS b FROM f p JOIN f q ON p.label = q.label AND p.id < q.id AND len(p.v) = len(q.v) WHERE list_dot_product(p.v, q.v) / (p.n * q.n) >= 0.98), {REACH}
        SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM comp LEFT JOIN degree USING (id)"""

CAPTURES = r"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hx FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY hx) AS first, url,
            array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum(list_transform(range(0, 5), lambda j: (((strpos('0123456789abcdef', substr(hx, ((5 * k + j) // 4 + 1)::INT, 1)) - 1) >> (3 - (5 * k + j) % 4)::INT) & 1) << (4 - j)::INT)))::INT, 1)), '') AS payload_digest,
            lower(array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\.', ''), '.')), ',') || ')' || coalesce(nullif(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), ''), '/') || CASE WHEN regexp_extract(url, '\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '\?([^#]*)', 1) ELSE '' END) AS url_key FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to, url_key, (row_number() OVER (ORDER BY url_key, page_id) - 1)::BIGINT AS history_order FROM d"""

_FIELDS = "concat({})".format(", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "{n}", "text")))

#: Nodes of all levels bottom up, each leaf's siblings by its index divided, and its fold, with n_chars + 1 where it was tampered with.
MERKLE = f"""WITH RECURSIVE bits AS (SELECT b, list_reduce(list_prepend(b, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS t FROM range(0, 256) r(b)),
        tab AS (SELECT list(t ORDER BY b) AS t FROM bits),
        ids AS (SELECT *, doc_id::VARCHAR AS s FROM documents),
        crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(s, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c // 256, t[1 + (xor(c % 256, x))])), 4294967295) AS c FROM ids, tab),
        l AS (SELECT d.doc_id, coalesce('=' || lang, '') AS g, sha256({_FIELDS.format(n="n_chars")}) AS leaf, CASE WHEN c % 7 = 0 THEN sha256({_FIELDS.format(n="(n_chars + 1)")}) ELSE sha256({_FIELDS.format(n="n_chars")}) END AS given FROM documents d JOIN crc USING (doc_id)),
        lv AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
        up AS (SELECT g, 0 AS h, i, n, leaf AS d FROM lv UNION ALL SELECT g, h + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY g, h, i // 2, n),
        tops AS (SELECT g, h, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
        ov AS (SELECT 0 AS h, i, n, d FROM tops UNION ALL SELECT h + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM ov WHERE n > 1 GROUP BY h, i // 2, n),
        walk AS (SELECT doc_id, lv.g, leaf, given AS d, 0 AS h, lv.i, lv.n, false AS over, '' AS sibs, t.h AS height, t.d AS subroot, t.i AS ti, t.n AS tn FROM lv JOIN tops t USING (g)
            UNION ALL SELECT w.doc_id, w.g, w.leaf, CASE WHEN w.h < w.height OR w.over THEN sha256(CASE WHEN w.i % 2 = 1 THEN coalesce(s.d, o.d, '') || w.d ELSE w.d || coalesce(s.d, o.d, '') END) ELSE w.d END,
                CASE WHEN w.over OR w.h < w.height THEN w.h + 1 ELSE 0 END, CASE WHEN w.over OR w.h < w.height THEN w.i // 2 ELSE w.ti END, CASE WHEN w.over OR w.h < w.height THEN (w.n + 1) // 2 ELSE w.tn END, w.over OR w.h >= w.height, w.sibs || coalesce(s.d, o.d, ''), w.height, w.subroot, w.ti, w.tn
            FROM walk w LEFT JOIN up s ON NOT w.over AND w.h < w.height AND s.g = w.g AND s.h = w.h AND s.i = xor(w.i, 1) LEFT JOIN ov o ON w.over AND o.h = w.h AND o.i = xor(w.i, 1) WHERE NOT (w.over AND w.n = 1)),
        root AS (SELECT d AS root FROM ov WHERE n = 1)
        SELECT doc_id, leaf, subroot, root, sha256(sibs) AS proof_sha256, d AS folded_root, d = root AS verified FROM walk, root WHERE over AND n = 1"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

LEXICAL = f"""WITH t AS (SELECT doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id, len(w)::BIGINT AS n FROM t WHERE len(w) > 0),
        g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d), m AS (SELECT doc_id, 25 + (75 * n * docs) // total AS m FROM d, g),
        tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY ALL),
        wt AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), g),
        q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
        s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN m USING (doc_id) GROUP BY ALL),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; tests/llm holds the others against slow versions."""
    return {"op5_ngram_jaccard_join": JACCARD, "op6_warc_index_merge": CAPTURES, "op7_pq_near_duplicates": COSINE, "op12_merkle_manifest": MERKLE, "op13_lexical_search": LEXICAL}
