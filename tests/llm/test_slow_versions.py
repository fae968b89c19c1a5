"""Parts of corpus operators against slow versions and SQL: the permutation of numbers, sizes and checksums, counts and base scores."""

import glob
import hashlib
import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from spritelake.llm import pii, queries

SF = "/root/testdata/sf0.001"


def slow_feistel(digits, radices, key, kind):
    half = len(digits) // 2
    a, b = list(digits[:half]), list(digits[half:])
    for i in range(pii.ROUNDS):
        other = b if i % 2 == 0 else a
        stream = hashlib.sha512(f"{key}|{kind}|{i}|{','.join(map(str, other))}".encode()).hexdigest()
        number = lambda j, s=stream: int(s[4 * j : 4 * j + 4], 16)
        if i % 2 == 0:
            a = [(x + number(j)) % radices[j] for j, x in enumerate(a)]
        else:
            b = [(x + number(j)) % radices[half + j] for j, x in enumerate(b)]
    return a + b


def test_permutation_of_numbers(spark):
    rng = random.Random(5)
    rows = []
    for n in (2, 3, 7, 10, 16, 19, 32):
        for _ in range(12):
            radices = [rng.choice((2, 10, 16, 26, 99, 256, 9999)) for _ in range(n)]
            rows.append(([rng.randrange(r) for r in radices], radices))
    df = spark.createDataFrame(rows, "d array<int>, r array<int>")
    for r in df.select("d", "r", pii.feistel(F.col("d"), F.col("r"), F.lit("a key"), "some kind").alias("p")).collect():
        assert list(r["p"]) == slow_feistel(r["d"], r["r"], "a key", "some kind")


def test_pseudonyms_of_addresses_and_cards(spark):
    texts = ["from 10.20.30.40 to 255.0.1.2", "card 4111 1111 1111 1111 on file"]
    out = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    address = lambda *p: ".".join(map(str, slow_feistel(p, [256] * 4, "k", "ipv4")))
    assert out[0] == f"from {address(10, 20, 30, 40)} to {address(255, 0, 1, 2)}"
    body = slow_feistel([4, *[1] * 14], [10] * 15, "k", "card")
    doubled = sum(sum(divmod(2 * d, 10)) if k % 2 == 0 else d for k, d in enumerate(body))
    digits = "".join(map(str, [*body, (10 - doubled % 10) % 10]))
    assert out[1] == f"card {digits[:4]} {digits[4:8]} {digits[8:12]} {digits[12:]} on file"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_sizes_and_checksums_of_shards(spark, duck):
    want = {i: (size, zlib.crc32((text or "").encode())) for i, size, text in duck.execute("SELECT doc_id, coalesce(strlen(text), 0) + 1, text FROM documents").fetchall()}
    got = queries.op4_kd_sharding(spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got if r["doc_id"] in want} == want and len(got) == len(want)


def test_counts_and_base_scores(spark, duck):
    held = [i for (i,) in duck.execute("SELECT doc_id FROM documents").fetchall() if zlib.crc32(str(i).encode()) % 7 == 2]
    duck.execute("CREATE TABLE held AS SELECT unnest(?) AS doc_id", [held])
    want = duck.execute(r"""WITH w AS (SELECT doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) AS w FROM documents),
        t AS (SELECT doc_id, unnest(w) AS t FROM w), c AS (SELECT t, count(*) AS c FROM t WHERE doc_id NOT IN (SELECT doc_id FROM held) GROUP BY t), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
        SELECT doc_id, count(*), count(c), any_value(n), sum(log10((coalesce(c, 0) + 1)::DOUBLE / (n + v + 1))) FROM t LEFT JOIN c USING (t), n GROUP BY doc_id""").fetchall()
    got = {r["doc_id"]: r for r in queries.op10_kneser_ney_scoring(spark, SF).collect()}
    assert len(got) == len(want)
    for i, tokens, known, train, base in want:
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (tokens, known, train, i in held) and r["base_score"] == pytest.approx(base, abs=1e-6)
