"""Text operators: brute force, odd rows, empty tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spritelake.llm import kneser_ney, ngram_join, packing, pieces, pii, quality, queries, sharding
from spritelake.llm._tokens import Tokeniser
from spritelake.llm.components import components

from .conftest import words

SF = "/root/testdata/sf0.001"


def unions(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_words_as_defined():
    texts = ["", None, "A b\tc\n", "  lead", "é É x\x0by", "tail  "]
    tok = Tokeniser(chunk=8)
    counts, hashes = [], []
    for _, _, h, n in tok.chunks(pa.array(texts)):
        counts += n.tolist()
        hashes += h.tolist()
    want = [w for t in texts for w in words(t)]
    assert counts == [len(words(t)) for t in texts]
    assert len({(w, h) for w, h in zip(want, hashes, strict=True)}) == len(set(want)) == len(set(hashes))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + chain
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = unions(edges, {n for e in edges for n in e})
    assert got == {n: want[n] for n in got} and {n for a, b in edges if a != b for n in (a, b)} == set(got)


def jaccard(rows, width=5):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, links


def test_jaccard_join_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets, links = jaccard([(r["doc_id"], r["text"]) for r in docs.collect()])
    comp, degree = unions(links, sets), Counter(x for e in links for x in e)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {i: (len(s), comp[i], degree[i]) for i, s in sets.items()} and links


def test_jaccard_join_in_blocks(spark, monkeypatch):
    """A group of near copies larger than a block, beside copies and documents that share a passage."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    base = [f"v{i}" for i in range(60)]
    texts = [" ".join(base[:k] + [f"edit{k}"] + base[k + 1 :]) for k in range(30)] + [" ".join(base)] * 5
    texts += [" ".join([f"own{d}_{i}" for i in range(40)] + base[:20]) for d in range(20)]
    rows = list(enumerate(texts))
    sets, links = jaccard(rows)
    comp, degree = unions(links, sets), Counter(x for e in links for x in e)
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (comp[i], degree[i]) for i in sets}


def test_jaccard_join_over_bands_of_sizes(spark, monkeypatch):
    """One neighbourhood of sets from 20 to 200 shingles in many blocks: prefixes of one text, each linked with those a third longer."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rows = [(k, " ".join(f"v{i}" for i in range(k))) for k in [*range(24, 60), *range(60, 205, 3)]]
    sets, links = jaccard(rows)
    comp, degree = unions(links, sets), Counter(x for e in links for x in e)
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (comp[i], degree[i]) for i in sets}


@pytest.mark.parametrize(("num", "den"), [(75, 100), (9, 10), (1, 2), (1, 1), (99, 100)])
def test_bands_are_adjacent(spark, num, den):
    """Sizes at the very bound of a link are never two bands apart."""
    pairs = spark.range(1, 20_000).selectExpr("id AS a", f"greatest(id, id * {den} div {num}) AS b")
    far = pairs.where(ngram_join._band(F.col("b"), num, den) - ngram_join._band(F.col("a"), num, den) > 1)
    assert far.count() == 0


def test_one_id_with_two_texts(spark):
    """Rows that repeat an id with other texts are compared each on its own."""
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, one), (5, two), (5, one), (7, two + " more"), (9, one + " more"), (9, "few words"), (3, two + " and more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(df).select("doc_id", "n_shingles", "component_id", "n_links").collect())
    assert got == [(3, 38, 3, 2), (5, 36, 3, 2), (5, 36, 5, 2), (5, 36, 5, 2), (7, 37, 3, 2), (9, 1, 9, 0), (9, 37, 5, 2)]
    assert sorted(tuple(r) for r in ngram_join.representatives(df).collect()) == [(3, two + " and more"), (5, one), (9, "few words")]


def test_search_at_the_threshold():
    """Links exactly at 0.75 count, just below they don't."""
    x = np.arange(4, dtype=np.uint64)
    sets = [x[:4], x[:3], np.arange(7, dtype=np.uint64), np.concatenate([np.arange(5), [90, 91]]).astype(np.uint64)]
    found = {(i, j) for i, js in ngram_join.search(sets, np.arange(4), np.arange(4), 75, 100) for j in js.tolist()}
    assert found == {(0, 1), (1, 0)}


def test_jaccard_join_on_odd_rows(odd_docs, no_docs):
    got = ngram_join.jaccard_components(odd_docs)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == odd_docs.count() and ngram_join.jaccard_components(no_docs).count() == 0
    by = defaultdict(set)
    for i, n, c, _ in rows:
        by[i].add((n, c))
    assert by[2] == {(8, 1)} and by[3] == {(0, 3)} and by[4] == {(0, 4)} and by[9] == {(1, 8)} and by[None] == {(1, None)} and by[7] == {(by[7].copy().pop()[0], 6)}
    kept = ngram_join.representatives(odd_docs)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, 6, 8, 10, 11, None], key=str) and kept.columns == odd_docs.columns


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fitted = labels.where("doc_id % 2 = 0")
    got = quality.classify(docs, fitted).join(labels.where("doc_id % 2 = 1"), "doc_id")
    n = {(r["quality"], r["kept"]): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.99 and n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.95


def test_quality_stage_agrees_and_odd_rows(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in quality.classify(docs, labels).where("kept").collect()}
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect()} == kept and len(kept) < docs.count()
    assert quality.keep_good(docs, labels).schema == docs.schema
    odd = spark.createDataFrame([(1, 1), (1, None), (8, 0), (6, 1), (None, 1)], "doc_id long, quality int")
    assert quality.classify(odd_docs, odd).count() == odd_docs.count()
    assert quality.keep_good(odd_docs, odd.limit(0)).count() == odd_docs.count() and quality.classify(no_docs, odd).count() == 0


def test_kth_largest(spark):
    values = [5, -3, 5, 1 << 62, -(1 << 63), (1 << 63) - 1, 0, -1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [quality.kth_largest(df, "v", k + 1) for k in range(len(values))] == sorted(values, reverse=True)


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms(spark, odd_docs, no_docs):
    cards = ["4539148803436467", "4485275742308327", "6011000990139424", "371449635398431"]
    assert all(map(luhn, cards))
    texts = [f"pay {c} now" for c in cards] + ["again 4539148803436467.", "spaced 4539 1488 0343 6467", "bad 4539148803436468", "ip 10.1.2.3 and 300.1.2.3", "born 1999-02-28, 1999-02-30", "call +1 (017) 555-7713 or +49 30 1234567", "ssn 123-45-6789 and 000-12-3456", "mail jo.doe99@example.com", "key 04dbebab91ab85687d33eeaaf9ac699e1188f962", "31/12/2001 12/31/2001 24.12.1999", "version 1.2.3 page 42"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r["text"] for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]
    fresh = [re.search(r"\d{13,}", o).group() for o in out[:4]]
    assert all(map(luhn, fresh)) and len(set(fresh)) == 4 and all(len(a) == len(b) and a != b for a, b in zip(fresh, cards, strict=True))
    assert out[4] == f"again {fresh[0]}." and out[5].replace(" ", "") == f"spaced{fresh[0]}"
    assert out[6] == texts[6] and out[14] == texts[14] and "300.1.2.3" in out[7] and "10.1.2.3" not in out[7]
    assert "1999-02-30" in out[8] and re.fullmatch(r"born \d{4}-\d\d-\d\d, 1999-02-30", out[8])
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \+49 \d\d \d{7}", out[9]) and out[9] != texts[9]
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4} and 000-12-3456", out[10]) and re.fullmatch(r"mail [a-z]{2}\.[a-z]{3}\d\d@example\.com", out[11])
    assert re.fullmatch(r"key [0-9a-f]{40}", out[12]) and out[12] != texts[12]
    first = out[13].split()[0]
    assert int(first[:2]) > 12 and [len(x) for x in out[13].split()] == [10, 10, 10]
    side = "a 4539148803436467 4485275742308327 b +1 (017) 555-7713 4539148803436467 10.1.2.3 +1 017 555 7713 c"
    row = pii.pseudonymise(spark.createDataFrame([(1, side)], "doc_id long, text string"), "k").first()["text"].split()
    assert row[1:3] == fresh[:2] and row[7] == fresh[0] and "".join(row[4:7]) != "+1(017)555-7713" and re.sub(r"\D", "", "".join(row[4:7])) == re.sub(r"\D", "", "".join(row[9:13])) and row[8] != "10.1.2.3"
    odd = pii.pseudonymise(odd_docs, "k")
    assert odd.schema.names == odd_docs.schema.names and odd.exceptAll(odd_docs).count() == 0 and pii.pseudonymise(no_docs, "k").count() == 0


def test_secrets_in_either_case(spark):
    token = "9233a8ec04dbebab91ab85687d33eeaa"
    mixed = "9233A8ec04dbebab91ab85687d33eeaa"
    texts = [f"TOKEN = {token.upper()}", f"token = {token}", f"token = {mixed}", "ID = " + "7" * 32, f"x{token.upper()}"]
    out = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    fresh = [t.split()[-1] for t in out]
    assert re.fullmatch("[0-9A-F]{32}", fresh[0]) and fresh[0] != token.upper() and fresh[1] == fresh[0].lower()
    assert re.fullmatch("[0-9A-Fa-f]{32}", fresh[2]) and fresh[2] != mixed and fresh[2].lower() == fresh[1]
    assert out[3:] == texts[3:]


def test_feistel_is_a_permutation(spark):
    """All dates of two years and all three-digit numbers have different images of the same kind."""
    numbers = spark.range(1000).select(F.format_string("%03d", "id").alias("t"))
    assert numbers.select(F.array_join(pii._permuted(F.col("t"), F.lit("k"), "x").cast("array<string>"), "").alias("p")).distinct().where("p rlike '^[0-9]{3}$'").count() == 1000
    dates = spark.sql("SELECT explode(sequence(date'1999-01-01', date'2000-12-31')) AS d").select(F.explode(F.array(F.date_format("d", "yyyy-MM-dd"), F.date_format("d", "dd/MM/yyyy"), F.date_format("d", "MM/dd/yyyy"))).alias("t")).distinct()
    assert dates.select(pii.pseudonym(F.col("t"), F.lit("k")).alias("p")).distinct().count() == dates.count()


def test_a_date_has_one_pseudonym_in_every_notation(spark):
    """All days of the span are permuted, and each shows the same day however it is written."""
    days = spark.sql("SELECT explode(sequence(date'1901-01-01', date'2096-12-31')) AS d")
    fresh = days.select("d", F.to_date(pii.pseudonym(F.date_format("d", "yyyy-MM-dd"), F.lit("k"))).alias("p"))
    told = fresh.agg(F.count_distinct("p"), F.min("p"), F.max("p"), F.count_if((F.dayofmonth("d") > 12) != (F.dayofmonth("p") > 12))).first()
    assert [str(x) for x in told] == ["71589", "1901-01-01", "2096-12-31", "0"]
    late = fresh.where("d BETWEEN date'1999-01-01' AND date'2000-12-31'")
    for form in ("dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy"):
        rows = late.where("day(d) > 12") if form == "dd/MM/yyyy" else late
        assert rows.where(F.to_date(pii.pseudonym(F.date_format("d", form), F.lit("k")), form) != F.col("p")).count() == 0


def test_native_plans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (pii.pseudonymise(docs, "k"), sharding.kd_shards(docs)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(spark, odd_docs, no_docs, shards):
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.kd_shards(docs, shards=shards).toPandas()
    text = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert {i: (len(t) + 1, zlib.crc32(t)) for i, t in text.items()} == {r.doc_id: (r.size, r.text_crc32) for r in rows.rename(columns={"size": "bytes"}).assign(size=rows["size"]).itertuples()}
    total = rows["size"].sum()
    group = rows.assign(text=rows["doc_id"].map(text)).groupby("text")
    largest = max(group["size"].sum()[group["size"].sum() <= total / shards / sharding.LARGE].max(), rows["size"].max())
    for _, part in rows.groupby("shard"):
        assert abs(part["size"].sum() - total / shards) <= 3 * largest
        assert sorted(part["slot"]) == list(range(len(part)))
    small = group["size"].sum() <= total / shards / 2
    assert (group["shard"].nunique()[small] == 1).all()
    assert rows["shard"].nunique() == shards
    odd = sharding.kd_shards(odd_docs, shards=shards)
    assert odd.count() == odd_docs.count() and sharding.kd_shards(no_docs, shards=shards).count() == 0
    assert sharding.kd_shards(docs, shards=None, target_bytes=1 << 19).groupBy("shard").agg(F.sum("size")).count() == -(-total // (1 << 19))


def test_shards_of_rows_that_are_alike(spark):
    """Half of all rows repeat id and text: they fit no shard, so they are spread; other copies stay together."""
    rows = [(7, "the same text again")] * 1500 + [(i, f"text {i // 3:08d} of a few") for i in range(1500)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), dimensions=("doc_id",)).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() < 0.05 * sizes.mean()
    other = got[got["doc_id"] != 7]
    assert (other.groupby(other["text_crc32"])["shard"].nunique() == 1).all()
    assert all(sorted(p["slot"]) == list(range(len(p))) for _, p in got.groupby("shard"))


def test_packing(spark, odd_docs, no_docs):
    rows = [(i, int(n), f"s{i % 5 if i % 3 else 0}", f"c{i % 40}") for i, n in enumerate(np.random.default_rng(3).integers(0, 300, 400))] + [(900, 1234, None, None), (901, None, "s1", None)]
    df = spark.createDataFrame(rows, "doc long, n long, source string, cluster string")
    got = packing.pack(df, "doc", "n", "source", "cluster", capacity=500, per_source=2, group=150).toPandas()
    of = {r[0]: r for r in rows}
    assert got.groupby("doc")["length"].sum().to_dict() == {i: n or 0 for i, n, *_ in rows}
    for _, b in got.groupby("bin_id"):
        assert b["length"].sum() <= 500 and sorted(b["slot"]) == list(range(len(b)))
        last = [of[d] for d, n in zip(b["doc"], b["length"], strict=True)]
        clusters = [r[3] for r in last if r[3]]
        assert len(clusters) == len(set(clusters)) and all(v <= 2 for k, v in Counter(r[2] for r in last).items() if k)
    assert sorted(got[got["doc"] == 900]["length"]) == [234, 500, 500]
    odd = packing.pack_documents(odd_docs).toPandas()
    assert len(odd) >= odd_docs.count() and packing.pack_documents(no_docs).count() == 0


def best_fit_slowly(lengths, sources, clusters, capacity, per_source):
    bins = []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        fit = [b for b in bins if b["room"] >= n and c not in b["clusters"] and b["sources"][s] < per_source]
        b = min(fit, key=lambda b: (b["room"], b["number"])) if fit else {"room": capacity, "number": len(bins), "clusters": set(), "sources": Counter()}
        if not fit:
            bins.append(b)
        b["room"] -= n
        b["clusters"].add(c)
        b["sources"][s] += 1
        yield b["number"]


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_is_the_tightest_compatible_bin(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.integers(1, 90, 200).tolist(), reverse=True)
    sources, clusters = rng.integers(0, 4, 200).tolist(), rng.integers(0, 30, 200).tolist()
    got = sorted(packing.best_fit(lengths, sources, clusters, 100, 2))
    assert [x[4] for x in got] == list(best_fit_slowly(lengths, sources, clusters, 100, 2))


def test_kneser_ney(spark, odd_docs, no_docs):
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in kneser_ney.train_and_score(docs).collect()}
    rows = [(r["doc_id"], [*words(r["text"]), "\0end"]) for r in docs.collect()]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    uses, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["\0start", *t], t, strict=False))
    total, kinds, contexts = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (v, w), n in pairs.items():
        total[v] += n
        kinds[v][min(n, 3) - 1] += 1
        contexts[w] += 1
    d = kneser_ney.discounts(*(Counter(pairs.values())[k] for k in (1, 2, 3, 4)))
    m = Counter(contexts.values())
    e = kneser_ney.discounts(*(m[k] for k in (1, 2, 3, 4)))
    n_all, known, tokens = sum(contexts.values()), len(uses), sum(uses.values())
    rest = (e[1] * m[1] + e[2] * m[2] + e[3] * sum(v for k, v in m.items() if k > 2)) / n_all

    def q(w):
        return max(contexts[w] - e[min(contexts[w], 3)], 0) / n_all + rest / (known + 1)

    def p(v, w):
        if not total[v]:
            return q(w)
        n = pairs[v, w]
        return (n - d[min(n, 3)]) / total[v] + sum(d[k + 1] * kinds[v][k] for k in range(3)) / total[v] * q(w)

    for i, t in rows:
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(uses[w] > 0 for w in t), tokens, zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r["base_score"], sum(math.log10((uses[w] + 1) / (tokens + known + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(v, w)) for v, w in zip(["\0start", *t], t, strict=False)), rel_tol=1e-9)
    for v in ("the", "\0start"):
        assert math.isclose(sum(p(v, w) for w in uses) + p(v, "\0never"), 1, rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    odd = kneser_ney.train_and_score(odd_docs).collect()
    assert len(odd) == odd_docs.count() and all(math.isfinite(r["score"]) for r in odd) and kneser_ney.train_and_score(no_docs).count() == 0


@pytest.fixture(scope="module")
def table():
    return pieces.PieceTable("/opt/tokenizers/piece_bpe_32k.model")


def test_pieces_equal_the_library(spark, odd_docs, no_docs, table):
    import random

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=table.path)
    some = spark.read.parquet(f"{SF}/documents.parquet").limit(40).select("doc_id", "text").unionByName(odd_docs.where("doc_id IS NULL OR doc_id NOT IN (6, 7)").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    spaceless = "".join(random.Random(1).choices("etaoinshrdlu", k=9_000))  # longer than several chunks
    more = ["Hello  world\n the  \n x", "aaaaaaa " + "a" * 300, "<s> </s> <0x0A> ▁x", "thisisalongword" * 20, "a\t\tb\r\n\n c ", "a" * 5_000, "ab" * 1_200 + "日" + "ßx😀" * 500, spaceless]
    docs = some.unionByName(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(more)], "doc_id long, text string")).withColumn("ids", F.lit("clash"))
    encoded = pieces.encode(docs, table)
    rows = encoded.collect()
    for r in rows:
        assert r["ids"] == (None if r["text"] is None else lib.encode(r["text"])), r["text"][:80]
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded.drop("text"), table).collect()}
    assert all(back[r["doc_id"]] == (r["text"] and r["text"].replace("▁", " ")) for r in rows)
    assert pieces.encode(no_docs, table).count() == 0


def test_scored_pieces_equal_a_slow_search(spark):
    """A unigram table: the highest sum of scores, short units and chunked ones alike."""
    import random

    letters = "ab"
    table = object.__new__(pieces.PieceTable)
    rng = random.Random(3)
    own = {"".join(rng.choices(letters, k=k)) for k in (2, 2, 3, 3, 4, 5)} | {"a", "b"}
    table.pieces = {p: (i, -rng.uniform(1, 6) * len(p) ** 0.8) for i, p in enumerate(sorted(own))}
    table.bpe, table.longest, table.bytes_, table.unknown = False, 5, {}, 99
    texts = ["".join(rng.choices(letters, k=n)) for n in (1, 2, 7, 30, 60, 2_500)]
    units = spark.createDataFrame([(t,) for t in texts], "unit string")
    small = units.where(F.char_length("unit") <= pieces.CHUNK)
    rows = pieces._short(small, table).unionByName(pieces._long(units.subtract(small), table)).collect()
    score = {p: round(s * (1 << 24)) for p, (_, s) in table.pieces.items()}
    for r in rows:
        got = pieces._walked(pa.array([r["unit"]]), pa.array([r["steps"]], pa.list_(pa.int64())), table).to_pylist()[0]
        names = {i: p for p, (i, _) in table.pieces.items()}
        assert "".join(names[i] for i in got) == r["unit"]
        best = [0] + [None] * len(r["unit"])
        for k in range(1, len(best)):
            best[k] = max(best[k - n] + score[r["unit"][k - n : k]] for n in range(1, min(5, k) + 1) if r["unit"][k - n : k] in score)
        assert sum(score[names[i]] for i in got) == best[-1]


def test_packing_of_rows_that_are_alike(spark):
    """A third of all rows are one row again and again: dealt out evenly, each once, packed in a time that grows with the rows."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, -7).otherwise(F.col("id")).alias("doc"), F.when(F.col("id") % 3 == 0, 40).otherwise(F.col("id") % 97).alias("n"), F.lit("s").alias("source"), F.when(F.col("id") % 3 == 0, "c").otherwise(F.col("id").cast("string")).alias("cluster"))
    got = packing.pack(rows, "doc", "n", "source", "cluster", capacity=500, per_source=4, group=1000).toPandas()
    assert len(got) == 20_000 and (got["doc"] == -7).sum() == 6667 and got[got["doc"] == -7]["bin_id"].nunique() == 6667
    share = got[got["doc"] == -7].groupby(got["bin_id"] // (1 << 32)).size()
    assert len(share) == 20 and share.max() - share.min() <= 1


def test_best_fit_with_copies_equals_the_slow_search():
    lengths, sources, clusters = [30] * 120 + [20] * 60 + [10] * 60, [0, 1, 2] * 80, [0] * 100 + [1] * 80 + list(range(2, 62))
    got = sorted(packing.best_fit(lengths, sources, clusters, 100, 2))
    assert [x[4] for x in got] == list(best_fit_slowly(lengths, sources, clusters, 100, 2))
    assert len({x[4] for x in packing.best_fit([5] * 50_000, [None] * 50_000, [1] * 50_000, 100, 2)}) == 50_000


def test_no_plan_shows_the_key(spark):
    df = pii.pseudonymise(spark.createDataFrame([(1, "call 415-555-0132")], "key long, text string"), "a-very-private-key")
    df.collect()
    plan = df._jdf.queryExecution()
    assert "a-very-private-key" not in plan.toString() and "a-very-private-key" not in plan.stringWithStats() and "a-very-private-key" not in plan.executedPlan().toString()
    import re

    assert re.search(spark.conf.get("spark.redaction.regex", "(?i)secret|password|token|access[.]?key"), "spark.spritelake.pseudonymSecret")
