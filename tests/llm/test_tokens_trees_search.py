"""Byte-level BPE, Merkle manifest and lexical search against the library and slow versions, on odd rows and ties."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spritelake.llm import bpe, lexical, merkle, queries

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return bpe.Ranks(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def split(words, text):
    found = []
    for _, _, strings, _ in words.pieces([text]):
        names, _, which, _ = words.distinct(strings)
        found += [names[k] for k in which.tolist()]
    return found


def test_words_and_ids_are_the_librarys(library, ranks):
    rng, words = random.Random(7), bpe.Words(bpe.classes(), chunk=40)  # a small chunk, so texts are cut into pieces
    for _ in range(1500):
        text = "".join(rng.choice(" \n\t'srtvmeldT aB1२½!-_́日😀　\x85߀") for _ in range(rng.randrange(1, 160)))
        found = split(words, text)
        assert "".join(found) == text
        names = sorted(set(found))
        ids, n = bpe.replay([w.encode() for w in names], ranks)
        of = dict(zip(names, np.split(ids, np.cumsum(n)[:-1]), strict=True))
        assert [i for w in found for i in of[w].tolist()] == library.encode_ordinary(text), text


@pytest.mark.parametrize("seed", range(60))
def test_replay_keeps_the_order_of_single_words(seed):
    """Random vocabularies bring in pairs of lower rank after a merge, and overlapping ones."""
    rng = random.Random(seed)
    tokens = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(2, 6))) for _ in range(40)}
    vocabulary = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(rng.sample(sorted(tokens), len(tokens)))}
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    ids, n = bpe.replay([w.encode() for w in words], bpe.Ranks.of(vocabulary))
    want = tiktoken.Encoding("t", pat_str="[ab]+", mergeable_ranks=vocabulary, special_tokens={})
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [want.encode_ordinary(w) for w in words]


def test_clashing_hashes_cost_no_id(ranks, monkeypatch):
    monkeypatch.setattr(bpe.Words, "hashes", lambda self, cp, at: np.full(len(at), 5, np.uint64))
    words = bpe.Words(bpe.classes())
    assert split(words, "one two one three two") == ["one", " two", " one", " three", " two"]


def test_round_trip_on_odd_rows(spark, odd_docs, no_docs, library, ranks):
    rows = bpe.round_trip(odd_docs, ranks).collect()
    want = Counter()
    for r in odd_docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(r["text"] or "")] += 1
    assert Counter(map(tuple, rows)) == want
    assert bpe.round_trip(no_docs, ranks).count() == 0
    out = bpe.decode(bpe.encode(odd_docs, ranks), ranks)
    assert set(odd_docs.columns) < set(out.columns) and out.where(F.coalesce("text", F.lit("")) != F.col("decoded").cast("string")).count() == 0
    with pytest.raises(ValueError, match="SPLIT"):
        bpe.Ranks(public.path("byte_bpe_50k.tiktoken"), r"\S+")


def test_equal_to_the_library_on_all_documents(spark, library):
    got = {r["doc_id"]: r for r in queries.op11_bpe_merge_replay(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["n_tokens"] == len(ids) and got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def tree(leaves, arity):
    """(root, path of each leaf: siblings before and after at each level) of one tree, by the plain definition."""
    nodes, paths, under = list(leaves), [[] for _ in leaves], [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        above, held = [], []
        for k in range(0, len(nodes), arity):
            run = nodes[k : k + arity]
            for j in range(len(run)):
                for leaf in under[k + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(sha("".join(run)))
            held.append([leaf for u in under[k : k + arity] for leaf in u])
        nodes, under = above, held
    return nodes[0], paths


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_equals_the_slow_tree(spark, arity):
    rng = random.Random(arity)
    rows = [(i if i % 9 else None, rng.choice(["a", "b", "ä", "", None, "lone"] if i < 60 else ["a"]), sha(str(i // 2))) for i in range(170)] + [(999, "single", sha("x"))]
    got = Counter()
    out = merkle.proofs(spark.createDataFrame(rows, "id long, g string, leaf string"), "id", "g", "leaf", arity=arity)
    for r in out.select("id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof"), merkle.folded(F.col("leaf"), F.col("path")).alias("again")).collect():
        got[r["id"], r["leaf"], r["subroot"], r["root"], r["proof"]] += 1
        assert r["again"] == r["root"]
    groups = sorted({r[1] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    ordered = {g: sorted((r for r in rows if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, r[2])) for g in groups}
    trees = {g: tree([r[2] for r in rs], arity) for g, rs in ordered.items()}
    root, tops = tree([trees[g][0] for g in groups], arity)
    want = Counter()
    for g, top in zip(groups, tops, strict=True):
        for r, path in zip(ordered[g], trees[g][1], strict=True):
            want[r[0], r[2], trees[g][0], root, sha("".join(a + b for a, b in path + top))] += 1
    assert got == want


def test_manifest_on_odd_rows(spark, odd_docs, no_docs):
    rows = merkle.verified_manifest(odd_docs).collect()
    assert len(rows) == odd_docs.count() and merkle.verified_manifest(no_docs).count() == 0
    tampered = {r["doc_id"] for r in odd_docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 0 AND n_chars IS NOT NULL").collect()}
    assert all(r["verified"] == (r["doc_id"] not in tampered) and len({x["root"] for x in rows}) == 1 for r in rows)
    with pytest.raises(ValueError):
        merkle.proofs(no_docs, "doc_id", "lang", "text", arity=1)


def slow_scores(docs, items, top):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words = [(i, Counter(find(t))) for i, t in docs]
    words = [(i, c, sum(c.values())) for i, c in words if c]
    n, total = len(words), sum(w for *_, w in words)
    df = Counter(t for _, c, _ in words for t in c)
    for q, (item, text) in enumerate(items):
        asked, out = Counter(find(text)), []
        for i, c, length in words:
            m = 25 + 75 * length * n // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in asked.items() if t in c)
            if score > 0:
                out.append((-score, i is None, i or 0))
        for rank, (s, null, i) in enumerate(sorted(out)[:top], 1):
            yield q, item, rank, None if null else i, -s


@pytest.mark.parametrize("shard_bytes", [300, 1 << 24])
def test_search_equals_scoring_all(spark, odd_docs, shard_bytes):
    """Many shards and one, with copies that tie, rows that repeat an id, a long text and queries that repeat or find nothing."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "日本"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(300)] + [(400 + i, "W1 w2, w3-w4 w1") for i in range(40)] + [(None, "w1 w2"), (7, "w1 w2"), (7, "w1 w2"), (8, ""), (9, None), (10, " ".join(words) * 200)]
    items = [(1, "w1 w2 w3"), (1, "w1 w2 w3"), (None, "w5 w5 Ünï nothing"), (3, ""), (4, None), (5, "absent"), (6, " ".join(words))]
    table = lexical.index(spark.createDataFrame(docs, "doc_id long, text string"), shard_bytes=shard_bytes)
    got = lexical.search(table, spark.createDataFrame(items, "item_id long, text string"), top=7).collect()
    assert Counter(map(tuple, got)) == Counter(r[1:] for r in slow_scores(docs, items, 7))
    odd = lexical.search(lexical.index(odd_docs, shard_bytes=shard_bytes), spark.createDataFrame([(1, "quick fox one text w1x1")], "item_id long, text string"))
    assert {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in odd.collect()} == {r[1:] for r in slow_scores([(r["doc_id"], r["text"]) for r in odd_docs.collect()], [(1, "quick fox one text w1x1")], 10)}


def test_search_of_nothing(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical.ranked(no_docs, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0 and lexical.ranked(odd_docs, none).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_blocks_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 14, 6)
    scores = rng.integers(1, 100, int(lengths.sum()))
    longest, cost = 5, int(rng.integers(1, 200))
    ends = lexical.block_ends(scores, lengths, longest, cost)
    at = 0
    for n in lengths.tolist():
        s = scores[at : at + n]
        least = [0] + [10**9] * n
        for j in range(1, n + 1):
            least[j] = min(least[i] + int(s[i:j].max()) * (j - i) + cost for i in range(max(0, j - longest), j))
        mine = [e - at for e in ends.tolist() if at < e <= at + n]
        assert mine[-1] == n and all(b - a <= longest for a, b in zip([0, *mine], mine, strict=False))
        assert sum(int(s[a:b].max()) * (b - a) + cost for a, b in zip([0, *mine[:-1]], mine, strict=True)) == least[n]
        at += n
