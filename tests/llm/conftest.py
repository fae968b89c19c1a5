import re

import pytest


def words(text):
    """Lower-cased (A-Z) words of a text by the plain definition."""
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "src0", 10, "a"), (2, "The QUICK brown fox jumps over the lazy dog again and again", "en", "src0", 10, None), (2, "The QUICK brown fox jumps over the lazy dog again and again", "en", "src0", 10, None),
        (3, "", "en", None, 0, "b"), (4, None, None, "src1", None, None), (5, "   \n\t ", "fr", "src1", 6, "c"), (6, long, "en", "src2", len(long), "d"), (7, long + " end", "en", "src2", len(long) + 4, "d"), (None, "no id here at all", "de", "src3", 17, "e"),
        (8, "one", "en", "src0", 3, "f"), (9, "ONE", "en", "src0", 3, "f"), (10, "x" * 30_000, "en", "src0", 30_000, "g"), (11, "Ünï ßtraße 日本語 😀 text", None, None, 20, None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string"
    df = spark.createDataFrame(rows, schema)
    for name in ("id", "n", "k1", "rep", "component", "shard", "size", "part", "ids", "label", "margin", "h"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(7))
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id > 99999")
