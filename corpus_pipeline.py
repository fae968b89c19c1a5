"""Corpus preparation in stages, each written as Parquet and read again as the next one's documents.

1. The quality classifier draws the documents that its models call good; the rest go.
2. Of each group of near duplicates (five-word shingles, Jaccard 0.75) the one with the
   smallest id stays.
3. Personal numbers and dates become format-preserving pseudonyms.
4. What is left is packed into bins; the result tells where each piece of each document lies.

Null texts have no n-grams and no shingles: they stay, and take one unit of a bin.  Rows that
repeat an id are compared by stage 2 each by its text; of those that repeat text and id one stays.  Columns beside those of
documents pass through until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spritelake.llm._shared import shared_dir
from spritelake.llm.ngram_join import representatives
from spritelake.llm.packing import pack_documents
from spritelake.llm.pii import pseudonymise
from spritelake.llm.quality import keep_good
from spritelake.llm.queries import pseudonym_key


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return representatives(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonymise(docs, pseudonym_key(spark))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality_classifier", quality_classifier), ("ngram_jaccard_join", ngram_jaccard_join), ("pii", pii), ("best_fit_packing", best_fit_packing)]

#: SQL can't express hashed model sampling and sequential packing; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
