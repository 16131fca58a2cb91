"""A corpus pipeline: toxic documents go, one of each group of near copies stays, documents
with benchmark passages go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet to the shared folder and reads it again as the next stage's docs.

Rows without a doc_id go through like any other, null and empty texts count as texts without
words, columns that the stages do not know stay, and an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ndspark.llm import bpe, decontaminate, simhash, toxicity
from ndspark.llm.common import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores as toxic go, repeated ones each; a null or empty text stays. The
    model learns from the rows of docs that have a label and are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are linked by a similarity of 0.8 or more of their sets of five-word shingles,
    the row with the least doc_id stays, and of several with that id one. Rows without an id stay
    where no row of their group has one, one of them. Null and empty texts are a group."""
    return simhash.deduplicate(docs, similarity=0.8)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of ten words of a benchmark item, or a whole shorter one, go,
    repeated ones each; null and empty texts stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as digests of its ids and of what they decode to; see bpe.encode_documents()."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("bpe", encode),
]

#: SQL can express neither the trained scores nor the fingerprints; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
