"""A corpus pipeline: quality, near-deduplication, decontamination, secret redaction, tokenising.

Stages take documents and return documents, the last one tokens. Null and empty texts are documents: scored as empty,
duplicates of nothing, clean, and without tokens. Rows that are repeated stay once from the second stage on. Texts are
read whole, however long; null doc_ids stay. Columns of other names come through to the last stage, whatever they are
called; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.llm import bpe_codec, decontamination, near_dedup, quality, secrets
from symweave.llm.common import stored, unused
from symweave.llm.queries import GOOD

#: Words that a tokenising worker remembers and text bytes that it takes at once: fewer than by default, as executors also hold what earlier stages needed.
REMEMBERED, PART_BYTES = 30_000, 500_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled rows among docs, scores as good."""
    net = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    score = unused("score", docs)
    return quality.score_quality(docs, net, score).where(F.col(score) >= GOOD).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle and a similarity of 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, 80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 0.8, 5)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, credentials in their texts replaced."""
    return secrets.redact_secrets(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text."""
    given = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
    done = bpe_codec.encode_decode(given, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, remembered=REMEMBERED, part_bytes=PART_BYTES)
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [("quality", good_quality), ("near_dedup", one_of_each), ("decontamination", without_benchmark), ("secrets", without_secrets), ("bpe", tokenised)]

#: The classifier's training and the recursive tokeniser are beyond SQL; tests/llm compares the rows of every stage with
#: brute force over small fixtures, and the tokeniser with its library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
