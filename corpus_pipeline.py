"""From raw documents to token ids: quality rules, line de-duplication, near-duplicates, mixture, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the documents of the next.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import byte_bpe, line_dedup, mixture, ngram_join, quality_rules
from gaugeline.llm.ship import ship
from gaugeline.llm.words import WORD
from gaugeline.sources.tables import fresh_path


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, ``n_chars`` anew for changed texts."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned rules reject."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.learn_and_judge(docs, labels).where("kept").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; those that have no word left go."""
    ship(spark)
    out = line_dedup.delete_repeats(docs)
    return _counted(out.where((F.col("n_deleted") == 0) | F.col("text").rlike(WORD)), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    ship(spark)
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    ship(spark)
    return _counted(mixture.repeat_rows(mixture.mix(docs)), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of what they decode to."""
    ship(spark)
    coded = byte_bpe.encode_checked(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixture", mix_sources),
    ("byte_bpe", encode),
]

#: Learned rules, MinHash and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
