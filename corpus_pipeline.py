"""A corpus pipeline of five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import exact, langid, mixing, ngram_join, packing
from tessella.llm.common import BATCH_ROWS, TEXT_ROWS, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def whole_texts(stage: Stage) -> Stage:
    """The stage in a session whose Parquet reader and Python workers take TEXT_ROWS rows at a time, as each row brings a whole text.

    Spark's usual batches are of 4,096 and 10,000 rows. Vectored reads are off, as the file system's reading threads keep
    direct buffers as long as whole columns of texts. The settings stay, since the stage's result is computed after it
    returns; results don't depend on them.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for setting in (BATCH_ROWS, "spark.sql.parquet.columnarReaderBatchSize"):
            spark.conf.set(setting, str(TEXT_ROWS))
        spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
        return stage(spark, docs, sf_dir)

    return run


@whole_texts
def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is undetermined (no letter) or ambiguous; learn from three quarters of the labelled."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    model = langid.fit_languages(docs.filter(fold != 2))
    return langid.keep_identified(docs, model)


@whole_texts
def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the smallest id stays."""
    return exact.drop_exact_duplicates(docs)


@whole_texts
def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, Jaccard 0.8 or more."""
    return ngram_join.drop_near_duplicates(docs, n=5, percent=80)


@whole_texts
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it."""
    return mixing.take_mix(docs)


@whole_texts
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024 tokens."""
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_sequences(docs, path, sequence=1024, end_id=0).withColumnRenamed("row_id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_exact),
    ("ngram_jaccard", drop_near),
    ("source_mix", mix),
    ("packing", pack),
]

#: Tokenisation and language models can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
