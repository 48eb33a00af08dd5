"""Registration of queries: each runs a library operator over the tables of a folder, with its SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.text_index import TextIndex, create_index
from tessella.sources.scratch import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


_indexes: dict[tuple[str, str], TextIndex] = {}


def document_index(t: Tables) -> TextIndex:
    """The index of the texts of `documents`, built by the first query of a session that searches these files, then shared."""
    files = t.spark.read.format("binaryFile").load(f"{t.folder}/documents.parquet").select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
    key = (t.spark.sparkContext.applicationId, f"{t.folder} {files.agg(F.sum('h')).first()[0]}")
    if key not in _indexes:
        _indexes[key] = create_index(t.documents, scratch_folder(t.spark, "index"), "doc_id", "text")
    return _indexes[key]


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return register
