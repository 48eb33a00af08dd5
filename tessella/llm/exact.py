"""Exact deduplication by a 128-bit content hash, with texts compared byte by byte inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SPACE_RUN, blank_null, join_groups, join_small, materialize, release, row_keys, without_rows


def normal_text(text: str | Column) -> Column:
    """Null as empty, each run of white space as one space."""
    return F.regexp_replace(blank_null(text), SPACE_RUN, " ")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = F.md5
) -> DataFrame:
    """One row per document: row_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after normal_text; a null text is an empty one. Of equal texts the row with the
    smallest id stays; null ids come after all others; of rows that repeat an id exactly one stays. An empty table
    gives an empty result. Other columns of docs are ignored, whatever their names.

    Rows shuffle as hashes. Full texts move once, only those whose hash repeats and after a map-side combine, to
    prove that each hash group holds one text. Groups in which two texts collide are regrouped by the texts themselves.
    """
    marked = _marked(docs, F.monotonically_increasing_id(), id_col, text_col, content_hash)
    return marked.select("row_id", "keep_id", "group_size", "kept", "text_sha256")


def _marked(docs: DataFrame, number: Column, id_col: str, text_col: str, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """exact_groups with row_no, which tells rows apart that share an id: rows with equal ids and numbers fare alike."""
    text = normal_text(F.col(text_col))
    plain = docs.select(F.col(id_col).alias("row_id"), number.alias("row_no"), text.alias("t"))
    hashed = plain.select("row_id", "row_no", content_hash(F.col("t")).alias("h"), F.sha2("t", 256).alias("text_sha256"))
    rows = materialize(hashed, "exact-rows")
    groups = materialize(_grouped(rows), "exact-groups")

    repeated = groups.filter("group_size > 1").select("h")
    texts = join_small(docs.select(text.alias("t")).select("t", content_hash(F.col("t")).alias("h")), repeated, "h", "left_semi")
    texts = texts.groupBy("h", "t").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("texts"))
    collided = materialize(texts.filter("texts > 1").select("h"), "exact-collided")
    if not collided.isEmpty():
        again = plain.withColumn("h", content_hash(F.col("t")))
        again = join_small(again, collided, "h", "left_semi").select("row_id", "row_no", F.concat(F.lit("text:"), "t").alias("h"), F.sha2("t", 256).alias("text_sha256"))
        again = materialize(again, "exact-again")
        rows = join_small(rows, collided, "h", "left_anti").unionByName(again)
        groups = materialize(_grouped(rows), "exact-groups")
    marked = join_groups(rows, groups, "h", "group_size", rows.count())
    return marked.select(
        "row_id", F.col("first.row_id").alias("keep_id"), "group_size", (F.col("row_id").eqNullSafe(F.col("first.row_id")) & (F.col("row_no") == F.col("first.row_no"))).alias("kept"), "text_sha256", "row_no"
    )


def _grouped(rows: DataFrame) -> DataFrame:
    """Per hash: its row count and its first row by id (null last), then row_no."""
    return rows.groupBy("h").agg(
        F.min(F.struct(F.col("row_id").isNull().alias("no_id"), "row_id", "row_no")).alias("first"), F.count("*").alias("group_size")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns: of equal texts one row, as in exact_groups. Ids may be null or repeat.

    Rows are told apart by id and text; of rows that repeat both one stays.
    """
    keys = row_keys(id_col, text_col, docs.columns)
    marked = materialize(_marked(docs, F.xxhash64(text_col), id_col, text_col).filter("group_size > 1").select("row_id", "row_no", "kept"), "exact-marked")
    named = marked.select("kept", F.coalesce(F.concat(F.lit("i"), F.col("row_id").cast("string")), F.lit("n")).alias(list(keys)[0]), F.col("row_no").alias(list(keys)[1]))
    gone = materialize(named.filter("NOT kept").drop("kept").distinct(), "exact-gone")
    repeated = materialize(named.filter("kept").groupBy(*keys).agg(F.count("*").alias("kept")).filter("kept > 1").drop("kept"), "exact-repeated")
    release(marked)
    return without_rows(docs, keys, gone, repeated)
