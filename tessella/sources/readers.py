"""Reading raw records: minutes, permit registers, corpora, snapshots, gazetteers, listings, API dumps, manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the official permit CSV and the fields that they become.
PERMIT_COLUMNS = {"시설명": "facility_name", "대표소재지지번주소": "jibun_address", "가동상태명": "operation_status", "용량": "capacity_kw", "설치연도": "install_year", "데이터기준일자": "snapshot_date"}
#: A minutes file: the fields that make it one, and others.
MINUTES = T.StructType([T.StructField(n, T.StringType()) for n in ("DOCID", "RASMBLY_ID", "RASMBLY_NM", "MTG_DE", "MTGNM", "MTR_SJ", "MINTS_HTML", "ORGINL_FILE_URL")])


def read_minutes(spark: SparkSession, path: str, region: str = r"/([^/]+)/[^/]+$") -> DataFrame:
    """One row per JSON file: its fields, path, region_code (from the folder), and reject_reason (null if usable)."""
    schema = T.StructType([*MINUTES.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(path)
    rows = rows.withColumn("path", F.col("_metadata.file_path"))
    return rows.withColumn("region_code", F.regexp_extract("path", region, 1)).withColumn("reject_reason", reject_reason(F.col("_corrupt"), F.col("DOCID"), F.col("MINTS_HTML")))


def read_minutes_lines(spark: SparkSession, path: str, region: str = r"/([^/]+)/[^/]+$") -> DataFrame:
    """As read_minutes, for files with one record on each line."""
    schema = T.StructType([*MINUTES.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(path)
    rows = rows.withColumn("path", F.col("_metadata.file_path"))
    return rows.withColumn("region_code", F.regexp_extract("path", region, 1)).withColumn("reject_reason", reject_reason(F.col("_corrupt"), F.col("DOCID"), F.col("MINTS_HTML")))


def reject_reason(corrupt: Column, docid: Column, html: Column) -> Column:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(corrupt.isNotNull(), "invalid_json").when(blank(docid), "missing_docid").when(blank(html), "missing_html")


def first_new(rows: DataFrame, key: str, order: Sequence[Column], known: DataFrame | None = None) -> DataFrame:
    """The first row of each key that isn't known yet."""
    if known is not None:
        rows = rows.join(known.select(key).distinct(), key, "left_anti")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def content_key(columns: Sequence[str]) -> Column:
    """SHA-1 of the columns as JSON, in the order of their names, nulls included."""
    return F.sha1(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def read_permit_csv(spark: SparkSession, path: str, scope: str | None = None, encodings: Sequence[str] = ("UTF-8", "x-windows-949", "EUC-KR")) -> DataFrame:
    """The official CSV under the first encoding in which its required columns show; rows of the scope (address text) with keys.

    Korean code pages beyond Spark's own list need spark.sql.legacy.javaCharsets, which stays set once one is tried.
    """
    for encoding in encodings:
        if not encoding.upper().startswith("UTF-"):
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        rows = spark.read.option("header", True).option("encoding", encoding).csv(path)
        names = {c.lstrip("﻿").strip(): c for c in rows.columns}
        if set(PERMIT_COLUMNS) <= set(names):
            rows = rows.select(*(F.col(f"`{names[k]}`").alias(v) for k, v in PERMIT_COLUMNS.items()))
            return permits(rows, scope)
    raise ValueError(f"none of {encodings} shows the columns {sorted(PERMIT_COLUMNS)}")


def permits(rows: DataFrame, scope: str | None = None) -> DataFrame:
    """Typed permits with a content key; rows whose address doesn't hold `scope` are out."""
    keyed = rows.withColumn("source_record_key", content_key(rows.columns))
    keyed = keyed.withColumn("capacity_kw", F.regexp_replace("capacity_kw", ",", "").try_cast("double")).withColumn("snapshot_date", F.try_to_date("snapshot_date", "yyyy-MM-dd"))
    return keyed if scope is None else keyed.filter(F.col("jibun_address").contains(scope))


def load_register(rows: DataFrame, province: str, provinces: Sequence[str], coord_valid: Column, lat: str, lon: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the provinces, coordinates only where valid; one row of load counters)."""
    kept = rows.filter(F.col(province).isin(*provinces)).withColumn(lat, F.when(coord_valid, F.col(lat))).withColumn(lon, F.when(coord_valid, F.col(lon)))
    counters = rows.agg(
        F.count("*").alias("read"), F.count_if(F.col(province).isin(*provinces)).alias("loaded"), F.count_if(F.col(province).isin(*provinces) & coord_valid).alias("with_coordinates"),
    )
    return kept, counters.withColumn("skipped", F.col("read") - F.col("loaded"))


def pages_from_paragraphs(rows: DataFrame, doc: str, page: str, ordinal: str, text: str) -> DataFrame:
    """Page texts: paragraphs joined by blank lines in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, text))), lambda x: x[text]), "\n\n")
    return rows.groupBy(doc, page).agg(joined.alias("page_text"), F.count("*").alias("paragraphs"))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, scope: Column | None = None) -> DataFrame:
    """A snapshot in JSON or CSV (by its ending) under a given schema, rows of a scope only."""
    reader = spark.read.schema(schema)
    rows = reader.option("multiLine", True).json(path) if path.rstrip("/").endswith("json") else reader.option("header", True).csv(path)
    return rows if scope is None else rows.filter(scope)


def first_seen_queries(rows: DataFrame, region: str, doc: str, query: str, order: str, need: int) -> DataFrame:
    """Per region and document the query that found it first, and the first `need` documents of each region."""
    seen = rows.groupBy(region, doc).agg(F.min_by(query, order).alias("first_query"), F.min(order).alias("first_order"))
    return seen.withColumn("rank", F.row_number().over(Window.partitionBy(region).orderBy("first_order", doc))).filter(F.col("rank") <= need)


def typed_dump(rows: DataFrame, numbers: Sequence[str], dates: Mapping[str, str]) -> DataFrame:
    """Raw strings of an API dump as numbers (commas allowed) and dates; what can't be read is null."""
    made = {c: F.regexp_replace(c, ",", "").try_cast("double") for c in numbers} | {c: F.try_to_date(c, f) for c, f in dates.items()}
    return rows.withColumns(made)


def merged_manifests(rows: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Per key the fields of the last row."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("m")).select(key, "m.*")


def by_precedence(base: DataFrame, others: Sequence[DataFrame], key: str, fields: Sequence[str]) -> DataFrame:
    """base's fields, where null those of the other tables in turn."""
    out = base
    for i, o in enumerate(others):
        out = out.join(o.select(key, *(F.col(f).alias(f"_{i}_{f}") for f in fields)), key, "left")
    return out.select(key, *(F.coalesce(f, *(f"_{i}_{f}" for i in range(len(others)))).alias(f) for f in fields))
