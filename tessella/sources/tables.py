"""Keeping tables: keyed upserts, replacing derived rows, backfills, rewrites, exports. Each gives the new table as a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """Incoming rows (the newest of each key) replace existing ones of the same key."""
    w = Window.partitionBy(*keys).orderBy(*newest)
    last = incoming.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return existing.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def replace_derived(table: DataFrame, fresh: DataFrame, documents: DataFrame, doc: str) -> DataFrame:
    """All derived rows of the given documents are replaced by fresh ones; others stay."""
    return table.join(documents.select(doc).distinct(), doc, "left_anti").unionByName(fresh)


def rederive(existing: DataFrame, fresh: DataFrame, keys: Sequence[str], status: str, pending: str = "pending") -> DataFrame:
    """Reviewed rows stay; the rest is what was derived afresh."""
    kept = existing.filter(F.col(status) != pending)
    return kept.unionByName(fresh.join(kept.select(*keys), list(keys), "left_anti"))


def relabelled(rows: DataFrame, label: Column, old: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the new label and run id, one row of counters)."""
    new = rows.withColumn("new_label", label).withColumn("run_id", F.lit(run_id))
    log = new.agg(F.count("*").alias("seen"), F.count_if(~F.col("new_label").eqNullSafe(F.col(old))).alias("changed"))
    return new, log.withColumn("run_id", F.lit(run_id))


def missing_pairs(pairs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a resumed backfill still has to do."""
    return pairs.select(*keys).distinct().join(done.select(*keys).distinct(), list(keys), "left_anti")


def best_provenance(rows: DataFrame, key: str, priority: Column, tie: str, existing: DataFrame | None = None) -> DataFrame:
    """One row per key without an artifact yet: the best provenance, with a SHA-256 of the row."""
    if existing is not None:
        rows = rows.join(existing.select(key).distinct(), key, "left_anti")
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(priority, tie))).filter("_n = 1").drop("_n")
    return best.withColumn("sha256", F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256))


def rewritten(rows: DataFrame, columns: Sequence[str], changes: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(rows with all old strings replaced in the columns, one row with the number of changed rows for each column)."""
    new = {c: reduce(lambda x, ch: F.replace(x, F.lit(ch[0]), F.lit(ch[1])), changes, F.col(c)) for c in columns}
    counts = rows.agg(*(F.count_if(~e.eqNullSafe(F.col(c))).alias(f"changed_{c}") for c, e in new.items()))
    return rows.withColumns(new), counts


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def pruned_cases(cases: DataFrame, evidence: DataFrame, key: str, automatic: Column) -> DataFrame:
    """Without the automatic cases that have no evidence; reviewed ones stay."""
    held = evidence.select(key).distinct()
    return cases.filter(~automatic).unionByName(cases.filter(automatic).join(held, key, "left_semi"))


def log_entries(rows: DataFrame, kind: str, fields: Sequence[str], at: Column) -> DataFrame:
    """Operational log rows: id, kind, time and payload as JSON."""
    payload = F.to_json(F.struct(*fields))
    return rows.select(F.sha1(F.concat_ws("|", F.lit(kind), payload)).alias("log_id"), F.lit(kind).alias("kind"), at.alias("logged_at"), payload.alias("payload"))


def archived(rows: DataFrame, region: str, columns: Sequence[str]) -> DataFrame:
    """Canonical JSON (names sorted, nulls included) with its SHA-256 and size, to be written partitioned by region."""
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return rows.select(region, body.alias("payload")).select(region, "payload", F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").alias("size_bytes"))


def write_archive(df: DataFrame, path: str, region: str) -> None:
    df.write.mode("overwrite").partitionBy(region).json(path)


def artifact_lineage(rows: DataFrame, key: str, roles: Sequence[tuple[str, str]]) -> DataFrame:
    """An artifact for each known file of a document, with the nearest earlier one as its parent. roles: (role, column) in order."""
    ident = lambda role: F.sha1(F.concat_ws("|", F.lit("artifact"), F.col(key).cast("string"), F.lit(role)))
    made = []
    for i, (role, column) in enumerate(roles):
        parent = F.coalesce(*(F.when(F.col(c).isNotNull(), ident(r)) for r, c in reversed(roles[:i])), F.lit(None).cast("string"))
        made.append(F.when(F.col(column).isNotNull(), F.struct(ident(role).alias("artifact_id"), F.lit(role).alias("role"), F.col(column).cast("string").alias("uri"), parent.alias("parent_id"))))
    return rows.select(key, F.explode(F.array_compact(F.array(*made))).alias("a")).select(key, "a.*")


def address_cache(rows: DataFrame, cache: DataFrame, address: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(addresses not in the cache yet, rows with the cached status, rows per status)."""
    pending = rows.select(address).filter(F.col(address).isNotNull()).distinct().join(cache.select(address), address, "left_anti")
    known = rows.join(cache, address, "left").withColumn("geocode_status", F.coalesce("geocode_status", F.lit("pending")))
    return pending, known, known.groupBy("geocode_status").agg(F.count("*").alias("n"))
