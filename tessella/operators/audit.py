"""Audits: integrity, constraints, coverage, acceptance scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _check(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key is set but has no parent."""
    keys = parent.select(F.col(parent_key).alias("_key")).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_key"), "left_anti")


def childless(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    return parent.join(child.select(F.col(child_key).alias("_key")).distinct(), F.col(parent_key) == F.col("_key"), "left_anti")


def report(checks: Mapping[str, DataFrame]) -> DataFrame:
    """check_name, violations: the number of rows of each check."""
    out = None
    for name, df in checks.items():
        out = _check(name, df) if out is None else out.unionByName(_check(name, df))
    return out


def constraint_report(rows: DataFrame, constraints: Mapping[str, Column]) -> DataFrame:
    """Rows that break each declared constraint (unknown counts as kept), in one pass over the table."""
    counts = rows.agg(*(F.count_if(~c).alias(f"c{i}") for i, c in enumerate(constraints.values())))
    pairs = F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(f"c{i}").alias("violations")) for i, n in enumerate(constraints)))
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def lineage_problems(rows: DataFrame, key: str, parent: str, group: str) -> DataFrame:
    """Per row with a parent: broken if the parent is missing, crossed if it is of another group."""
    p = rows.select(F.col(key).alias("_key"), F.col(group).alias("_group"))
    joined = rows.filter(F.col(parent).isNotNull()).join(p, F.col(parent) == F.col("_key"), "left")
    problem = F.when(F.col("_key").isNull(), "broken").when(~F.col("_group").eqNullSafe(F.col(group)), "crossed")
    return joined.withColumn("problem", problem).filter("problem IS NOT NULL").select(key, parent, "problem")


def coverage_counts(regions: DataFrame, parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Every region with its count of each part, 0 if none; parts are counted before they are joined, so none multiplies another."""
    out = regions
    for name, df in parts.items():
        out = out.join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def grouped_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, n: the rows of each value of each column, in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def coverage_status(have: Column, target: int, pool: Column) -> Column:
    """complete, partial with more to fetch, exhausted, or missing."""
    return F.when(have >= target, "complete").when(pool > have, "candidates_left").when(have > 0, "exhausted").otherwise("missing")


def collection_outcome(regions: DataFrame, have: DataFrame, listed: DataFrame, key: str, target: int) -> DataFrame:
    """Per region: existing, listed, shortfall and status."""
    out = coverage_counts(regions, {"existing": have, "listed": listed}, key)
    return out.withColumn("shortfall", F.greatest(F.lit(0), F.lit(target) - F.col("existing"))).withColumn("status", coverage_status(F.col("existing"), target, F.col("listed")))


def acceptance_score(rows: DataFrame, key: str, accepted: Column, opposed: Column, precise: Column, negative: Column, issues: Column, has_url: Column) -> DataFrame:
    """1000 if any accepted + 30 opposed + 20 precise + 5 negative + issues + 2 with a link."""
    n = lambda c: F.count_if(c)
    score = 1000 * F.max(accepted.cast("int")) + 30 * n(opposed) + 20 * n(precise) + 5 * n(negative) + F.sum(issues) + 2 * F.max(has_url.cast("int"))
    return rows.groupBy(key).agg(score.cast("long").alias("score"))


def fill_shortfall(candidates: DataFrame, have: DataFrame, region: str, order: Sequence[Column], target: int) -> DataFrame:
    """Per region the best candidates, as many as it lacks."""
    need = have.select(region, F.greatest(F.lit(0), F.lit(target) - F.col("have")).alias("_need"))
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(region).orderBy(*order)))
    return ranked.join(need, region, "left").filter(F.col("rank") <= F.coalesce("_need", F.lit(target))).drop("_need")


def candidate_export(rows: DataFrame, region: str, doc: str, episode: str, confidence: str) -> DataFrame:
    """A row for each document of a region with any episode: episodes, best confidence.

    Sorted by region, then falling confidence, so a region's list is read off in order; no region is collected.
    """
    each = rows.groupBy(region, doc).agg(F.count_distinct(episode).alias("episodes"), F.max(confidence).alias("confidence"))
    return each.filter("episodes > 0").orderBy(region, F.desc("confidence"), doc)


def id_sets(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(ids in both, ids only in left)."""
    l, r = left.select(key), right.select(key)
    return l.intersect(r), l.subtract(r)
