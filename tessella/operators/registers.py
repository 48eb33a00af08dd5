"""Register quality: flags, duplicates, conflicts, capacity verdicts, mapping candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_or_null(c: Column) -> Column:
    """A number written with commas or blanks; null if it isn't one."""
    return F.regexp_replace(c, r"[,\s]", "").try_cast("double")


def value_flag(raw: Column, high: float) -> Column:
    """parse_error, non_positive, outlier or ok."""
    v = number_or_null(raw)
    return F.when(v.isNull(), "parse_error").when(v <= 0, "non_positive").when(v > high, "outlier").otherwise("ok")


def quality_summary(rows: DataFrame, flag: str, dates: str, lat_ok: Column, snapshot: str) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"), F.count_if(lat_ok).alias("coord_valid"), F.count_if(F.col(dates).isNull()).alias("missing_dates"), F.count_if(F.col(flag) == "ok").alias("ok"),
        F.count_if(F.col(flag) == "outlier").alias("outlier"), F.min(snapshot).alias("first_snapshot"), F.max(snapshot).alias("last_snapshot"), F.count_distinct(snapshot).alias("snapshots"),
    )


def candidates_by_area(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Sorted distinct names per area, and how many."""
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(name)), "; ").alias("candidates"), F.count_distinct(name).alias("candidate_count"))


def with_candidates(rows: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with their area's candidates and the mapping's status: none, single or multiple."""
    joined = rows.join(candidates, list(keys), "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))
    return joined.withColumn("mapping_status", mapping_status(F.col("candidate_count")))


def mapping_status(n: Column) -> Column:
    return F.when(n == 0, "none").when(n == 1, "single").otherwise("multiple")


def capacity_verdict(columns: Sequence[str], tight: float) -> dict[str, Column]:
    """bottleneck (least of the columns, null if any is), complete, and verdict: unknown, blocked, tight or available."""
    complete = ~F.greatest(*(F.col(c).isNull() for c in columns))
    least = F.when(complete, F.least(*(F.col(c) for c in columns)))
    verdict = F.when(~complete, "unknown").when(least <= 0, "blocked").when(least < tight, "tight").otherwise("available")
    return {"bottleneck": least, "complete": complete, "verdict": verdict}


def duplicate_metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows, distinct keys, rows beyond the first of their key, and beyond the first of equal rows; nulls are equal."""
    per_row = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    per_key = per_row.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.count("*").alias("_d"))
    return per_key.agg(F.sum("_n").alias("total"), F.count("*").alias("distinct_keys"), (F.sum("_n") - F.count("*")).alias("duplicate_keys"), (F.sum("_n") - F.sum("_d")).alias("duplicate_rows"))


def first_per_key(rows: DataFrame, keys: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """Per key the first non-null value of each column, the number of rows, and whether a column has several values."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values]
    many = F.greatest(*(F.count_distinct(c) for c in values)) if len(values) > 1 else F.count_distinct(values[0])
    return rows.groupBy(*keys).agg(*firsts, F.count("*").alias("rows"), (many > 1).alias("conflict"))


def ambiguous_names(rows: DataFrame, name: str, key: str, measure: str) -> DataFrame:
    """Names that stand for more than one key, with their keys' number and the measure's range."""
    return rows.groupBy(name).agg(F.count_distinct(key).alias("keys"), F.min(measure).alias("low"), F.max(measure).alias("high")).filter("keys > 1")


def area_summary(rows: DataFrame, capacity: Column, coord_ok: Column, candidates: str) -> DataFrame:
    """One row: count, capacity, valid coordinates and all candidates of the selected rows."""
    return rows.agg(F.count("*").alias("total"), F.sum(capacity).alias("capacity"), F.count_if(coord_ok).alias("coord_valid"), F.array_join(F.array_sort(F.collect_set(candidates)), "; ").alias("candidates"))


def limits_comparison(rows: DataFrame, group: str, value: str, cap: float) -> DataFrame:
    """One row: groups with a known value, above the cap, and their sorted names."""
    return rows.agg(
        F.count_distinct(group).alias("groups"), F.count_if(F.col(value).isNotNull()).alias("known"), F.count_if(F.col(value) > cap).alias("over_cap"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col(value) > cap, F.col(group)))), ",").alias("over_cap_groups"),
    )


def signal_by_area(areas: DataFrame, rows: DataFrame, key: str, steps: Mapping[str, int]) -> DataFrame:
    """All areas with their number of rows (0 if none) and a signal: the highest step reached, else the first."""
    counted = areas.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    signal = F.lit(next(iter(steps)))
    for name, least in steps.items():
        signal = F.when(F.col("n") >= least, name).otherwise(signal)
    return counted.withColumn("signal", signal)


def region_of(address: Column, fallback: Column, renamed: Mapping[str, str]) -> Column:
    """(province, city, origin) from the first two words of an address, else of the fallback, provinces by their current names."""
    words = lambda c: F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+")
    own = F.size(words(address)) >= 2
    chosen = F.when(own, words(address)).otherwise(words(fallback))
    province = F.get(chosen, F.lit(0))
    for old, new in renamed.items():
        province = F.when(province == old, new).otherwise(province)
    return F.struct(F.when(province != "", province).alias("province"), F.get(chosen, F.lit(1)).alias("city"), F.when(own, "address").otherwise("fallback").alias("origin"))
