"""Versioned siting rules against project attributes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.ranges import unit_join
from tessella.sources.scratch import settled


def _nodes_of(day: Column, levels: int) -> Column:
    """The nodes (level, number) of a binary tree over days from 0 that hold a day, one for each level."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda l: F.struct(l.alias("level"), F.call_function("shiftright", day, l).alias("node")))


def _nodes_before(end: Column, levels: int) -> Column:
    """The fewest nodes that together hold the days from 0 to end - 1: one for each bit of end."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(levels)), lambda l: F.call_function("shiftright", end, l) % 2 == 1)
    return F.transform(bits, lambda l: F.struct(l.alias("level"), (F.call_function("shiftright", end, l) - 1).alias("node")))


def rules_in_force(days: DataFrame, rules: DataFrame, region: str, as_of: str) -> DataFrame:
    """days (region, as_of: different ones) with the active rules of the region and the national ones that haven't expired.

    An interval join on equal keys: the days form a binary tree, a rule's time up to valid_to is the union of few of its
    nodes, and a day lies in one node of each level, so each rule and day meet once, under their region, or not at all.
    Neither side is broadcast or compared with all of the other.
    """
    r = rules.withColumnRenamed("region_code", "_rule_region").filter("active")
    span = days.agg(F.min(as_of).alias("first"), F.coalesce(F.datediff(F.max(as_of), F.min(as_of)), F.lit(0)).alias("n")).first()
    first, n = F.lit(span["first"]).cast("date"), span["n"] + 1
    levels = n.bit_length()
    own = F.struct(F.lit(False).alias("national"), F.col(region).alias("code"))
    everywhere = F.struct(F.lit(True).alias("national"), F.lit(None).cast(days.schema[region].dataType).alias("code"))
    d = days.withColumn("_at", F.explode(F.when(F.col(region).isNull(), F.array(everywhere)).otherwise(F.array(own, everywhere))))
    whole = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).alias("node")))
    in_days = F.when(F.col(as_of).isNotNull(), _nodes_of(F.datediff(as_of, first), levels)).otherwise(F.array().cast("array<struct<level:int,node:int>>"))
    d = d.withColumn("_cell", F.explode(F.concat(whole, in_days)))
    end = F.least(F.datediff("valid_to", first) + 1, F.lit(n))
    cells = F.when(F.col("valid_to").isNull(), whole).when(end > 0, _nodes_before(end, levels))
    code = F.col("_rule_region").cast(days.schema[region].dataType)
    r = r.withColumn("_at", F.struct(F.col("_rule_region").isNull().alias("national"), code.alias("code"))).withColumn("_cell", F.explode(cells))
    flat = lambda df: df.withColumns({"_national": F.col("_at.national"), "_code": F.coalesce(F.col("_at.code").cast("string"), F.lit("")), "_level": F.col("_cell.level"), "_node": F.col("_cell.node")}).drop("_at", "_cell")
    return flat(d).hint("merge").join(flat(r), ["_national", "_code", "_level", "_node"]).drop("_national", "_code", "_level", "_node")


def applicable_rules(requests: DataFrame, rules: DataFrame, region: str, as_of: str) -> DataFrame:
    """Requests with the active rules of their region and the national ones (null region), not expired; local ones first.

    A rule that isn't in force yet stays, with effective false. The different pairs of region and day meet the rules
    (rules_in_force), then the requests of each pair; of a pair with very many requests or rules no task gets all.
    """
    day = F.to_json(F.struct(F.col(region).alias("r"), F.col(as_of).alias("d")))
    keyed = requests.withColumn("_day", day)
    days = settled(keyed.select("_day", region, as_of).distinct(), "rule-days")
    found = settled(rules_in_force(days, rules, region, as_of).drop(region, as_of), "rules-in-force")
    joined = unit_join(keyed, found, ["_day"]).drop("_day")
    return joined.withColumn("is_local", F.col("_rule_region").isNotNull()).withColumn("effective", F.col("valid_from").isNull() | (F.col("valid_from") <= F.col(as_of))).drop("_rule_region")


def operator_result(op: Column, observed: Column, threshold: Column) -> Column:
    """Three-valued: null where something needed is unknown."""
    return (
        F.when(op == "exists", observed.isNotNull()).when(op == "gte", observed >= threshold).when(op == "gt", observed > threshold)
        .when(op == "lte", observed <= threshold).when(op == "lt", observed < threshold).when(op == "eq", observed == threshold)
    )


def rule_status(result: Column) -> Column:
    return F.when(result.isNull(), "check_required").when(result, "pass").otherwise("fail")


def cap_status(observed: Column, cap: Column) -> Column:
    """A cap on what local rules may demand: beyond it nothing can fail; within it the local rule decides."""
    return F.when(observed.isNotNull() & cap.isNotNull() & (observed >= cap), "pass").otherwise("check_required")


def prohibited_status(effective: Column) -> Column:
    """A criterion that may not be applied: no obstacle once in force."""
    return F.when(effective, "pass").otherwise("check_required")


def evaluate(rows: DataFrame, observed: Mapping[str, str], kind: str = "rule_kind") -> DataFrame:
    """Applicable rules with observed_value and status. observed: reference object to the request's column."""
    value = F.coalesce(*(F.when(F.col("reference_object") == k, F.col(c).cast("double")) for k, c in observed.items()), F.lit(None).cast("double"))
    rows = rows.withColumn("observed_value", value)
    plain = rule_status(operator_result(F.col("operator"), F.col("observed_value"), F.col("threshold_value")))
    status = F.when(F.col(kind) == "cap", cap_status(F.col("observed_value"), F.col("threshold_value"))).when(F.col(kind) == "prohibited", prohibited_status(F.col("effective"))).otherwise(plain)
    return rows.withColumn("status", status)


def ratio_checks(rows: DataFrame, key: str, ratio: Column, low: float, high: float, p10: str, p90: str) -> DataFrame:
    """Check rows of a ratio: within the plausible range, and within the benchmark's middle."""
    r = rows.withColumn("_ratio", ratio)
    status = lambda ok: rule_status(ok)
    checks = F.array(
        F.struct(F.lit("plausible_range").alias("check"), status(F.col("_ratio").between(low, high)).alias("status")),
        F.struct(F.lit("benchmark").alias("check"), status((F.col("_ratio") >= F.col(p10)) & (F.col("_ratio") <= F.col(p90))).alias("status")),
    )
    return r.select(key, F.round("_ratio", 4).alias("observed_value"), F.explode(checks).alias("c")).select(key, "observed_value", "c.*")


def area_checks(rows: DataFrame, key: str, site: str, installed: str) -> DataFrame:
    """Check rows of areas: the installed one within the site's (needs both), the share of the site (needs both, not 0), and a missing site area."""
    s, i = F.col(site).cast("double"), F.col(installed).cast("double")
    share = i / F.when(s != 0, s)
    relation = F.struct(F.lit("area_relation").alias("check"), i.alias("observed_value"), F.when(i <= s, "pass").otherwise("fail").alias("status"))
    missing = F.struct(F.lit("site_area_required").alias("check"), F.lit(None).cast("double").alias("observed_value"), F.lit("check_required").alias("status"))
    coverage = F.struct(F.lit("site_coverage").alias("check"), F.round(share, 3).alias("observed_value"), F.when(share <= 1, "pass").otherwise("fail").alias("status"))
    first = F.when(s.isNotNull() & i.isNotNull(), relation).when(s.isNull(), missing)
    checks = F.array_compact(F.array(first, F.when(share.isNotNull() & (i != 0), coverage)))
    return rows.select(key, F.explode(checks).alias("c")).select(key, "c.*")


def layer_checks(rows: DataFrame, key: str, names: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per key and group of patterns: whether one of the feature names (array) matches; unknown where there are no features."""
    hit = lambda patterns: F.exists(names, lambda n: n.rlike("|".join(patterns)))
    checks = [F.struct(F.lit(g).alias("check"), F.when(F.coalesce(F.size(names), F.lit(0)) == 0, "check_required").when(hit(p), "fail").otherwise("pass").alias("status")) for g, p in groups.items()]
    return rows.select(key, F.explode(F.array(*checks)).alias("c")).select(key, "c.*")


def missing_checks(requests: DataFrame, evaluated: DataFrame, key: str, required: Mapping[str, str]) -> DataFrame:
    """A check_required row for each request without a local rule, and for each required input that is null."""
    local = evaluated.filter("is_local").select(key).distinct()
    none = requests.join(local, key, "left_anti").select(key, F.lit("local_rule").alias("missing"))
    inputs = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(name)) for c, name in required.items())))
    return none.unionByName(requests.select(key, F.explode(inputs).alias("missing"))).withColumn("status", F.lit("check_required"))


def status_counts(checks: DataFrame, key: str) -> DataFrame:
    return checks.groupBy(key).agg(F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "check_required").alias("unknown"), F.count("*").alias("checks"))


def rules_from_wide(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A rule row for each known threshold column of a snapshot row."""
    return rows.unpivot(list(keys), list(columns), "reference_object", "threshold_value").filter("threshold_value IS NOT NULL")
