"""Cases: merging episodes by identity, candidate links and locations, reviews and tasks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ranges import UNIT, dealt_join, unit_join


def case_rollup(rows: DataFrame, key: str, start: str, end: str, confidence: str, issues: str) -> DataFrame:
    """Per case: first start, last end, greatest confidence, all issue types, episodes."""
    return rows.groupBy(key).agg(
        F.min(start).alias("started_on"), F.max(end).alias("ended_on"), F.max(confidence).alias("confidence"), F.array_sort(F.collect_set(issues)).alias("issue_types"), F.count("*").alias("episodes")
    )


def case_key(place: Column, project: Column, episode: Column) -> Column:
    """Identity of a case: its place and project if it has any, else the episode alone. A facility type is no identity."""
    strong = F.concat_ws("|", F.when(place.isNotNull(), F.concat(F.lit("place:"), place)), F.when(project.isNotNull(), F.concat(F.lit("project:"), project)))
    return F.when(strong != "", strong).otherwise(F.concat(F.lit("episode:"), episode.cast("string")))


def document_cases(evidence: DataFrame, doc: str, case: str, paragraph: str, episode: str) -> DataFrame:
    return evidence.groupBy(doc, case).agg(
        F.count_distinct(paragraph).alias("paragraph_count"), F.count_distinct(episode).alias("episode_count"), F.min(paragraph).alias("first_paragraph"), F.max(paragraph).alias("last_paragraph")
    )


def case_paragraphs(evidence: DataFrame, case: str, paragraph: str, role: str, episode: str, limit: int) -> DataFrame:
    """Per case its first `limit` paragraphs with sorted distinct roles and episodes, the total, and whether it was cut."""
    each = evidence.groupBy(case, paragraph).agg(F.array_join(F.array_sort(F.collect_set(role)), ",").alias("roles"), F.array_join(F.array_sort(F.collect_set(F.col(episode).cast("string"))), ",").alias("episodes"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy(case).orderBy(paragraph))).withColumn("total", F.count("*").over(Window.partitionBy(case)))
    return ranked.filter(F.col("rank") <= limit).withColumn("truncated", F.col("total") > limit)


def counts_per_case(evidence: DataFrame, case: str, distinct: Mapping[str, str]) -> DataFrame:
    return evidence.groupBy(case).agg(*(F.count_distinct(c).alias(name) for name, c in distinct.items()))


def shared_paragraphs(evidence: DataFrame, paragraph: str, case: str) -> DataFrame:
    """Paragraphs that serve more than one case, with the number of cases."""
    return evidence.groupBy(paragraph).agg(F.count_distinct(case).alias("cases")).filter("cases > 1")


def evidence_view(evidence: DataFrame, cases: DataFrame, places: DataFrame, case: str, place: str, role: str, roles: Sequence[str]) -> DataFrame:
    """Evidence with its case and the case's place where known, numbered within the case by role order, then paragraph."""
    rank = F.coalesce(*(F.when(F.col(role) == r, i) for i, r in enumerate(roles)), F.lit(len(roles)))
    # Cases meet their places first: the evidence is dealt once, by case, and numbered where it lies.
    joined = dealt_join(evidence, dealt_join(cases, places, [place], "left"), [case])
    columns = [place, case, *(c for c in (*evidence.columns, *cases.columns, *places.columns) if c not in (place, case))]
    keys = [c for c in evidence.columns if c not in (case, role)]
    return joined.select(*columns).withColumn("position", F.row_number().over(Window.partitionBy(case).orderBy(rank, *keys)))


def sufficient(weights: Mapping[str, float], low: float) -> list[tuple[str, ...]]:
    """The smallest sets of features whose weights reach `low` (rounded as scores are): each pair that scores enough has all of one of them."""
    found: list[tuple[str, ...]] = []
    for size in range(len(weights) + 1):
        for some in combinations(weights, size):
            if round(sum(weights[n] for n in some), 4) >= low and not any(set(f) <= set(some) for f in found):
                found.append(some)
    return found


def weighted_pairs(rows: DataFrame, key: str, block: str, features: Mapping[str, tuple[Column, float]], low: float, high: float, unit: int = UNIT) -> DataFrame:
    """left, right, score: pairs of one block with low <= score < high. features: per name a row value and a weight.

    A feature counts where both rows have it and it is equal (arrays: where they overlap). Rows don't meet all others of
    their block: for each smallest set of features that is enough for `low`, those meet that have these features in common,
    and a pair is kept from the first such set. Of a value that very many rows of a block share, no task gets more than `unit`
    rows of a side (unit_join). Only with low <= 0 whole blocks are compared.
    """
    names = {n: f"_f{i}" for i, n in enumerate(features)}
    plain = rows.select(F.col(key).alias("_id"), F.col(block).alias("_block"), *(features[n][0].alias(c) for n, c in names.items())).filter(F.col("_block").isNotNull())
    arrays = {c for c in names.values() if plain.schema[c].dataType.typeName() == "array"}
    mine = plain.select("_block", *(F.col(c).alias(f"{c}_l") for c in ("_id", *names.values())))
    theirs = plain.select("_block", *(F.col(c).alias(f"{c}_r") for c in ("_id", *names.values())))
    same = lambda c: F.coalesce(F.arrays_overlap(f"{c}_l", f"{c}_r") if c in arrays else F.col(f"{c}_l") == F.col(f"{c}_r"), F.lit(False))
    score = F.round(F.least(F.lit(1.0), sum((F.when(same(c), features[n][1]).otherwise(0.0) for n, c in names.items()), F.lit(0.0))), 4)
    sets, out = [[names[n] for n in some] for some in sufficient({n: w for n, (_, w) in features.items()}, low)], None
    for at, some in enumerate(sets):
        l, r = mine, theirs
        for c in some:
            value = lambda side, c=c: F.explode(F.array_distinct(f"{c}_{side}")) if c in arrays else F.col(f"{c}_{side}")
            l, r = l.withColumn(f"_on{c}", value("l")), r.withColumn(f"_on{c}", value("r"))
        pairs = unit_join(l, r, ["_block", *(f"_on{c}" for c in some)], unit).filter(F.col("_id_l") < F.col("_id_r"))
        for c in some:
            if c in arrays:  # of several common elements the least brings the pair
                pairs = pairs.filter(F.col(f"_on{c}") == F.array_min(F.array_intersect(f"{c}_l", f"{c}_r")))
        for earlier in sets[:at]:
            pairs = pairs.filter(~reduce(lambda a, b: a & b, (same(c) for c in earlier)))
        found = pairs.select(F.col("_id_l").alias("left"), F.col("_id_r").alias("right"), score.alias("score")).filter((F.col("score") >= low) & (F.col("score") < high))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else plain.select(F.col("_id").alias("left"), F.col("_id").alias("right"), F.lit(0.0).alias("score")).filter(F.lit(False))


def location_candidates(links: DataFrame, case: str, place: str, precision: str, relation: str, by_precision: Mapping[str, float], by_relation: Mapping[str, float], coordinates: Column, bonus: float = 0.08) -> DataFrame:
    """Per case its places by score: precision and relation weights, and a bonus for coordinates; the best link counts; rank 1 is selected."""
    weight = lambda m, c: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), F.col(c)), F.lit(0.0))
    score = F.round(F.least(F.lit(1.0), weight(by_precision, precision) + weight(by_relation, relation) + F.when(coordinates, bonus).otherwise(0.0)), 4)
    best = links.groupBy(case, place).agg(F.max(score).alias("confidence"))
    rank = F.row_number().over(Window.partitionBy(case).orderBy(F.desc("confidence"), place))
    return best.withColumn("rank", rank).withColumn("is_selected", F.col("rank") == 1)


# What each sign adds to a case's scores, the scores of identity and separation, and the parts of its quality.
SUBJECT = {"subject": 0.62, "precise": 0.30, "issues": 0.08}
DISPUTE = {"explicit": 0.48, "harm": 0.30, "opposed": 0.22}
IDENTITY = {"known_place": 0.92, "has_project": 0.82, "episode_key": 0.46, "none": 0.35}
SEPARATION = {"shared": 0.38, "stable": 0.92, "documents": 0.48, "one": 0.68}
QUALITY = {"subject_score": 0.38, "dispute_score": 0.34, "identity_score": 0.16, "separation_score": 0.12}


def review_cases(cases: DataFrame) -> DataFrame:
    """cases with four scores, quality, decision and sorted reasons.

    Needs columns: subject, precise, issues, explicit, harm, support (numbers of hits), opposed (boolean), known_place, suspicious,
    has_project, episode_key (booleans), shared (shared trigger paragraphs), documents.
    """
    yes = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    added = lambda weights, ok: F.least(F.lit(1.0), reduce(lambda a, b: a + b, (F.when(ok(c), w).otherwise(0.0) for c, w in weights.items())))
    subject, dispute = added(SUBJECT, yes), added(DISPUTE, lambda c: F.col(c) if c == "opposed" else yes(c))
    stable = F.col("known_place") | F.col("has_project")
    identity = F.coalesce(*(F.when(F.col(c), w) for c, w in IDENTITY.items() if c != "none"), F.lit(IDENTITY["none"]))
    separation = F.when(yes("shared"), SEPARATION["shared"]).when(stable, SEPARATION["stable"]).when(F.col("documents") > 1, SEPARATION["documents"]).otherwise(SEPARATION["one"])
    doubts = F.array_compact(
        F.array(
            F.when(F.col("suspicious"), F.lit("SUSPICIOUS_PLACE_TOKEN")), F.when(yes("shared"), F.lit("SHARED_TRIGGER_PARAGRAPH")),
            F.when(~yes("shared") & ~stable & (F.col("documents") > 1), F.lit("MULTI_DOCUMENT_WEAK_IDENTITY")),
            F.when(~yes("shared") & ~stable & (F.col("documents") <= 1), F.lit("EPISODE_SCOPED_IDENTITY")),
        )
    )
    marked = yes("explicit") | yes("harm") | yes("precise")
    policy = yes("support") & ~yes("explicit") & ~yes("harm") & ~yes("precise")
    rows = cases.withColumns({"subject_score": subject, "dispute_score": dispute, "identity_score": identity, "separation_score": separation, "_doubts": doubts})
    decision = (
        F.when(F.col("subject_score") == 0, "rejected").when(policy, "rejected").when(F.size("_doubts") > 0, "needs_review").when(marked, "eligible").otherwise("needs_review")
    )
    rows = rows.withColumn("decision", decision)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("subject_score") == 0, F.lit("NO_EXACT_SUBJECT_TRIGGER")), F.when((F.col("subject_score") > 0) & policy, F.lit("POLICY_OR_SUPPORT_RECORD")),
            F.when(~marked & (F.col("decision") != "rejected"), F.lit("NO_EXPLICIT_DISPUTE_MARKER")),
        )
    )
    quality = reduce(lambda a, b: a + b, (w * F.col(c) for c, w in QUALITY.items()))
    return rows.withColumn("reason_codes", F.array_sort(F.array_distinct(F.concat("_doubts", reasons)))).withColumn("quality_score", F.round(quality, 4)).drop("_doubts")


def review_tasks(reviews: DataFrame, key: str, urgent: Sequence[str]) -> DataFrame:
    """A task for each reason of a case; urgent reasons come first."""
    tasks = reviews.select(key, F.explode("reason_codes").alias("reason_code"))
    return tasks.withColumn("priority", F.when(F.col("reason_code").isin(*urgent), "high").otherwise("normal"))
