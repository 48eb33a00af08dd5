"""Evidence packs: issue counts, reason cards, conclusions, conversations, and an audit of generated answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ranges import dealt_by, dealt_join

#: Fixed value: a number in prose.
NUMBER = r"\d[\d,]*(?:\.\d+)?"


def evidence_structs(results: DataFrame, request: str, fields: Sequence[str], order: str) -> DataFrame:
    """Per request its evidence in order, and the ids that an answer may cite (the first field)."""
    packed = F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order])))
    return results.groupBy(request).agg(packed.alias("evidence"), F.array_sort(F.collect_set(F.col(fields[0]).cast("string"))).alias("evidence_ids"))


def issue_counts(results: DataFrame, detected: DataFrame, request: str, code: str) -> DataFrame:
    """Results per request and code; detected codes without a result count 1."""
    counted = results.groupBy(request, code).agg(F.count("*").alias("n"))
    return counted.unionByName(detected.select(request, code, F.lit(1).cast("long").alias("n"))).groupBy(request, code).agg(F.max("n").alias("n"))


def issue_order(counts: DataFrame, request: str, code: str, priority: Mapping[str, int]) -> DataFrame:
    """Issues of a request by priority, then count, then code."""
    p = F.coalesce(*(F.when(F.col(code) == k, v) for k, v in priority.items()), F.lit(99))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(request).orderBy(p, F.desc("n"), code)))


def reason_cards(rules: DataFrame, issues: DataFrame, events: DataFrame, permits: DataFrame, request: str) -> DataFrame:
    """request, category, title, assertion, severity: cards of failed and open rules, repeated issues (two or more), unresolved
    events, and permits nearby (three or more). Inputs: rules (name, status, severity), issues (code, n), events (last_outcome,
    unresolved), permits (permits)."""
    card = lambda df, category, title, assertion, severity: df.select(request, F.lit(category).alias("category"), title.cast("string").alias("title"), assertion.alias("assertion"), severity.alias("severity"))
    parts = [
        card(rules.filter("status IN ('fail', 'check_required')"), "rule", F.col("name"), F.when(F.col("status") == "fail", "fact").otherwise("unknown"), F.col("severity")),
        card(issues, "issue", F.col("code"), F.when(F.col("n") >= 2, "repeated").otherwise("single"), F.when(F.col("n") >= 2, "warning").otherwise("info")),
        card(events.filter("unresolved > 0"), "process", F.col("last_outcome"), F.lit("fact"), F.lit("warning")),
        card(permits.filter("permits >= 3"), "permit", F.lit("permits_nearby"), F.lit("fact"), F.lit("info")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def conclusion(failed: Column, severe_repeated: Column, events: Column, unknown: Column, results: Column) -> Column:
    """By precedence: any failed rule, a repeated severe issue or process events, open rules or no results."""
    return (
        F.when(failed > 0, "review_required").when(severe_repeated | (events > 0), "conditional_review").when((unknown > 0) | (results == 0), "insufficient_evidence").otherwise("no_material_risk_found")
    )


def location_context(rows: DataFrame, targets: DataFrame, key: str, area: str, score: str, name: str, others: int = 3, limit: int = 8) -> DataFrame:
    """Per target the rows of its own area and the best `others` of the rest, `limit` at most, own ones first."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(area).orderBy(F.desc(score), name)))
    best = ranked.filter(F.col("_n") <= others).orderBy(F.desc(score), name, area).limit(2 * others).drop("_n")
    columns = [key, area, name, score]
    own = targets.join(ranked.filter(F.col("_n") <= limit), area).select(*columns, F.lit(True).alias("is_own"))
    rest = targets.withColumnRenamed(area, "_own").join(F.broadcast(best), F.col(area) != F.col("_own")).select(*columns, F.lit(False).alias("is_own"))
    rest = rest.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), name, area))).filter(F.col("_n") <= others).drop("_n")
    w = Window.partitionBy(key).orderBy(F.desc("is_own"), F.desc(score), name, area)
    return own.unionByName(rest).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def audit_answers(answers: DataFrame, key: str, prose: str, cited: str, allowed_ids: str, facts: str, observations: str | None = None) -> DataFrame:
    """key, unknown_citations, unverified_numbers, digits_in_observations, grounded.

    cited and allowed_ids are arrays of ids; facts an array of texts and numbers as text, whose numbers the prose may quote,
    with or without thousands commas, rounded to 0 to 2 digits, or as percent. Ids and links among the facts allow nothing.
    """
    is_id = lambda f: f.rlike(r"^(?=.*[A-Za-z])(?=.*\d)[A-Za-z0-9_.:\-]{8,}$") | f.contains("://")
    plain = F.flatten(F.transform(F.filter(facts, lambda f: ~is_id(f)), lambda f: F.regexp_extract_all(f, F.lit(NUMBER), F.lit(0))))
    values = F.transform(plain, lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("double"))
    forms = lambda v: F.array(F.format_number(v, 0), F.format_number(v, 1), F.format_number(v, 2), F.format_number(v * 100, 0), F.format_number(v * 100, 1))
    allowed = F.array_distinct(F.transform(F.concat(plain, F.flatten(F.transform(values, forms))), lambda n: F.replace(n, F.lit(","), F.lit(""))))
    said = F.regexp_extract_all(F.coalesce(prose, F.lit("")), F.lit(NUMBER), F.lit(0))
    unverified = F.filter(F.array_distinct(said), lambda n: ~F.array_contains(F.col("_allowed"), F.replace(n, F.lit(","), F.lit(""))))
    digits = F.lit(False) if observations is None else F.coalesce(F.exists(observations, lambda o: o.rlike(r"\d")), F.lit(False))
    rows = answers.withColumn("_allowed", allowed)
    rows = rows.select(key, F.array_sort(F.array_except(cited, allowed_ids)).alias("unknown_citations"), F.array_sort(unverified).alias("unverified_numbers"), digits.alias("digits_in_observations"))
    return rows.withColumn("grounded", (F.size("unknown_citations") == 0) & (F.size("unverified_numbers") == 0) & ~F.col("digits_in_observations"))


def compacted(items: DataFrame, key: str, order: Sequence[Column], text: str, limit: int, longest: int) -> DataFrame:
    """The first `limit` items per key, their texts cut to `longest` characters."""
    w = Window.partitionBy(key).orderBy(*order)
    return items.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).withColumn(text, F.substring(text, 1, longest))


#: Parts of a prompt, the most items of each, and the longest quote.
PROMPT_PARTS = {"reason": 5, "quote": 1, "timeline": 6, "permit": 3}
QUOTE = 220


def prompt_pack(reasons: DataFrame, quotes: DataFrame, timeline: DataFrame, permits: DataFrame, key: str, reason: str, limits: Mapping[str, int] = PROMPT_PARTS, longest: int = QUOTE) -> DataFrame:
    """key, part, reason, rank, text: what a prompt may hold of each part.

    All tables have key, place (their order) and text; reasons and quotes also have `reason`. The first reasons of a key, the
    first quotes of each of those (cut to `longest` characters), the first timeline entries and permits. Tables are dealt by
    their counted rows before they are ordered.
    """
    def first(rows: DataFrame, part: str, within: Sequence[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*within).orderBy("place", "text"))
        return dealt_by(rows, within).withColumn("rank", rank).filter(F.col("rank") <= limits[part]).withColumn("part", F.lit(part))

    kept = first(reasons, "reason", [key])
    # Quotes are cut before they are ordered, which gives the same ones: of texts alike up to there either will do.
    cut = quotes.withColumn("text", F.substring("text", 1, longest))
    rank = F.row_number().over(Window.partitionBy(key, reason).orderBy("place", "text"))
    quoted = dealt_join(cut, kept.select(key, reason).distinct(), [key, reason], "left_semi").withColumn("rank", rank).filter(F.col("rank") <= limits["quote"]).withColumn("part", F.lit("quote"))
    parts = [kept, quoted, first(timeline, "timeline", [key]), first(permits, "permit", [key])]
    out = None
    for p in (part.drop("place") for part in parts):
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out.select(key, "part", reason, "rank", "text")


def evidence_links(packs: DataFrame, key: str, evidence: str) -> DataFrame:
    """A row for each piece of evidence of a complaint with its first rank."""
    return packs.select(key, F.posexplode(evidence).alias("i", "evidence_id")).groupBy(key, "evidence_id").agg((F.min("i") + 1).alias("rank"))


def conversations(messages: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Messages of each conversation in order, and how many."""
    return messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("messages"), F.count("*").alias("n"))


def last_turns(messages: DataFrame, key: str, order: str, role: str, text: str, roles: Sequence[str] = ("user", "assistant"), limit: int = 6, longest: int = 500) -> DataFrame:
    """The last `limit` turns of the roles per conversation, cut to `longest` characters, in order."""
    rows = messages.filter(F.col(role).isin(*roles))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("_n") <= limit)
    turns = F.array_sort(F.collect_list(F.struct(order, role, F.substring(text, 1, longest).alias("text"))))
    return rows.groupBy(key).agg(turns.alias("turns"))
