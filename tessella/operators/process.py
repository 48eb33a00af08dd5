"""Process events in sentences, and timelines of cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import first_match, text_or_empty
from tessella.operators.vocabulary import with_patterns

# Outcomes in order of precedence as (pattern, outcome, certainty, event types or none for all).
OUTCOMES = (
    (r"반려|불허|부결|취소", "rejected", "confirmed", ()),
    (r"가결|승인|허가(?:를|가)?\s*(?:받|함|완료)|의결", "approved", "confirmed", ()),
    (r"보류|유보", "pending", "confirmed", ()),
    (r"재발|재민원|이후에도|다시", "recurred", "confirmed", ()),
    (r"완료|마쳤|시행했|진행했|실시했|확인했", "completed", "confirmed", ("administrative_response", "investigation_or_review", "resident_consultation", "mitigation_or_action")),
    (r"하기로|예정|검토하겠|추진하겠|요청했|요구했", "planned", "inferred", ()),
    ("", "reported", "confirmed", ("complaint_received", "inquiry_or_request")),
    ("", "observed", "confirmed", ()),
)
DATE = r"(20\d{2})\s*[년./-]\s*(\d{1,2})\s*[월./-]\s*(\d{1,2})"


def event_date(c: Column, fallback: Column, pattern: str = DATE) -> Column:
    """The first date in the text, else (also if it is none of the calendar) the fallback."""
    part = lambda i: F.regexp_extract(text_or_empty(c), pattern, i)
    found = F.try_to_date(F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))), "yyyy-MM-dd")
    return F.coalesce(found, fallback)


def outcome(event_type: Column, c: Column, outcomes: Sequence = OUTCOMES) -> Column:
    """(outcome, certainty) by precedence."""
    found = []
    for pattern, name, certainty, types in outcomes:
        ok = F.lit(True)
        if pattern:
            ok = ok & text_or_empty(c).rlike(pattern)
        if types:
            ok = ok & event_type.isin(*types)
        found.append(F.when(ok, F.struct(F.lit(name).alias("outcome"), F.lit(certainty).alias("certainty"))))
    return F.coalesce(*found)


def process_events(
    sentences: DataFrame, keys: Sequence[str], text_col: str, patterns: DataFrame, fallback_date: Column, actors: Sequence[tuple[str, str]] = (),
    speaker: Column | None = None, outcomes: Sequence = OUTCOMES, date_pattern: str = DATE,
) -> DataFrame:
    """keys, event_type, pattern, event_date, actor, outcome, certainty, confidence and the sentence as evidence.

    patterns (event_type, priority, pattern): the first pattern of a type that a sentence matches counts, and a type once for
    each different sentence text of the keys. A sentence is passed once for all patterns (vocabulary.with_patterns).
    """
    kept = sentences.select(*keys, F.col(text_col).alias("evidence_text"), fallback_date.alias("_fallback"), (F.lit(None).cast("string") if speaker is None else speaker).alias("_speaker")).distinct()
    hits = with_patterns(kept, "evidence_text", patterns)
    hits = hits.groupBy(*keys, "evidence_text", "_fallback", "_speaker", "event_type").agg(F.min_by("pattern", "priority").alias("pattern"))
    c = F.col("evidence_text")
    rows = hits.withColumn("_o", outcome(F.col("event_type"), c, outcomes))
    actor = first_match(c, [(label, code) for code, label in actors]) if actors else F.lit(None).cast("string")
    return rows.select(
        *keys, "event_type", "pattern", event_date(c, F.col("_fallback"), date_pattern).alias("event_date"), F.coalesce(actor, F.concat(F.lit("speaker:"), F.col("_speaker"))).alias("actor"),
        F.col("_o.outcome").alias("outcome"), F.col("_o.certainty").alias("certainty"), F.when(F.col("_o.outcome") == "planned", 0.72).otherwise(0.86).alias("confidence"), "evidence_text",
    )


def attach_to_cases(events: DataFrame, evidence: DataFrame, paragraph: str, origin: Column) -> DataFrame:
    """Events at the cases and episodes whose evidence holds their paragraph, with a stable id and the data's origin."""
    joined = evidence.hint("merge").join(events, paragraph)
    return joined.withColumn("data_origin", F.coalesce(F.when(origin, "synthetic"), F.lit("meeting_record")))


def timeline(events: DataFrame, case: str, date: str, tie: str) -> DataFrame:
    """Events of each case in order, those without a date first."""
    w = Window.partitionBy(case).orderBy(F.col(date).asc_nulls_first(), tie)
    return events.withColumn("position", F.row_number().over(w))


def last_events(events: DataFrame, case: str, date: str, tie: str, outcome_col: str, unresolved: Sequence[str]) -> DataFrame:
    """Per case: number of events, the last outcome, and how many events are unresolved."""
    return events.groupBy(case).agg(
        F.count("*").alias("events"), F.max_by(outcome_col, F.struct(date, tie)).alias("last_outcome"), F.count_if(F.col(outcome_col).isin(*unresolved)).alias("unresolved")
    )
