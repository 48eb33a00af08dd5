"""Episodes: consecutive signals of a document that belong together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ranges import Stretches, by_key_size

# Weights of what two neighbouring signals have in common, the widest gap, and the score that joins them.
WEIGHTS = {"document": 0.25, "agenda": 0.20, "issue": 0.15, "entity": 0.30, "near": 0.10, "close": 0.05}
NEAR, CLOSE, JOINED = 2, 5, 0.55
#: Rows up to which a document is one window of one task.
WHOLE = 1_000_000


def break_counts(paragraphs: DataFrame, doc_col: str, order_col: str, is_break: Column, most: int = WHOLE) -> DataFrame:
    """paragraphs with breaks_upto: breaks in the document up to and with this paragraph.

    Two paragraphs have a break between them, right one included, where their counts differ. Documents of more than `most`
    paragraphs are counted over many tasks.
    """
    w = Window.partitionBy(doc_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    value = is_break.cast("int")
    usual, large = by_key_size(paragraphs, doc_col, most)
    out = usual.withColumn("breaks_upto", F.sum(value).over(w))
    return out if large is None else out.unionByName(Stretches(large, doc_col, [order_col]).with_sum(value, "breaks_upto").done())


def episodes(
    signals: DataFrame, doc_col: str, order: Sequence[str], paragraph_col: str, agenda: Column, issues: Column, entities: Column,
    breaks_upto: Column | None = None, sentence_breaks: Column | None = None, weights: dict[str, float] = WEIGHTS, joined: float = JOINED, most: int = WHOLE,
) -> DataFrame:
    """signals with link_score (to the one before) and episode (number in the document, from 1).

    A signal continues the episode if its score with the previous signal is at least `joined`; breaks and gaps above
    CLOSE score 0. issues and entities are arrays. A document of more than `most` signals is cut over many tasks
    (ranges.Stretches), the others are windows.
    """
    zero = F.lit(0)
    rows = signals.withColumns({"_agenda": agenda, "_issues": issues, "_entities": entities, "_breaks": zero if breaks_upto is None else breaks_upto, "_cut": F.lit(False) if sentence_breaks is None else sentence_breaks, "_paragraph": F.col(paragraph_col)})
    compared = ["_agenda", "_issues", "_entities", "_breaks", "_paragraph"]

    def scored(part: DataFrame) -> DataFrame:
        gap = F.col("_paragraph") - F.col("previous__paragraph")
        both = lambda c: F.coalesce(F.arrays_overlap(c, f"previous_{c}"), F.lit(False))
        weight = lambda ok, k: F.when(ok, weights[k]).otherwise(0.0)
        score = F.lit(weights["document"]) + weight(F.col("_agenda").eqNullSafe(F.col("previous__agenda")), "agenda") + weight(both("_issues"), "issue") + weight(both("_entities"), "entity")
        score = score + F.when(gap <= NEAR, weights["near"]).otherwise(weights["close"])
        cut = (gap > CLOSE) | (F.col("_breaks") != F.col("previous__breaks")) | F.col("_cut")
        return part.withColumn("link_score", F.when(gap.isNull(), None).when(cut, 0.0).otherwise(F.round(score, 2)))

    w = Window.partitionBy(doc_col).orderBy(*order)
    new = F.when(F.coalesce(F.col("link_score") < joined, F.lit(True)), 1).otherwise(0)
    kept = [*signals.columns, "link_score", "episode"]
    usual, large = by_key_size(rows, doc_col, most)
    out = scored(usual.select("*", *(F.lag(c).over(w).alias(f"previous_{c}") for c in compared)))
    out = out.withColumn("_new", new).withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(*kept)
    if large is None:
        return out
    stretches = Stretches(large, doc_col, order).with_previous(compared)
    return out.unionByName(stretches.apply(scored).with_sum(new, "episode").done().select(*kept))


def stance(polarities: Column) -> Column:
    """Of an array of polarities: mixed if both sides speak, else the side, else neutral."""
    against = F.array_contains(polarities, "opposition") | F.array_contains(polarities, "mixed")
    favour = F.array_contains(polarities, "support") | F.array_contains(polarities, "mixed")
    return F.when(against & favour, "mixed").when(against, "opposition").when(favour, "support").when(F.size(polarities) > 0, "neutral").otherwise("unknown")


def episode_summaries(signals: DataFrame, doc_col: str, paragraph_col: str, issue_col: str, polarity_col: str, entity_col: str) -> DataFrame:
    """One row per (document, episode): bounds, sorted issues and entities, stance, weakest link, signals, confidence.

    Confidence: 0.66, plus 0.12 with an entity, 0.10 with two signals, 0.05 with two issues.
    """
    grouped = signals.groupBy(doc_col, "episode").agg(
        F.min(paragraph_col).alias("paragraph_start"), F.max(paragraph_col).alias("paragraph_end"), F.array_sort(F.collect_set(issue_col)).alias("issue_types"),
        F.array_sort(F.collect_set(entity_col)).alias("entity_keys"), F.collect_set(polarity_col).alias("_polarities"), F.min("link_score").alias("weakest_link"), F.count("*").alias("signals"),
    )
    sure = F.lit(0.66) + F.when(F.size("entity_keys") > 0, 0.12).otherwise(0.0) + F.when(F.col("signals") > 1, 0.10).otherwise(0.0) + F.when(F.size("issue_types") > 1, 0.05).otherwise(0.0)
    return grouped.withColumn("stance", stance(F.col("_polarities"))).withColumn("confidence", F.round(sure, 2)).drop("_polarities")


def stages_and_categories(signals: DataFrame, doc_col: str, text_col: str, issue_col: str, categories: Mapping[str, str], stages: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Per (document, episode): procedure_stage, the first stage that any signal's text has a term of, and the sorted categories of its issues."""
    rank = F.coalesce(*(F.when(F.greatest(*(F.contains(F.coalesce(text_col, F.lit("")), F.lit(t)) for t in terms), F.lit(False)), i) for i, (_, terms) in enumerate(stages)))
    category = F.coalesce(*(F.when(F.col(issue_col) == k, F.lit(v)) for k, v in categories.items()))
    rows = signals.groupBy(doc_col, "episode").agg(F.min(rank).alias("_stage"), F.array_sort(F.collect_set(category)).alias("categories"))
    return rows.withColumn("procedure_stage", F.get(F.array(*(F.lit(name) for name, _ in stages)), F.col("_stage"))).drop("_stage")


def with_fallback_signals(signals: DataFrame, labelled: DataFrame, sentences: DataFrame, key: str, order_col: str) -> DataFrame:
    """signals and, for labelled paragraphs without one, their first sentence (origin: signal or label)."""
    missing = labelled.select(key).distinct().join(signals.select(key).distinct(), key, "left_anti")
    first = F.row_number().over(Window.partitionBy(key).orderBy(order_col))
    extra = sentences.hint("merge").join(missing, key, "left_semi").withColumn("_n", first).filter("_n = 1").drop("_n")
    return signals.withColumn("origin", F.lit("signal")).unionByName(extra.withColumn("origin", F.lit("label")), allowMissingColumns=True)


def context_paragraphs(ranges: DataFrame, paragraphs: DataFrame, doc_col: str, index_col: str, start_col: str, end_col: str, margin: int = 1) -> DataFrame:
    """Each range with the paragraphs from `margin` before to `margin` after it: an equi-join on exploded indexes."""
    wanted = ranges.withColumn(index_col, F.explode(F.sequence(F.col(start_col) - margin, F.col(end_col) + margin)))
    return wanted.hint("merge").join(paragraphs, [doc_col, index_col]).withColumn("role", F.when(F.col(index_col).between(F.col(start_col), F.col(end_col)), "core").otherwise("context"))
