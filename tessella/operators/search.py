"""Ranked evidence for batches of requests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.text_index import TextIndex, index_hits, index_matches, passing_index
from tessella.sources.scratch import settled

#: Numbers of 62 bits for the terms of a request; requests with more terms are counted by sets.
MASKS = 8


def base_segments(segments: DataFrame, text_col: str, relevant: Column, date: str, from_date: Column | None = None) -> DataFrame:
    """Relevant or non-empty passages, from a date on if one is given (those without a date stay)."""
    rows = segments.filter(relevant | (F.coalesce(F.trim(text_col), F.lit("")) != ""))
    return rows if from_date is None else rows.filter(F.col(date).isNull() | (F.col(date) >= from_date))


def term_hits(segments: DataFrame, terms: DataFrame, key: str, text_col: str, index: TextIndex | None = None) -> DataFrame:
    """request_id, term, key: each passage whose lower-case text contains a request's term (request_id, term); once each.

    index: one over these passages or more; without one, they are indexed for this search alone. See text_index.index_matches.
    """
    if index is None:
        return index_hits(passing_index(segments, key, text_col), terms, segments, key, text_col)
    return index_hits(index, terms, segments, key, text_col).hint("merge").join(segments.select(key), key, "left_semi")


def shortlist(segments: DataFrame, terms: DataFrame, key: str, text_col: str, title_col: str, index: TextIndex | None = None) -> DataFrame:
    """request_id, key: passages whose text or title contains a term (request_id, term), each pair once. A token equal to a term is contained in the text too."""
    by_text = term_hits(segments, terms, key, text_col, index).select("request_id", key)
    titles = segments.select(key, title_col).filter(F.col(title_col).isNotNull())
    named = titles.select(F.col(title_col).alias("_title")).distinct()
    by_title = term_hits(named, terms, "_title", "_title").hint("merge").join(titles, F.col("_title") == F.col(title_col)).select("request_id", key)
    return by_text.unionByName(by_title).distinct()


def recency(date: Column, as_of: Column, days: int = 3650, least: float = 0.1) -> Column:
    """1 today, falling to `least` over `days`; `least` without a date."""
    age = F.greatest(F.lit(0), F.datediff(as_of, date))
    return F.when(date.isNull(), least).otherwise(F.greatest(F.lit(least), 1.0 - F.least(age, F.lit(days)) / days))


def keyword_score(hits: Column, terms: Column) -> Column:
    return F.least(F.lit(1.0), hits / F.greatest(F.lit(1), F.least(F.lit(3), terms)))


def hybrid_score(keyword: Column, spatial: Column, recent: Column, source: Column) -> Column:
    """0.38 keyword + 0.32 place + 0.20 recency + 0.10 source."""
    return 0.38 * keyword + 0.32 * spatial + 0.20 * recent + 0.10 * source


def issue_matches(requested: Column, labels: Column, text: Column, words: Column) -> Column:
    """Whether requested codes meet the labels and one of the issue's own words stands in the text; all pass if none is requested."""
    return (F.size(requested) == 0) | (F.arrays_overlap(requested, labels) & F.exists(words, lambda w: F.contains(text, w)))


def by_review_mode(segments: DataFrame, links: DataFrame, key: str, decision: str, mode: str) -> DataFrame:
    """Passages under a review mode: eligible, needs_review or all; those with only rejected cases drop out, unlinked ones stay in `all`."""
    states = links.groupBy(key).agg(F.count_if(F.col(decision) == "eligible").alias("_e"), F.count_if(F.col(decision) == "needs_review").alias("_n"), F.count("*").alias("_all"))
    rows = segments.join(states, key, "left")
    ok = {"eligible": F.col("_e") > 0, "needs_review": F.col("_n") > 0, "all": F.col("_all").isNull() | (F.col("_e") + F.col("_n") > 0)}[mode]
    return rows.filter(F.coalesce(ok, F.lit(False))).drop("_e", "_n", "_all")


def ranked(rows: DataFrame, request: str, order: Sequence[Column], limit: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(request).orderBy(*order))).filter(F.col("rank") <= limit)


def text_key(text: Column) -> Column:
    """What equal texts have in common: a hash of the text with blanks collapsed; null for an empty one."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(plain != "", F.md5(plain))


def diversified(rows: DataFrame, request: str, text: str, meeting: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """In rank order the first of equal texts (column text holds their text_key), then the first of each meeting, `limit` at most. Empty texts aren't compared."""
    rows = rows.withColumn("_t", F.row_number().over(Window.partitionBy(request, text).orderBy(*order)))
    rows = rows.filter((F.col("_t") == 1) | F.col(text).isNull())
    rows = rows.withColumn("_m", F.row_number().over(Window.partitionBy(request, *meeting).orderBy(*order))).filter("_m = 1")
    return ranked(rows.drop("_t", "_m"), request, order, limit)


def _scored(hits: DataFrame, passages: DataFrame, requests: DataFrame, key: str, date: str, as_of: Column, spatial: Column, source: Column) -> DataFrame:
    rows = hits.hint("merge").join(requests, "request_id").hint("merge").join(passages, key)  # passages last: they may bring texts
    score = hybrid_score(keyword_score(F.col("hits"), F.size("terms")), spatial, recency(F.col(date), as_of), source)
    return rows.withColumn("score", F.round(score, 6))


def _hits(requests: DataFrame, segments: DataFrame, key: str, text_col: str, index: TextIndex | None) -> DataFrame:
    """request_id, key, hits; of an index over more passages than these the others' too, which meet no passage later."""
    said = requests.select("request_id", F.explode("terms").alias("term")).groupBy("request_id").agg(F.sort_array(F.collect_set(F.lower("term"))).alias("terms"))
    said = settled(said, "search-terms")
    most = said.agg(F.max(F.size("terms"))).first()[0] or 0
    terms = said.select("request_id", F.posexplode("terms").alias("i", "term")).select(F.struct("request_id", "i").alias("request_id"), "term")
    found = index_matches(index or passing_index(segments, key, text_col), terms, segments, key, text_col).select("request_id.*", key)
    if most > 62 * MASKS:
        return found.groupBy("request_id", key).agg(F.size(F.collect_set("i")).cast("long").alias("hits"))  # a request's terms at most
    # A pair's terms are bits of numbers: those are added up in a hash table, sets of strings would be sorted.
    bit = F.expr("shiftleft(1L, i % 62)")
    masks = [F.coalesce(F.bit_count(F.bit_or(F.when(F.expr(f"i div 62 = {n}"), bit))), F.lit(0)) for n in range(max(1, -(-most // 62)))]
    return found.groupBy("request_id", key).agg(reduce(lambda x, y: x + y, masks).cast("long").alias("hits"))


def scored_passages(
    requests: DataFrame, segments: DataFrame, key: str, text_col: str, date: str, as_of: Column, spatial: Column, source: Column, eligible: Column | None = None, index: TextIndex | None = None,
) -> DataFrame:
    """requests x passages with a hit: the columns of both but the passage's text, text_key, hits, score.

    requests (request_id, terms array, any others). spatial, source and eligible are over columns of both, the text included;
    pairs that aren't eligible (issue, review, place) drop out. Nothing is compared that shares no term.
    """
    rows = _scored(_hits(requests, segments, key, text_col, index), segments.withColumn("text_key", text_key(F.col(text_col))), requests, key, date, as_of, spatial, source)
    return (rows if eligible is None else rows.filter(eligible)).drop(text_col)


def search(
    requests: DataFrame, segments: DataFrame, key: str, text_col: str, date: str, as_of: Column, meeting: Sequence[str], spatial: Column, source: Column, eligible: Column | None = None, limit: int = 10,
    index: TextIndex | None = None, ahead: int = 8,
) -> DataFrame:
    """request_id, key, hits, score, rank: the best of scored_passages for each request, diverse by text and meeting.

    The index gives the hits and so the scores of all pairs (spatial and source mustn't use the text). Texts are read for
    the first `ahead` * limit pairs of each request by score. Where these give `limit` results the request is done, as every
    other pair scores below them; for the other requests the texts of all pairs are read.
    """
    order = [F.desc("score"), F.col(key)]
    scores = _scored(_hits(requests, segments, key, text_col, index), segments.drop(text_col), requests, key, date, as_of, spatial, source)
    scores = settled(scores.select("request_id", key, "hits", "score"), "search-scores")

    def best(pairs: DataFrame) -> DataFrame:
        # A passage's key is made once, not for each request that finds it.
        passages = segments.join(pairs.select(key).distinct().hint("merge"), key, "left_semi").withColumn("text_key", text_key(F.col(text_col)))
        rows = pairs.hint("merge").join(requests, "request_id").hint("merge").join(passages, key)
        rows = rows if eligible is None else rows.filter(eligible)
        return diversified(rows, "request_id", "text_key", meeting, order, limit).select("request_id", key, "hits", "score", "rank")

    first = settled(ranked(scores, "request_id", order, ahead * limit).drop("rank"), "search-first")
    found = settled(best(first), "search-best")
    full = first.groupBy("request_id").agg(F.count("*").alias("_n")).filter(F.col("_n") == ahead * limit).select("request_id")
    few = full.join(found.groupBy("request_id").agg(F.count("*").alias("_k")).hint("merge"), "request_id", "left").filter(F.coalesce("_k", F.lit(0)) < limit)
    few = settled(few.select("request_id"), "search-few")
    if few.isEmpty():
        return found
    return found.join(few.hint("merge"), "request_id", "left_anti").unionByName(best(scores.join(few.hint("merge"), "request_id", "left_semi")))


def case_groups(results: DataFrame, request: str, case: str, episode: str, evidence: str) -> DataFrame:
    return results.groupBy(request, case).agg(F.count_distinct(episode).alias("episodes"), F.count_distinct(evidence).alias("evidence"))
