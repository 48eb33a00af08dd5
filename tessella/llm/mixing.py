"""Mixing sources to target weights by Pareto order sampling over whole documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD, blank_null, materialize
from tessella.operators.ranges import Stretches, running_rank

#: Cells of the rank histogram in which a source's cut is searched; only one cell's documents are then ordered.
CELLS = 65536
#: Sources beyond this number meet their documents in a merge join instead of a broadcast one.
MAX_BROADCAST_SOURCES = 50_000
#: Sources up to which they are ordered in one window; more are ordered by range partitions.
ONE_TASK = 100_000


def source_targets(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """One row per source: source_key, source_size, target, whole (certain copies), left (words still to sample).

    Sources in code-point order (null last) get the weights in turn and share all words by weight. No target exceeds
    max_repeat times its source's size: the excess goes to the others by weight until none is above. That fixed point
    is computed directly: ordered by size per weight, the capped sources are a prefix.
    """
    by_source = sized.groupBy("source_key").agg(
        F.sum("size").alias("source_size"), F.sum((F.col("size") * F.col("shortness")).cast("decimal(38,0)")).alias("short_words")
    )
    lcm = 1
    for w in weights:
        lcm *= w
    by_source = materialize(by_source, "mix-sources")
    few = by_source.count() <= ONE_TASK
    by_name = [F.col("source_key") == "n", F.col("source_key")]
    turned = by_source.withColumn("turn", F.row_number().over(Window.orderBy(*by_name))) if few else running_rank(by_source, by_name, "turn")
    weighted = turned.withColumn("turn", F.col("turn") - 1)
    pick = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        pick = F.when(F.col("turn") % len(weights) == i, w).otherwise(pick)
    weighted = weighted.withColumn("weight", pick.cast("long")).withColumn("most", max_repeat * F.col("source_size"))
    weighted = weighted.withColumn("level", F.col("source_size") * (F.lit(lcm) / F.col("weight")).cast("long"))
    if few:
        upto = Window.orderBy("level", "turn").rowsBetween(Window.unboundedPreceding, 0)
        levelled = weighted.withColumns({"most_upto": F.sum("most").over(upto), "weight_upto": F.sum("weight").over(upto)})
    else:
        levelled = Stretches(weighted.withColumn("all", F.lit(0)), "all", ["level", "turn"]).with_sum(F.col("most"), "most_upto").with_sum(F.col("weight"), "weight_upto").done().drop("all")
    sums = lambda rows, *columns: rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns)).first()
    total, all_weights = sums(weighted, "source_size", "weight")
    capped, open_weight = F.col("most_upto") - F.col("most"), F.lit(all_weights) - F.col("weight_upto") + F.col("weight")
    filled = materialize(levelled.withColumn("full", F.col("most") * open_weight <= F.col("weight") * (F.lit(total) - capped)), "mix-levels")
    taken, full_weights = sums(filled.filter("full"), "most", "weight")
    filled = filled.withColumns({"rest": F.lit(total - taken), "rest_weight": F.lit(all_weights - full_weights)})
    target = F.when(F.col("full"), (max_repeat * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * F.col("rest")).cast("double") / F.col("rest_weight").cast("double")
    )
    size = F.when(F.col("source_size") > 0, F.col("source_size").cast("double"))
    whole = F.coalesce(F.floor(F.col("target") / size), F.lit(0).cast("long"))
    return filled.withColumn("target", target).withColumn("whole", whole).select(
        "source_key", "source_size", "target", "whole",
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"),
        (F.col("short_words").cast("double") / size).alias("mean_shortness"),
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, seed: str = "mix", short_words: int = 1024,
) -> DataFrame:
    """docs with added columns mix_size, mix_source_size, mix_target, mix_copies; no row is lost.

    Size: the text's words (null: 0). Each source's target is that of source_targets. A target of r times its source's
    size takes floor(r) certain whole copies of every document; the fractional rest f is sampled. A document's inclusion
    chance for the rest is f, tilted so that shorter documents are likelier (less variance from giants), with the
    source's expected words unchanged. Documents are ranked by random odds over inclusion odds (Pareto order), the random
    number being a hash of seed and id, and taken in rank order up to the rest of the target, the last one if that comes
    nearer. So reruns agree, a source's words miss its target by half a document at most, and none repeats above
    max_repeat times.

    The cut is found by a histogram of ranks and an ordering of the one cell that it falls in, then applied row by row:
    texts are never shuffled. Rows that repeat an id, source and size are taken together. A null id is hashed as a
    marker; a null source is a source of its own, last. Sources without words get target 0. An empty table stays empty.
    Columns of docs may have any names except the four added ones.
    """
    sized = materialize(docs.select(*(c.alias(n) for n, c in _keys(id_col, text_col, source_col, seed, short_words).items())), "mix-sizes")
    sources = materialize(source_targets(sized, weights, max_repeat), "mix-sources")
    small = sources.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    cuts = materialize(_cuts(sized, sources, small), "mix-cuts")
    plan = sources.join(F.broadcast(cuts) if small else cuts.hint("merge"), "source_key", "left")

    keyed = docs.select("*", *(c.alias(f"__mix_{n}") for n, c in _keys(id_col, text_col, source_col, seed, short_words).items()))
    plan = plan.select(*(F.col(c).alias(f"__plan_{c}") for c in plan.columns))
    joined = keyed.join(F.broadcast(plan) if small else plan.hint("merge"), F.col("__mix_source_key") == F.col("__plan_source_key"))
    joined = joined.withColumn("__mix_rank", _rank("__mix_draw", "__mix_shortness", "__plan_"))
    cell, cut = _cell(F.col("__mix_rank")), F.col("__plan_cut_cell")
    at_cut = F.struct(F.col("__mix_rank").alias("rank"), F.col("__mix_mark").alias("mark"), F.col("__mix_size").alias("size")) <= F.col("__plan_cut_row")
    taken = F.coalesce((cell < cut) | ((cell == cut) & at_cut), F.lit(False))
    return joined.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.col("__mix_size").alias("mix_size"), F.col("__plan_source_size").alias("mix_source_size"), F.col("__plan_target").alias("mix_target"),
        (F.col("__plan_whole") + taken.cast("long")).alias("mix_copies"),
    )


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as mix_sources takes them, with the columns of docs."""
    mixed = mix_sources(docs, **options).filter("mix_copies > 0")
    repeated = mixed.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))


def _keys(id_col: str, text_col: str, source_col: str, seed: str, short_words: int) -> dict[str, Column]:
    """size: words. shortness: 10000 for an empty text, 5000 at short_words words, towards 0. draw: 52 random bits."""
    size = F.regexp_count(blank_null(F.col(text_col)), F.lit(WORD)).cast("long")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return {
        "size": size,
        "shortness": F.floor(F.lit(10000 * short_words) / (F.lit(short_words) + size)).cast("long"),
        "draw": F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"),
        "mark": F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        "source_key": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")),
    }


def _rank(draw: str, shortness: str, plan: str = "") -> Column:
    """Random odds over inclusion odds; null where nothing is left to sample. In (0, 1) as a share, which keeps the order."""
    f = F.col(f"{plan}left") / F.when(F.col(f"{plan}source_size") > 0, F.col(f"{plan}source_size").cast("double"))
    tilt = F.least(f, 1.0 - f) * 0.5
    chance = f + tilt * ((F.col(shortness) - F.col(f"{plan}mean_shortness")) / 10000.0)
    u = (F.col(draw) + 0.5) / float(2**52)
    return F.when(F.col(f"{plan}left") > 0, u * (1.0 - chance) / (u * (1.0 - chance) + (1.0 - u) * chance))


def _cell(rank: Column) -> Column:
    return F.floor(rank * CELLS)


def _cuts(sized: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """Per source: the histogram cell in which its sample ends, and the last row taken there (null if none is)."""
    ranked = sized.join(F.broadcast(sources) if small else sources.hint("merge"), "source_key").withColumn("rank", _rank("draw", "shortness"))
    ranked = ranked.filter("rank IS NOT NULL").withColumn("cell", _cell(F.col("rank")))
    cells = ranked.groupBy("source_key", "cell").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    before = F.sum("words").over(Window.partitionBy("source_key").orderBy("cell")) - F.col("words")
    ends = cells.withColumn("before", before).filter("before + words >= left")
    ends = ends.groupBy("source_key").agg(F.min("cell").alias("cut_cell"), F.min_by("before", "cell").alias("before"))
    ends = materialize(ends, "mix-ends")
    inside = ranked.join(F.broadcast(ends) if small else ends.hint("merge"), "source_key").filter("cell = cut_cell")
    units = inside.groupBy("source_key", "cut_cell", "rank", "mark", "size").agg(
        F.sum("size").alias("words"), F.first("left").alias("left"), F.first("before").alias("before")
    )
    upto = F.sum("words").over(Window.partitionBy("source_key").orderBy("rank", "mark", "size"))
    fits = F.col("before") + F.col("upto") - F.col("words") / 2.0 <= F.col("left")
    return units.withColumn("upto", upto).groupBy("source_key", "cut_cell").agg(F.max(F.when(fits, F.struct("rank", "mark", "size"))).alias("cut_row"))
