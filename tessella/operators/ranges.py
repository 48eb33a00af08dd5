"""Ordered work without one task for all rows or for one key: ranks, running sums, neighbours, order statistics, hot joins."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.scratch import settled

#: Rows of a side of one join unit, rows up to which a table is broadcast (it is counted first), parts of a range of values.
UNIT, SMALL, PARTS = 20_000, 100_000, 4096
#: Pairs of a join for which there is one partition at least.
PAIRS = 20_000_000
#: Rows of a task that sorts them for a join or a window.
TASK_ROWS = 250_000


def small_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a written table: broadcast where a count proves it small, a merge join beyond that."""
    return left.join(F.broadcast(right) if right.count() <= SMALL else right.hint("merge"), list(on), how)


def dealt_by(rows: DataFrame, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """rows dealt by keys to n partitions: as many as their counted rows call for, so that a task's rows don't grow with the table's."""
    return rows.repartition(n or max(1, -(-rows.count() // TASK_ROWS)), *keys)


def dealt_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Merge join of tables dealt by their counted rows; the result is dealt by `on` too."""
    n = max(1, -(-(left.count() + right.count()) // TASK_ROWS))
    return dealt_by(left, on, n).hint("merge").join(dealt_by(right, on, n), list(on), how)


def unit_join(left: DataFrame, right: DataFrame, on: Sequence[str], unit: int = UNIT, size: str | None = None) -> DataFrame:
    """Inner equi-join in which no task's unit has more than about `unit` rows of a side, however many rows share a key.

    Rows of a key with more are dealt into parts by the hash of their columns; each pair of parts is a unit, so a row goes to
    as many units as the other side has parts. Keys that aren't hot are joined as they stand. Units are dealt to as many
    partitions as the counted pairs call for: pairs may be very many where rows, by which Spark sizes its tasks, are few.
    size: a column of left with the number of rows that a row stands for.
    """
    on = list(on)
    left, right = left.dropna(subset=on), right.dropna(subset=on)
    counts = lambda df, name, n: df.groupBy(*on).agg(n.cast("bigint").alias(name))
    of = lambda name: F.coalesce(name, F.lit(0).cast("bigint")).alias(name)
    sizes = settled(counts(left, "_l", F.sum(size) if size else F.count("*")).join(counts(right, "_r", F.count("*")).hint("merge"), on, "full").select(*on, of("_l"), of("_r")), "unit-sizes")
    parts = lambda name: F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col(name) / unit))
    known = sizes.agg(F.sum(F.col("_l").cast("double") * F.col("_r")).alias("pairs"), F.sum(parts("_l") * parts("_r")).alias("units")).first()
    n = int(min(-(-(known["pairs"] or 0) // PAIRS), 2 * (known["units"] or 0)))
    hot = sizes.filter((F.col("_l") > unit) | (F.col("_r") > unit)).select(*on, parts("_l").alias("_lefts"), parts("_r").alias("_rights"))
    keys = on
    if not hot.isEmpty():
        hot, one = settled(hot, "unit-keys"), F.lit(1).cast("bigint")

        def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
            rows = small_join(df, hot, on, "left").withColumns({c: F.coalesce(c, one) for c in ("_lefts", "_rights")})
            return rows.withColumn(mine, F.pmod(F.xxhash64(*df.columns), own)).withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))).drop("_lefts", "_rights")

        left, right, keys = dealt(left, "_lefts", "_rights", "_i", "_j"), dealt(right, "_rights", "_lefts", "_j", "_i"), [*on, "_i", "_j"]
    if n > 1:
        n = max(n, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        left, right = left.repartition(n, *keys), right.repartition(n, *keys)
    return left.hint("merge").join(right, keys).drop("_i", "_j")


def range_sorted(rows: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """rows, written in the order given over range partitions: with _part, the partition, and _at, the place in it from 0.

    Rows that are equal in the order share a partition, so the order should tell rows apart.
    """
    at = F.monotonically_increasing_id()
    made = settled(rows, name).repartitionByRange(*order).sortWithinPartitions(*order)
    return settled(made.withColumn("_part", F.shiftright(at, 33).cast("int")).withColumn("_at", at.bitwiseAND((1 << 33) - 1)), name)


def running_rank(rows: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """rows with their rank from 1 in an order of all rows: range sort, totals of partitions, offsets. order should be total.

    Only the partitions' totals, one row each, meet in one task.
    """
    made = range_sorted(rows, order, "ranks")
    totals = made.groupBy("_part").agg((F.max("_at") + 1).alias("_n"))
    upto = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = made.join(F.broadcast(totals.select("_part", upto.alias("_before"))), "_part")
    return ranked.withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


class Stretches:
    """Rows in order of a key and within it, cut into range partitions: a key with many rows spreads over many.

    Neighbours and running sums are found within a partition; what a partition's first key needs from the partitions before
    comes from summaries, one row or two for each partition.
    """

    def __init__(self, rows: DataFrame, key: str, order: Sequence[str]) -> None:
        self.key, self.order, self.columns = key, list(order), rows.columns
        self.rows = range_sorted(rows, [key, *order], "stretches")
        self._own = Window.partitionBy("_part", key).orderBy("_at")

    def _with_carry(self, rows: DataFrame, carry: DataFrame) -> DataFrame:
        """carry: _part, _key, and columns for the rows of that key in that partition; as many rows as partitions."""
        on = (F.col("_part") == F.col("_carry_part")) & F.col(self.key).eqNullSafe(F.col("_carry_key"))
        return rows.join(F.broadcast(carry.withColumnsRenamed({"_part": "_carry_part", "_key": "_carry_key"})), on, "left").drop("_carry_part", "_carry_key")

    def with_previous(self, columns: Sequence[str]) -> Stretches:
        """Adds previous_<c>: the column of the row before, null at the first row of a key; and has_previous."""
        said = F.struct(*(F.col(c) for c in columns))
        edges = self.rows.groupBy("_part").agg(F.min_by(self.key, "_at").alias("_key"), F.max_by(F.struct(F.col(self.key).alias("k"), said.alias("s")), "_at").alias("_last"))
        before = F.lag("_last").over(Window.orderBy("_part"))
        carry = edges.withColumn("_before", before).filter(F.col("_before.k").eqNullSafe(F.col("_key")) & F.col("_before").isNotNull()).select("_part", "_key", F.col("_before.s").alias("_carried"))
        rows = self._with_carry(self.rows.withColumn("_lag", F.lag(said).over(self._own)), carry)
        rows = rows.withColumn("_lag", F.coalesce("_lag", "_carried")).withColumn("has_previous", F.col("_lag").isNotNull())
        return self._next(rows.select("*", *(F.col(f"_lag.{c}").alias(f"previous_{c}") for c in columns)).drop("_lag", "_carried"))

    def with_sum(self, value: Column, name: str) -> Stretches:
        """Adds the sum of a value over the key's rows up to and with this one."""
        rows = self.rows.withColumn("_value", value)
        firsts = rows.groupBy("_part").agg(F.min_by(self.key, "_at").alias("_key"))
        spread = firsts.select("_key").distinct()
        sums = rows.join(F.broadcast(spread), F.col(self.key).eqNullSafe(F.col("_key"))).groupBy("_part", "_key").agg(F.sum("_value").alias("_sum"))
        upto = F.sum("_sum").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        rows = self._with_carry(rows, sums.select("_part", "_key", upto.alias("_carried")))
        local = F.sum("_value").over(self._own.rowsBetween(Window.unboundedPreceding, 0))
        return self._next(rows.withColumn(name, local + F.coalesce("_carried", F.lit(0))).drop("_value", "_carried"))

    def apply(self, f: Callable[[DataFrame], DataFrame]) -> Stretches:
        """The rows after a function that adds columns to each row."""
        return self._next(f(self.rows))

    def _next(self, rows: DataFrame) -> Stretches:
        out = object.__new__(Stretches)
        out.key, out.order, out.rows, out._own = self.key, self.order, rows, self._own
        out.columns = rows.columns
        return out

    def done(self) -> DataFrame:
        return self.rows.drop("_part", "_at")


def by_key_size(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """rows of keys with up to `most` rows, and those of larger ones (None if there are none)."""
    large = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(F.col(key).alias("_large"))
    if large.isEmpty():
        return rows, None
    large = settled(large, "large-keys")
    side = F.broadcast(large) if large.count() <= SMALL else large.hint("merge")
    on = F.col(key).eqNullSafe(F.col("_large"))
    return rows.join(side, on, "left_anti"), rows.join(side, on, "left_semi")


def nearest_ranks(values: DataFrame, keys: Sequence[str], value: str, n: str, fractions: Mapping[str, float], parts: int = PARTS) -> DataFrame:
    """keys, sample_size and a column for each fraction: the value at rank bround(f * (size - 1)) + 1 of each key's values.

    values: keys, value, n (how often it occurs), each value once. Keys with up to `parts` different values are ordered in
    a window. For others each wanted rank is narrowed in rounds: the range of values that holds it is cut into `parts` parts,
    whose counts tell the part with the rank, until a part has one value. So no task ever orders more than `parts` rows of a key.
    """
    keys, values = list(keys), settled(values, "ranked-values")
    sizes = settled(values.groupBy(*keys).agg(F.sum(n).alias("sample_size"), F.count("*").alias("_different"), F.min(value).alias("_low"), F.max(value).alias("_high")), "ranked-sizes")
    wanted = F.array(*(F.struct(F.lit(k).alias("fraction"), (F.bround(F.lit(f) * (F.col("sample_size") - 1)) + 1).alias("rank")) for k, f in fractions.items()))
    few, many = sizes.filter(F.col("_different") <= parts), sizes.filter(F.col("_different") > parts)
    some = small_join(values, few.select(*keys, "sample_size"), keys)
    upto = F.sum(n).over(Window.partitionBy(*keys).orderBy(value))
    placed = some.withColumn("_upto", upto).withColumn("_w", F.explode(wanted)).filter((F.col("_upto") >= F.col("_w.rank")) & (F.col("_upto") - F.col(n) < F.col("_w.rank")))
    found = placed.select(*keys, "sample_size", F.col("_w.fraction").alias("fraction"), F.col(value).alias("_found"))
    left = settled(many.withColumn("_w", F.explode(wanted)).select(*keys, "sample_size", "_w.*", "_low", "_high"), "ranked-left")
    while not left.isEmpty():
        inside = small_join(values, left, keys).filter(F.col(value).between(F.col("_low"), F.col("_high")))
        part = F.least(F.floor((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")) * parts), F.lit(parts - 1))
        cut = inside.groupBy(*keys, "sample_size", "fraction", "rank", part.alias("_part")).agg(F.sum(n).alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"))
        running = F.sum("_n").over(Window.partitionBy(*keys, "fraction").orderBy("_part"))
        cut = cut.withColumn("_upto", running).filter((F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("_n") < F.col("rank")))
        cut = settled(cut.select(*keys, "sample_size", "fraction", (F.col("rank") - F.col("_upto") + F.col("_n")).alias("rank"), "_low", "_high"), "ranked-left")
        found = found.unionByName(cut.filter("_low = _high").select(*keys, "sample_size", "fraction", F.col("_low").alias("_found")))
        left = cut.filter("_low < _high")
    return found.groupBy(*keys, "sample_size").agg(*(F.max(F.when(F.col("fraction") == k, F.col("_found"))).alias(k) for k in fractions))


def divided_seats(groups: DataFrame, name: str, size: str, target: int) -> DataFrame:
    """name, size, seats: one for each group of a positive size, the rest to the greatest size / (seats + 1), then the most left, then the last name, in turn.

    Never more seats than a group's size, or than there are in all. With fewer seats than groups the first by name get one.

    Seat k of a group of n has the quotient n / k. With G groups of S in all and R seats to win, the last quotient that wins
    one lies between S / (R + 2 G) and S / R: above that all win, and between them are 4 G quotients at most, which are ranked.
    """
    counted = groups.select(name, size).filter(F.col(size) > 0)
    known = counted.agg(F.count("*").alias("groups"), F.coalesce(F.sum(size), F.lit(0)).alias("all")).first()
    g, s = known["groups"], known["all"]
    rest = min(target, s) - g
    one = F.lit(1).cast("bigint")
    if rest <= 0:
        return running_rank(counted, [name], "_rank").filter(F.col("_rank") <= min(target, s)).drop("_rank").withColumn("seats", one)
    # A little wider than the bounds, so that rounding of quotients can't cross them.
    high, low = s / rest * (1 + 1e-9), max(1.0, s / (rest + 2 * g)) * (1 - 1e-9)
    upto = lambda q: F.greatest(one, F.least(F.col(size), F.floor(F.col(size) / q)).cast("bigint"))
    sure = settled(counted.withColumn("_sure", upto(high)).withColumn("_may", F.greatest("_sure", upto(low))), "seats")
    left = rest - sure.agg(F.coalesce(F.sum(F.col("_sure") - 1), F.lit(0))).first()[0]
    rivals = sure.filter("_may > _sure").select(name, size, F.explode(F.sequence(F.col("_sure") + 1, F.col("_may"))).alias("_k"))
    quotient = (F.col(size) / F.col("_k")).alias("_q")
    ranked = running_rank(rivals.select(name, size, "_k", quotient), [F.desc("_q"), F.desc(F.col(size) - F.col("_k") + 1), F.desc(name)], "_rank")
    won = settled(ranked.filter(F.col("_rank") <= left).groupBy(name).agg(F.count("*").alias("_won")), "seats-won")
    return sure.join(won.hint("merge"), name, "left").select(name, size, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("seats"))
