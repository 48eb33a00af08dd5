"""Hard negatives by exact integer scores: products in a residue number system, then windows of scores under each positive.

Scores are inner products of whole numbers. Each vector block is reduced modulo several small primes, whose residues
multiply as float32 matrices without any rounding (a sum of at most SUM_TERMS products of residues stays below 2^24); the
signed score is put together from its residues by the Chinese remainder theorem. As many primes are taken as the largest
vectors ask for.

Anchors meet all rows in tiles: a tile is a block of rows and a block of anchors, each of bounded size, and is one unit
of a task's work. Two rounds of tiles are needed, as a positive's score sets the window of its negatives. From a tile only
the first few rows of each anchor or window go on to the ranking by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialize, release

#: Rows of a block, anchors of a block, anchors multiplied at a time, products of residues that float32 sums exactly, tiles
#: that a Python worker gets at a time.
BLOCK_ROWS, BLOCK_ANCHORS, AT_ONCE, SUM_TERMS, TILES = 8192, 1024, 128, 1024, 8
#: Primes of the number system, the largest below 2^8. Residues are taken from -(p - 1) / 2 to (p - 1) / 2.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199)
#: Scores must be below this in magnitude, so that they are longs and the primes above suffice.
LARGEST_SCORE = 1 << 62

def primes_for(bound: int) -> tuple[int, ...]:
    """The first primes whose product exceeds 2 * bound, so that scores from -bound to bound have different residues."""
    product, n = 1, 0
    while product <= 2 * bound:
        if n == len(PRIMES):
            raise ValueError("scores exceed a long")
        product, n = product * PRIMES[n], n + 1
    return PRIMES[: max(1, n)]


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers (float64) modulo p as float32, of least magnitude."""
    r = np.fmod(x, p)
    half = p // 2
    return np.where(r > half, r - p, np.where(r < -half, r + p, r)).astype(np.float32)


def _reduced(x: np.ndarray, p: int) -> np.ndarray:
    return x - np.rint(x / np.float32(p)) * np.float32(p)


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a b^T modulo p (float32 residues): the width is cut where sums of products would pass 2^24."""
    total = np.zeros((len(a), len(b)), dtype=np.float32)
    for at in range(0, a.shape[1], SUM_TERMS):
        total = _reduced(total + _reduced(a[:, at : at + SUM_TERMS] @ b[:, at : at + SUM_TERMS].T, p), p)
    return total


def reconstruct(parts: list[np.ndarray], primes: tuple[int, ...], bound: int) -> np.ndarray:
    """The whole numbers from -bound to bound that have these residues.

    Mixed-radix digits of x + bound, which isn't negative: no step leaves the range of a long.
    """
    out, scale = np.full(parts[0].shape, -bound, dtype=np.int64), 1
    digits: list[np.ndarray] = []
    for k, (part, p) in enumerate(zip(parts, primes, strict=True)):
        x = (part.astype(np.int64) + bound % p) % p
        for digit, q in zip(digits, primes[:k], strict=True):
            x = (x - digit) * pow(q, -1, p) % p
        digits.append(x)
        out += x * scale
        scale *= p
    return out


def _packed(size: int, exact: np.dtype) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows as blocks of at most `size` rows of one width in the order of ids: their columns as lists, their vectors as one matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}

        def packed(width: int) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held.pop(width)).combine_chunks()
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("row_id", "ascending"), ("no", "ascending")], null_placement="at_end"))
            x = rows.column("vector").combine_chunks().flatten().to_numpy().astype(exact)
            lists = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(c).combine_chunks()) for c in rows.column_names if c != "vector"]
            names = [c for c in rows.column_names if c != "vector"]
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([x.tobytes()], pa.binary()), *lists], ["width", "matrix", *names])

        for batch in batches:
            widths = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
            for width in np.unique(widths).tolist():
                some = batch.filter(pa.array(widths == width))
                while some.num_rows:
                    mine = held.setdefault(width, [])
                    part = some.slice(0, size - sum(b.num_rows for b in mine))
                    mine.append(part)
                    some = some.slice(part.num_rows)
                    if sum(b.num_rows for b in mine) == size:
                        yield packed(width)
        for width in sorted(held):
            yield packed(width)

    return run


def _best(scores: np.ndarray, some: np.ndarray, n: int) -> np.ndarray:
    """Of the places `some` (ascending, so by id) the n with the greatest scores, in order."""
    if len(some) > n:
        least = np.partition(scores[some], len(some) - n)[len(some) - n]
        some = some[scores[some] >= least]
    return some[np.argsort(-scores[some], kind="stable")[:n]]


def _searched(primes: tuple[int, ...], bound: int, n: int, percent: int, exact: np.dtype) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From each tile, for each anchor, its best n rows of the same label; or, if anchors bring windows, the best n of other labels in each.

    A window is given by the positive's score: it reaches from `percent` of that up to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tile = {name: batch.column(name)[k] for name in batch.schema.names}
                width = tile["width"].as_py()
                rows, anchors = (np.frombuffer(tile[c].as_buffer(), dtype=exact).reshape(-1, width) for c in ("matrix", "a_matrix"))
                no, label, a_no, a_label = (tile[c].values.to_numpy(zero_copy_only=False) for c in ("no", "label", "a_no", "a_label"))
                windows = tile["a_windows"].as_py() if "a_windows" in tile else None
                places, values, owners, tops = [], [], [], []
                held = [residues(rows, p) for p in primes]
                for at in range(0, len(anchors), AT_ONCE):
                    products = [residue_product(residues(anchors[at : at + AT_ONCE], p), r, p) for p, r in zip(primes, held, strict=True)]
                    for i, scores in enumerate(reconstruct(products, primes, bound), start=at):
                        same = label == a_label[i]
                        for top in windows[i] if windows else [None]:
                            inside = same & (no != a_no[i]) if top is None else ~same & (scores <= top) & (scores >= -(-percent * top // 100))
                            found = _best(scores, np.flatnonzero(inside), n)
                            places.append(found)
                            values.append(scores[found])
                            owners += [int(a_no[i])] * len(found)
                            tops += [top] * len(found)
                if not owners:
                    continue
                place = pa.array(np.concatenate(places))
                columns = [pa.array(owners, pa.int64()), pa.array(tops, pa.int64()), tile["no"].values.take(place), tile["row_id"].values.take(place), pa.array(np.concatenate(values), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["a_no", "top", "no", "row_id", "score"])

    return run


def _first(found: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first n rows of each group by score, then id, with their place from 1. Each map task hands on n rows of a group at most."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("row_id"), "no")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and positive its hard negatives.

    A component x counts as floor(scale * x); a score is the exact inner product of two rows. Higher scores come first, ties
    by the smaller id (null ids last). An anchor's positives are its first `positives` other rows of the same label. The
    negatives of a positive are the first `negatives` rows of other labels whose score is at least `percent` per cent of
    the positive's and at most the positive's; rank counts them from 1. Without any, a positive gives no row.

    is_anchor and label are columns over `vectors`; label is a whole number. Rows with a null label, a null or empty vector,
    or a null or non-finite component take no part; a null is_anchor is false. Vectors are compared with those of their own
    length only. Each row counts, also where ids or vectors repeat. Scores must stay below 2^62. An empty table gives no
    row. Other columns don't matter. Every anchor meets every row, in tiles; nothing is sampled or left out.
    """
    x = F.col(vector_col)
    sound = F.coalesce((F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    rows = vectors.filter(sound & label.isNotNull()).select(F.col(id_col).alias("row_id"), label.cast("bigint").alias("label"), whole.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = materialize(rows.withColumn("no", F.monotonically_increasing_id()), "negatives-rows")
    longest = rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)).alias("s"), F.max(F.array_max(F.transform("vector", F.abs))).alias("c")).first()
    kind = rows.schema["row_id"].dataType.simpleString()
    if longest["s"] is None:
        return rows.select(*(F.col("row_id").alias(c) for c in ("anchor_id", "positive_id")), F.lit(0).alias("rank"), F.col("row_id").alias("negative_id"), F.lit(0).cast("bigint").alias("positive_score"), F.lit(0).cast("bigint").alias("negative_score"))
    if longest["s"] >= LARGEST_SCORE:
        raise ValueError("scores exceed a long")
    bound = int(longest["s"] * (1 + 1e-9)) + 1
    primes, exact = primes_for(bound), np.dtype(np.float32 if longest["c"] < 1 << 24 else np.float64)

    def blocks(some: DataFrame, size: int, prefix: str) -> DataFrame:
        columns = [c for c in some.columns if c != "vector"]
        fields = "".join(f", {c} array<{some.schema[c].dataType.simpleString()}>" for c in columns)
        packed = materialize(some.mapInArrow(_packed(size, exact), f"width int, matrix binary{fields}"), "negatives-blocks")
        return packed.select("width", *(F.col(c).alias(prefix + c) for c in ("matrix", *columns)), F.xxhash64("width", "no").alias(f"{prefix}hash"))

    def tiles(anchors: DataFrame, n: int) -> DataFrame:
        """Each block of rows meets each block of anchors of its width once: either side is dealt, and copied to all deals of the other."""
        a, b = max(1, anchors.count()), max(1, held.count())
        mine = held.withColumn("a_deal", F.explode(F.sequence(F.lit(0), F.lit(a - 1)))).withColumn("deal", F.pmod("hash", F.lit(b)).cast("int")).drop("hash")
        theirs = anchors.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).withColumn("a_deal", F.pmod("a_hash", F.lit(a)).cast("int")).drop("a_hash")
        met = mine.hint("merge").join(theirs, ["width", "a_deal", "deal"]).drop("a_deal", "deal", "a_row_id")
        return met.mapInArrow(_searched(primes, bound, n, percent, exact), f"a_no bigint, top bigint, no bigint, row_id {kind}, score bigint")

    held = blocks(rows.select("no", "row_id", "label", "vector"), BLOCK_ROWS, "")
    anchors = rows.filter("is_anchor").select("no", "row_id", "label", "vector")
    first = blocks(anchors, BLOCK_ANCHORS, "a_")
    near = materialize(_first(tiles(first, positives), ["a_no"], positives), "negatives-positives", TILES)
    windows = near.groupBy(F.col("a_no").alias("no")).agg(F.sort_array(F.collect_set("score")).alias("windows"))
    second = blocks(anchors.join(windows.hint("merge"), "no"), BLOCK_ANCHORS, "a_")
    hard = materialize(_first(tiles(second, negatives), ["a_no", "top"], negatives), "negatives-found", TILES)
    named = near.select("a_no", F.col("row_id").alias("positive_id"), F.col("score").alias("top")).join(hard.hint("merge"), ["a_no", "top"])
    named = named.join(anchors.select(F.col("no").alias("a_no"), F.col("row_id").alias("anchor_id")).hint("merge"), "a_no")
    out = named.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("row_id").alias("negative_id"), F.col("top").alias("positive_score"), F.col("score").alias("negative_score"))
    release(held, first, second)
    return out
