"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells, one representative per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import join_groups, materialize, release
from tessella.llm.components import connected_components

#: Vectors aimed at for a cell, least vectors for a cell of a small table, which has up to SMALL_CELLS, most cells, vectors
#: that the cells are fitted on (those with the smallest id hashes), rounds.
CELL_ROWS, SMALL_ROWS, SMALL_CELLS, MAX_CELLS, MAX_FIT, ROUNDS = 16_384, 64, 3, 4096, 20_000, 12
#: Vectors that one task holds, at most, and their bytes as doubles; vectors that visit them in one task, as a multiple of those held;
#: copies of all vectors that are shuffled at a time.
BLOCK_ROWS, BLOCK_BYTES, VISITORS, AT_ONCE = 32_768, 1 << 26, 4, 2
#: Rows and cells of a product that a task computes at a time.
STEP_ROWS, STEP = 1024, 1 << 21
EDGES = "a bigint, b bigint, n bigint"


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Unit centres: each vector goes to the centre of greatest cosine, each centre to the direction of its vectors' sum."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), size=min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1)
        centres[length > 0] = sums[length > 0] / length[length > 0, None]
    return centres


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length. Each is scaled by its greatest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows, in double precision, of a column of vectors of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def _gaps(centres: np.ndarray, reach: float) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T)) * reach + 1e-9


def _near(x: np.ndarray, centres: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's own cell (home), and for each cell whether it may hold a vector within reach of the row.

    With unit vectors x (home a) and y (home c), y is nearer to c than to a. Across the plane between a and c lies no y
    within reach of x unless x is within reach of that plane: x.(a - c) <= reach * |a - c|.
    """
    near = x @ centres.T
    home = near.argmax(axis=1)
    return home, near[np.arange(len(x)), home][:, None] - near <= gaps[home]


def _mixed(number: np.ndarray, factor: int) -> np.ndarray:
    return (number.astype(np.uint64) * np.uint64(factor) >> np.uint64(32)).astype(np.int64)


class Layout:
    """The vectors of a label in order of their cells, cut into blocks of about equal size. sizes: vectors of each cell."""

    def __init__(self, sizes: np.ndarray, block: int) -> None:
        self.sizes = np.maximum(sizes, 1)
        self.start = np.cumsum(sizes) - sizes
        self.blocks = -(-int(sizes.sum()) // block)
        self.rows = -(-int(sizes.sum()) // self.blocks)
        at = np.arange(self.blocks)[None, :]
        #: Whether a block has vectors of a cell; whether block i visits block j: each pair of blocks meets in one of both.
        self.has = (self._block(self.start)[:, None] <= at) & (at <= self._block(self.start + self.sizes - 1)[:, None])
        self.visits = (at.T != at) & ((at.T < at) == ((at.T + at) % 2 == 1))

    def _block(self, place: np.ndarray) -> np.ndarray:
        return np.minimum(place // self.rows, self.blocks - 1)

    def block(self, number: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Each vector's block, by its cell and, within a cell, by chance."""
        return self._block(self.start[home] + _mixed(number, 0x9E3779B97F4A7C15) % self.sizes[home])


def _homes(centres: np.ndarray, labels: set[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The label and cell of each vector of some labels. Columns: label, embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array([x in labels for x in batch.column(0).to_pylist()], pa.bool_()))
            for at in range(0, some.num_rows, STEP_ROWS):
                part = some.slice(at, STEP_ROWS)
                home = (_matrix(part.column(1)) @ centres.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(home, pa.int32())], ["label", "cell"])

    return run


def _dealt(
    centres: np.ndarray, gaps: np.ndarray, layouts: dict[str, Layout], slices: dict[tuple[str, int], tuple[int, int]] | None = None, turn: int = 0
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one turn: a vector in its own block (side 0), and in each block that it visits (2), as one of its cells may hold a partner.

    slices: for each block into how many slices its visitors are dealt, and the turn; own vectors go to each slice (1 from the
    second on). Without slices only rows of labels with a layout are made, and no vectors. Labels without one are a block of turn 0.
    Columns: v, label, embedding, copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                number, label = part.column(0).to_numpy(), np.array(part.column(1).to_pylist(), dtype=object)
                known = set(label) & layouts.keys()
                plain = np.flatnonzero([x not in known for x in label]) if slices is not None and turn == 0 else np.empty(0, np.int64)
                index, blocks, cuts, sides = [plain], [np.zeros(len(plain), np.int64)], [np.zeros(len(plain), np.int64)], [np.zeros(len(plain), np.int64)]
                home, near = _near(_matrix(part.column(2)), centres, gaps) if known else (None, None)
                for one in known:
                    rows, layout = np.flatnonzero(label == one), layouts[one]
                    own = layout.block(number[rows], home[rows])
                    met = (near[rows].astype(np.float32) @ layout.has.astype(np.float32) > 0) & layout.visits[own]
                    for block in np.flatnonzero(met.any(axis=0) | np.isin(np.arange(layout.blocks), own)):
                        n, when = slices.get((one, int(block)), (1, 0)) if slices is not None else (1, turn)
                        if when == turn:
                            mine, guests = rows[own == block], rows[met[:, block]]
                            cut = _mixed(number[guests], 0xC2B2AE3D27D4EB4F) % n
                            index += [np.tile(mine, n), guests]
                            cuts += [np.repeat(np.arange(n), len(mine)), cut]
                            sides += [np.repeat(np.minimum(np.arange(n), 1), len(mine)), np.full(len(guests), 2)]
                            blocks.append(np.full(n * len(mine) + len(guests), block))
                picked = pa.array(np.concatenate(index), pa.int64())
                added = [pa.array(np.concatenate(x), pa.int32()) for x in (blocks, cuts, sides)]
                if slices is None:
                    yield pa.RecordBatch.from_arrays([part.column(1).take(picked), added[0], added[2]], ["label", "block", "side"])
                else:
                    yield pa.RecordBatch.from_arrays([*part.take(picked).columns, *added], [*part.schema.names, "block", "slice", "side"])

    return run


class Block:
    """The vectors of a block in order of their cells, how many vectors each is linked with, and which of them links have joined."""

    def __init__(self, least: float, centres: np.ndarray, gaps: np.ndarray) -> None:
        self.least, self.centres, self.gaps = least, centres, gaps
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.compare, self.links = False, None

    def hold(self, x: np.ndarray, number: np.ndarray, copies: np.ndarray, compare: bool) -> None:
        self.parts.append((x, number, copies))
        self.compare = compare

    def settle(self) -> Iterator[pa.RecordBatch]:
        """When all are held: they meet each other, where that is for this slice to do."""
        if self.links is None:
            x, number, copies = (np.concatenate([part[i] for part in self.parts]) if self.parts else None for i in range(3))
            self.parts = []
            if x is None:
                self.cells, self.links = [], np.zeros(0, np.int64)
                return
            home = np.concatenate([(x[at : at + STEP_ROWS] @ self.centres.T).argmax(axis=1) for at in range(0, len(x), STEP_ROWS)])
            order = np.argsort(home, kind="stable")
            self.x, self.number, self.copies = x[order], number[order], copies[order]
            cells, starts = np.unique(home[order], return_index=True)
            self.cells = list(zip(cells.tolist(), starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True))
            self.links, self.root = np.zeros(len(x), np.int64), np.arange(len(x))
            for at in range(0, len(x) if self.compare else 0, STEP_ROWS):
                upto = slice(at, at + STEP_ROWS)
                yield self.meet(self.x[upto], self.number[upto], self.copies[upto], at)

    def _roots(self, i: np.ndarray) -> np.ndarray:
        root = self.root[i]
        while (self.root[root] != root).any():
            root = self.root[root]
        self.root[i] = root
        return root

    def meet(self, x: np.ndarray, number: np.ndarray, copies: np.ndarray, after: int | None = None) -> pa.RecordBatch:
        """Edges (a, b, 0) of a forest and counts (a, null, n) of visitors, or of own vectors from place `after`, which meet those behind them.

        A vector brings an edge to one vector of each tree that it links, so there are no more edges than vectors.
        """
        near, counts = _near(x, self.centres, self.gaps)[1], np.zeros(len(x), np.int64)
        own = np.full(len(x), -1) if after is None else np.arange(after, after + len(x))
        a, b = [], []
        for cell, low, high in self.cells:
            low = low if after is None else max(low, after + 1)
            mine = np.flatnonzero(near[:, cell]) if low < high else []
            step = max(1, STEP // max(1, high - low))
            for at in range(0, len(mine), step):
                some = mine[at : at + step]
                close = x[some] @ self.x[low:high].T >= self.least
                if after is not None:
                    close &= own[some][:, None] < np.arange(low, high)[None, :]
                i, j = np.nonzero(close)
                if not len(i):
                    continue
                i, j = some[i], j + low
                np.add.at(counts, i, self.copies[j])
                np.add.at(self.links, j, copies[i])
                ends = np.flatnonzero(np.diff(i)) + 1
                for one, others in zip(i[[0, *ends]], np.split(j, ends), strict=True):
                    roots, first = np.unique(self._roots(others), return_index=True)
                    if own[one] < 0:
                        top, new = roots[0], np.ones(len(roots), bool)
                        own[one] = top
                    else:
                        top = self._roots(own[[one]])[0]
                        new = roots != top
                    self.root[roots] = top
                    a.append(np.full(int(new.sum()), number[one]))
                    b.append(self.number[others[first[new]]])
        if after is not None:
            self.links[after : after + len(x)] += counts
            counts[:] = 0
        return _said(np.concatenate([np.empty(0, np.int64), *a]), np.concatenate([np.empty(0, np.int64), *b]), number, counts)

    def done(self) -> Iterator[pa.RecordBatch]:
        yield from self.settle()
        if len(self.links):
            none = np.empty(0, np.int64)
            yield _said(none, none, self.number, self.links)


def _said(a: np.ndarray, b: np.ndarray, number: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([a, number[some]]), pa.int64()), pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(some), pa.int64())]),
            pa.array(np.concatenate([np.zeros(len(a), np.int64), counts[some]]), pa.int64()),
        ],
        names=["a", "b", "n"],
    )


def _compared(least: float, centres: np.ndarray, gaps: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links as (a, b) edges of forests, and each vector's number of linked vectors. Rows are in order of unit, then side.

    A unit's block is held, its visitors pass by: what a task holds doesn't grow with them. Vectors stand for `copies` equal ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, block = None, None
        for batch in batches:
            names, guest = batch.column("unit"), batch.column("side").to_numpy() == 2
            code = names.dictionary_encode().indices.to_numpy()
            ends = np.flatnonzero((np.diff(code) != 0) | (np.diff(guest.astype(np.int8)) != 0)) + 1
            for low, high in zip([0, *ends], [*ends, batch.num_rows], strict=True):
                if low == high:
                    continue
                if (name := names[low].as_py()) != unit:
                    if block:
                        yield from block.done()
                    unit, block = name, Block(least, centres, gaps)
                part = batch.slice(low, high - low)
                number, copies = part.column("v").to_numpy(), part.column("copies").to_numpy()
                if not guest[low]:
                    block.hold(_matrix(part.column("embedding")), number, copies, part.column("side")[0].as_py() == 0)
                    continue
                yield from block.settle()
                for at in range(0, part.num_rows, STEP_ROWS):
                    upto = slice(at, at + STEP_ROWS)
                    yield block.meet(_matrix(part.column("embedding").slice(at, STEP_ROWS)), number[upto], copies[upto])
        if block:
            yield from block.done()

    return run


def near_embeddings(
    vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", within: str | None = "label"
) -> DataFrame:
    """One row per vector: row_id, n_links, component_id (smallest id reachable by links, itself included), kept.

    Two vectors link when their cosine in double precision is at least `least` and, if `within` names a column, their
    values there are equal and not null. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do vectors of different length with each other. kept: row_id = component_id. Ids may repeat or be
    null. An empty table gives no row. Other columns don't matter.

    Equal vectors are compared once, with their number. Cells are fitted on at most MAX_FIT vectors; cells only decide
    what is compared where: a vector meets every cell across whose border a partner may lie, so no link is lost. A label's
    cells are laid out in blocks; a task holds one, whose vectors and visitors are multiplied with it cell by cell, and hands on
    forests and counts. A vector is shuffled to its block and to about half of the blocks that it has to meet, all in turns
    of AT_ONCE copies of all vectors, so that disk doesn't grow faster than the table.
    """
    x = F.col("vector")
    sound = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    label = F.col(within).cast("string") if within else F.lit("")
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).alias("row_id"), label.alias("label"), F.col(vector_col).cast(kind).alias("vector"))
    rows = rows.withColumn("sound", F.coalesce(sound & F.col("label").isNotNull(), F.lit(False))).withColumn("row_no", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("key", F.when(F.col("sound"), F.unhex(F.md5(F.concat_ws("|", "label", F.to_json("vector")))))), "vectors-rows")
    total = rows.count()
    groups = rows.filter("sound").groupBy("key").agg(F.min("row_no").alias("v"), F.count("*").alias("copies"))
    groups = materialize(groups, "vectors-groups")
    firsts = rows.join(groups.select(F.col("v").alias("row_no"), "copies").hint("merge"), "row_no")
    firsts = materialize(firsts.select(F.col("row_no").alias("v"), "label", F.size("vector").alias("width"), F.col("vector").alias("embedding"), "copies"), "vectors-firsts")
    whole, rows = rows, materialize(rows.select("row_id", "sound", "key"), "vectors-keys")
    release(whole)

    found = None
    for width in [r["width"] for r in firsts.select("width").distinct().orderBy("width").collect()]:
        some = _links(firsts.filter(F.col("width") == width).drop("width"), width, least)
        found = some if found is None else found.unionByName(some)
    release(firsts)
    placed = materialize(join_groups(rows.filter("sound").select("row_id", "key"), groups, "key", "copies", total), "vectors-placed")
    apart = rows.filter("NOT sound").select("row_id", F.lit(0).cast("long").alias("n_links"), F.col("row_id").alias("component_id"))
    if found is None:
        return apart.withColumn("kept", F.lit(True))
    links = materialize(connected_components(found.filter("b IS NOT NULL").select("a", "b")), "vectors-components")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("n"))
    by_class = groups.select("v", "copies").join(counts.hint("merge"), "v", "left").join(links.hint("merge"), "v", "left")
    by_class = materialize(by_class.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "v").alias("root"), "copies"), "vectors-classes")
    release(found, links)
    rooted = join_groups(placed.select("row_id", "v"), by_class, "v", "copies", total)
    rooted = materialize(rooted.select("row_id", "n_links", "root"), "vectors-rooted")
    release(placed, groups, by_class)
    names = materialize(rooted.groupBy("root").agg(F.min("row_id").alias("component_id"), F.count("*").alias("k")), "vectors-names")
    named = join_groups(rooted, names, "root", "k", total).select("row_id", "n_links", "component_id")
    return named.unionByName(apart).withColumn("kept", F.col("row_id").eqNullSafe(F.col("component_id")))


def _links(firsts: DataFrame, width: int, least: float) -> DataFrame:
    """Edges (a, b, 0) of forests, and counts (a, null, n). Only labels of more than a block have a layout, which the driver knows."""
    total = firsts.count()
    cells = max(1, min(MAX_CELLS, max(total // CELL_ROWS, min(SMALL_CELLS, total // SMALL_ROWS))))
    sample = firsts.orderBy(F.xxhash64("v"), "v").limit(MAX_FIT).select("v", "embedding").toPandas().sort_values("v")
    centres = spherical_kmeans(_unit(np.array(sample["embedding"].tolist(), dtype=np.float64)), cells)
    gaps = _gaps(centres, float(np.sqrt(max(0.0, 2 - 2 * least))))
    firsts, block, batch = firsts.select("v", "label", "embedding", "copies"), max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width))), max(16, min(10_000, (1 << 23) // (8 * width)))

    layouts, slices, turns, alone = {}, {}, {0: 0}, total
    large = {r["label"]: r["n"] for r in firsts.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > block).collect()}
    if large:
        homes = firsts.select("label", "embedding").mapInArrow(_homes(centres, set(large)), "label string, cell int").groupBy("label", "cell").agg(F.count("*").alias("n"))
        for r in (homes := materialize(homes, "vectors-homes", batch)).groupBy("label").agg(F.collect_list(F.struct("cell", "n")).alias("cells")).toLocalIterator():
            sizes = np.zeros(len(centres), np.int64)
            sizes[[c["cell"] for c in r["cells"]]] = [c["n"] for c in r["cells"]]
            layouts[r["label"]] = Layout(sizes, block)
        side = lambda i: F.count(F.when((F.col("side") == i), 1))
        visits = firsts.mapInArrow(_dealt(centres, gaps, layouts), "label string, block int, side int").groupBy("label", "block").agg(side(0).alias("own"), side(2).alias("guests"))
        visits = materialize(visits, "vectors-visits", batch)
        alone = upto = total - sum(large.values())
        for r in sorted(visits.toLocalIterator(), key=lambda r: (r["label"], r["block"])):
            n, turn = max(1, -(-r["guests"] // (VISITORS * block))), upto // max(1, AT_ONCE * total)
            slices[r["label"], r["block"]] = n, turn
            turns[turn] = turns.get(turn, 0) + n
            upto += n * r["own"] + r["guests"]
        release(homes, visits)

    found = None
    for turn, units in sorted(turns.items()):
        # Several partitions for a unit, so that few tasks get more than one.
        parts = max(8 * units, -(-alone // block) if turn == 0 else 1, int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = firsts.mapInArrow(_dealt(centres, gaps, layouts, slices, turn), "v bigint, label string, embedding " + firsts.schema["embedding"].dataType.simpleString() + ", copies bigint, block int, slice int, side int")
        dealt = dealt.select("v", "embedding", "copies", "side", F.concat_ws("|", "block", "slice", "label").alias("unit"))
        some = materialize(dealt.repartition(parts, "unit").sortWithinPartitions("unit", "side").mapInArrow(_compared(least, centres, gaps), EDGES), "vectors-links", batch)
        found = some if found is None else found.unionByName(some)
    return found
