"""N-gram Jaccard self-join with adaptive multi-match prefixes: groups of near-duplicate documents, no link lost.

A document's set is its distinct word n-grams, as 64-bit hashes of their words' hashes, in the order of the hashes. With n members and at least
ceil(t n) of them shared, two similar documents share at least l members of their prefixes of n - ceil(t n) + l members,
for every l. So:

1. Documents with the same words form a class, whose first document stands for it.
2. Large groups: for prefix members that many classes share, one of each magnitude for a class, classes are dealt in chunks
   of bounded size; sketches are compared within a chunk, and a spanning forest of what looks alike is verified. That
   joins large groups at linear cost and loses nothing, as only links that hold are kept.
3. Prefixes: for each prefix member the number of documents of other groups that share it is its cost. A member of great
   cost isn't used to find candidates; the document's prefix is lengthened by one for each such member, and by more the
   more candidates are estimated, so that correspondingly more members must be shared (need). A pair is a candidate if it shares
   `need` usable members within the shorter of both lengthenings. Documents whose lengthening runs out, since most of them
   is common, are joined among themselves on prefixes of their whole sets in the order of frequency.
4. Candidates of different groups are verified on their whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import TEXT_ROWS, join_groups, join_small, materialize, release, row_keys, without_rows
from tessella.llm.components import connected_components
from tessella.llm.substring import folded_hashes, word_hashes, word_slices

#: Classes that share a member from which it is dealt by, hashes of a sketch, classes of a chunk, the most members by
#: which a prefix is lengthened, average candidates of a prefix member above which it isn't used.
MANY, SKETCH, CHUNK, LONGEST, COSTLY = 16, 32, 256, 48, 8
#: Classes of other groups that a class meets by a member, on average, above which they are compared in blocks of CHUNK
#: instead of pair by pair.
BLOCKED = 32


def shingle_sets(texts_words: list[list[bytes]], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word sequences; of all its words as one sequence if there are fewer."""
    values = word_hashes(list(chain.from_iterable(texts_words)))
    folded, at, out = folded_hashes(values, n), 0, []
    for words in texts_words:
        k = len(words)
        out.append(np.unique(folded[at : at + k - n + 1] if k >= n else folded_hashes(values[at : at + k], k)))
        at += k
    return out


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _prefixes(n: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words_of in word_slices(batch.column(2), lower=True):
                part = batch.slice(at, len(words_of))
                sets = shingle_sets(words_of, n)
                keys = [hashlib.md5(b" ".join(words)).digest() for words in words_of]
                prefixes = [s[: len(s) - -(-percent * len(s) // 100) + LONGEST].view(np.int64) for s in sets]
                columns = [pa.array(keys, pa.binary()), pa.array(list(map(len, sets)), pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))]
                names = ["row_id", "text_hash", "row_no", "key", "n_shingles", "prefix"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), *columns], names)
        pa.default_memory_pool().release_unused()

    return run


def _alike(percent: int) -> Callable[[pa.Table], pa.Table]:
    """A spanning forest of one chunk's classes whose sketches (their smallest hashes) share nearly as much as links would."""
    least = percent / 100 - 0.15

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("v").to_numpy())
        v = rows.column("v").to_numpy()[order]
        sketches = rows.column("sketch").combine_chunks().take(pa.array(order))
        owner = np.repeat(np.arange(len(v)), np.diff(sketches.offsets.to_numpy()))
        values = np.unique(sketches.flatten().to_numpy(), return_inverse=True)[1]
        held = np.zeros((len(v), int(values.max(initial=0)) + 1), dtype=np.float32)
        held[owner, values] = 1
        sizes = held.sum(axis=1)
        shared = np.triu(held @ held.T, 1)
        root = list(range(len(v)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        a, b = [], []
        for i, j in zip(*np.nonzero(shared >= np.maximum(1, least * np.minimum(sizes[:, None], sizes[None, :]))), strict=True):
            x, y = find(int(i)), find(int(j))
            if x != y:
                root[y] = x
                a.append(int(v[i]))
                b.append(int(v[j]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _members(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each member of the whole sets of documents whose text has the wanted key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = _words(text.as_py())
                if hashlib.md5(b" ".join(words)).digest() == key:
                    members = shingle_sets([words], n)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(members), v)), pa.array(members.view(np.int64))], ["v", "member"])

    return run


def _verified(n: int, percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links of one chunk of a star: the centre's set against each other document's."""

    def run(rows: pa.Table) -> pa.Table:
        centre, sets = rows.column("centre")[0].as_py(), {}
        for v, key, text in zip(rows.column("v").to_pylist(), rows.column("key").to_pylist(), rows.column("text"), strict=True):
            words = _words(text.as_py())
            if v not in sets and hashlib.md5(b" ".join(words)).digest() == key:
                sets[v] = shingle_sets([words], n)[0]
        mine, found = sets.pop(centre), []
        for v, theirs in sets.items():
            shared = len(np.intersect1d(mine, theirs, assume_unique=True))
            if 100 * shared >= percent * (len(mine) + len(theirs) - shared):
                found.append(v)
        return pa.table([pa.array([centre] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])

    return run


def _texts(docs: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """wanted (text_hash, row_id and more) with texts. Rows that repeat an id and text come several times."""
    wanted = materialize(wanted.withColumnRenamed("row_id", "wanted_id"), name)
    return join_small(docs, wanted, "text_hash", "inner").filter(F.col("row_id").eqNullSafe(F.col("wanted_id")))


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a: centre, b) that are similar enough. Texts go to the tasks that compare them, once for each chunk of a star. pairs: a table."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.count("*").alias("n"))
    sizes = materialize(sizes, "ngram-stars")
    centres = sizes.select(F.col("a").alias("v"), F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    others = join_groups(pairs, sizes, "a", "n", pairs.count())
    others = others.select(F.col("b").alias("v"), F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"))
    wanted = centres.unionByName(others).join(classes.select("v", "row_id", "text_hash", "key").hint("merge"), "v")
    found = _texts(docs, wanted, "ngram-wanted").select("v", "centre", "chunk", "key", "text").groupBy("centre", "chunk")
    links = materialize(found.applyInArrow(_verified(n, percent), "a bigint, b bigint"), "ngram-links", TEXT_ROWS)
    release(pairs, sizes)
    return links


def _largest(rows: DataFrame, name: str) -> DataFrame:
    """member, all (classes that share it), partners (those of other groups that a class meets on average), largest (its largest group).

    A table, without members of one group only. rows: member, component.
    """
    by_group = rows.groupBy("member", "component").agg(F.count("*").alias("k"))
    k = F.col("k")
    found = by_group.groupBy("member").agg(F.sum(k).alias("all"), (F.sum(k) - F.sum(k * k) / F.sum(k)).alias("partners"), F.max_by("component", F.struct("k", "component")).alias("largest"))
    return materialize(found.filter("partners > 0"), name)


def _pairs(rows: DataFrame, columns: list[str], percent: int, within: str = "true") -> DataFrame:
    """Pairs of classes of different groups that share a member and may be similar by their sizes, v_x the smaller.

    Of two such classes one at least isn't of the member's largest group: only those are joined with all, so classes of
    one large group don't meet each other. rows: member, largest, and the columns, of which `within` may use both sides'.
    """
    x = rows.filter("component <> largest").select("member", *(F.col(c).alias(f"{c}_x") for c in columns))
    y = rows.select("member", (F.col("component") == F.col("largest")).alias("in_largest"), *(F.col(c).alias(f"{c}_y") for c in columns))
    alike = f"(in_largest OR v_x < v_y) AND component_x <> component_y AND 100 * least(n_shingles_x, n_shingles_y) >= {percent} * greatest(n_shingles_x, n_shingles_y)"
    found = x.hint("merge").join(y, "member").filter(f"{alike} AND {within}")
    return found.withColumns({"v_x": F.least("v_x", "v_y"), "v_y": F.greatest("v_x", "v_y")})


def _blocked(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links between the classes of two blocks (side 0 and 1) or of one (side 2), as a spanning forest, by a product of their sets."""

    def run(rows: pa.Table) -> pa.Table:
        v, side = rows.column("v").to_numpy(), rows.column("side").to_numpy()
        sets = rows.column("set").combine_chunks()
        owner = np.repeat(np.arange(len(v)), np.diff(sets.offsets.to_numpy()))
        _, numbers, often = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
        sizes = np.bincount(owner, minlength=len(v)).astype(np.float32)
        kept = often[numbers] > 1  # members of one class alone add nothing to an intersection
        owner, numbers = owner[kept], np.unique(numbers[kept], return_inverse=True)[1]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        shared = np.zeros((len(v), len(v)), dtype=np.float32)
        for at in range(0, int(numbers.max(initial=-1)) + 1, 8192):
            part = (numbers >= at) & (numbers < at + 8192)
            held = np.zeros((len(v), 8192), dtype=np.float32)
            held[owner[part], numbers[part] - at] = 1
            shared[np.ix_(left, right)] += held[left] @ held[right].T
        alike = (100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)) & (shared > 0)
        root, a, b = list(range(len(v))), [], []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(*np.nonzero(alike), strict=True):
            x, y = find(int(i)), find(int(j))
            if x != y:
                root[y] = x
                a.append(int(v[i]))
                b.append(int(v[j]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _block_links(rows: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links among classes that share a member (rows: v, member, component, largest, all), block by block.

    Classes of the member's largest group have blocks of their own, which meet the other blocks, not each other.
    """
    sets = whole.groupBy("v").agg(F.collect_list("member").alias("set"))
    rows = rows.select("v", "member", (F.col("component") == F.col("largest")).alias("major"))
    sizes = rows.groupBy("member").agg(*(F.ceil(F.count_if(c) / CHUNK).cast("int").alias(n) for c, n in ((~F.col("major"), "minors"), (F.col("major"), "majors"))))
    rows = join_groups(rows, materialize(rows.groupBy("member").agg(F.count("*").alias("often")).join(sizes.hint("merge"), "member"), "ngram-blocked"), "member", "often", rows.count())
    # Blocks below `minors` are of other groups. Such a block meets itself and all others; a block of the largest group those.
    own = F.pmod(F.xxhash64("v", "member"), F.when(F.col("major"), F.col("majors")).otherwise(F.col("minors"))).cast("int")
    rows = rows.withColumn("block", own + F.when(F.col("major"), F.col("minors")).otherwise(0))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("minors") - 1 + F.when(F.col("major"), 0).otherwise(F.col("majors")))))
    rows = rows.select(
        "v", "member", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    return rows.join(sets.hint("merge"), "v").groupBy("member", "low", "high").applyInArrow(_blocked(percent), "a bigint, b bigint")


def _candidates(docs: DataFrame, classes: DataFrame, groups: DataFrame, shared: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Tables of pairs of classes in different groups that may be linked, and of links found block by block.

    groups: v, component, n_shingles; shared: v, member, layer, all, a table that is released.
    """
    grouped = materialize(shared.drop("all").join(groups.hint("merge"), "v"), "ngram-grouped")
    release(shared)
    costs = _largest(grouped, "ngram-costs")
    costed = materialize(join_groups(grouped, costs, "member", "all", grouped.count()).drop("all"), "ngram-costed")
    release(grouped, costs)

    usable = F.col("partners") <= COSTLY
    each = costed.groupBy("v", "n_shingles").agg(F.collect_list(F.when(~usable, F.col("layer"))).alias("costly"), F.sum(F.when(usable, F.col("partners"))).alias("expected"))
    need = 1 + (F.col("expected") > 4).cast("int") + (F.col("expected") > 16).cast("int") + (F.col("expected") > 64).cast("int")
    each = each.withColumn("need", F.coalesce(need, F.lit(1))).withColumn("most", F.least(F.lit(LONGEST), F.ceil(percent * F.col("n_shingles") / 100)).cast("int"))
    enough = F.expr("filter(sequence(1, most), l -> size(filter(costly, x -> x <= l)) <= l - least(need, most))")
    each = materialize(each.select("v", F.try_element_at(enough, F.lit(1)).alias("length"), F.least("need", "most").alias("must")), "ngram-lengths")

    light = costed.filter(usable).drop("partners").join(each.hint("merge"), "v").filter(F.col("layer") <= F.coalesce("length", F.lit(LONGEST)))
    must = F.expr("CASE WHEN length_y IS NULL OR length_x < length_y THEN must_x WHEN length_x IS NULL OR length_y < length_x THEN must_y ELSE greatest(must_x, must_y) END")
    columns = ["v", "component", "n_shingles", "layer", "length", "must"]
    pairs = _pairs(light, columns, percent, "greatest(layer_x, layer_y) <= least(length_x, length_y)").withColumn("must", must)
    pairs = pairs.groupBy("v_x", "v_y").agg(F.count("*").alias("shared"), F.max("must").alias("must")).filter("shared >= must")

    dense = classes.select("v", "row_id", "text_hash", "key").join(each.filter("length IS NULL").select("v").hint("merge"), "v")
    whole = _texts(docs, dense, "ngram-dense").select("v", "key", "text").mapInArrow(_members(n), "v bigint, member bigint").distinct()
    whole = materialize(whole, "ngram-whole", TEXT_ROWS)
    frequency = whole.groupBy("member").agg(F.count("*").alias("all"))
    frequency = materialize(frequency, "ngram-frequency")
    ordered = join_groups(whole, frequency, "member", "all", whole.count())
    rank = F.row_number().over(Window.partitionBy("v").orderBy("all", "member"))
    plain = ordered.withColumn("rank", rank).join(groups.hint("merge"), "v")
    plain = plain.filter(F.col("rank") <= F.col("n_shingles") - F.ceil(percent * F.col("n_shingles") / 100) + 1).filter("all > 1")
    plain = materialize(plain.select("v", "member", "component", "n_shingles"), "ngram-plain")
    many = _largest(plain, "ngram-many")
    often = materialize(join_groups(plain, many, "member", "all", plain.count()), "ngram-often")
    release(frequency, plain, many)
    found = _block_links(often.filter(F.col("partners") > BLOCKED), whole, percent)
    found = materialize(found.distinct(), "ngram-blocks")
    release(whole)
    common = _pairs(often.filter(F.col("partners") <= BLOCKED), ["v", "component", "n_shingles"], percent)
    pairs = pairs.select("v_x", "v_y").unionByName(common.select("v_x", "v_y")).distinct()
    pairs = materialize(pairs.select(F.col("v_x").alias("a"), F.col("v_y").alias("b")), "ngram-pairs")
    release(costed, each, often)
    return pairs, found


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row_id, n_shingles (its set's size), component_id (smallest id reachable by links, itself included).

    Words are runs without white space, A to Z in lower case; a set holds distinct n-word shingles, the whole sequence as
    one if shorter. Two documents link when 100 * intersection >= percent * union. Documents without words or with a null
    text have an empty set and link with nothing. Ids may be null (they name no component unless all of one are) or repeat.
    An empty table gives no row. Other columns of docs don't matter.
    """
    return _groups(docs, n, percent, id_col, text_col)[0].select("row_id", "n_shingles", "component_id")


def _groups(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """near_duplicates with text_hash and root, the number of a row's group (null for an empty set); and the tables that it reads."""
    columns = [F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")]
    plain = docs.select(*columns)
    kind = plain.schema["row_id"].dataType.simpleString()
    schema = f"row_id {kind}, text_hash bigint, row_no bigint, key binary, n_shingles bigint, prefix array<bigint>"
    rows = materialize(docs.select(*columns, F.monotonically_increasing_id().alias("row_no")).mapInArrow(_prefixes(n, percent), schema), "ngram-rows", TEXT_ROWS)
    full = rows.filter("n_shingles > 0")
    groups = materialize(full.groupBy("key").agg(F.min("row_no").alias("v"), F.count("*").alias("copies")), "ngram-classes")
    total = rows.count()
    members = materialize(join_groups(full.select("key", "row_id", "text_hash"), groups, "key", "copies", total).select("row_id", "text_hash", "v"), "ngram-members")
    classes = full.join(groups.select(F.col("v").alias("row_no")).hint("merge"), "row_no", "left_semi").withColumnRenamed("row_no", "v")
    classes = materialize(classes, "ngram-firsts")
    empty = materialize(rows.filter("n_shingles = 0").select("row_id", "n_shingles", F.col("row_id").alias("component_id"), "text_hash", F.lit(None).cast("bigint").alias("root")), "ngram-empty")
    release(rows, groups)

    plain_length = F.col("n_shingles") - F.ceil(percent * F.col("n_shingles") / 100) + 1
    prefix = classes.select("v", plain_length.alias("plain"), F.posexplode("prefix").alias("at", "member"))
    prefix = prefix.select("v", "member", F.greatest(F.lit(1), F.col("at") + 2 - F.col("plain")).cast("short").alias("layer"))
    often = prefix.groupBy("member").agg(F.count("*").alias("all")).filter("all > 1")
    shared = materialize(prefix.join(often.hint("merge"), "member"), "ngram-shared")

    dealt = shared.filter(F.col("all") >= MANY).groupBy("v", F.floor(F.log2("all")).alias("magnitude")).agg(F.min(F.struct("member", "all")).alias("d"))
    dealt = dealt.select("v", "d.member", F.pmod(F.xxhash64("v", "d.member"), F.ceil(F.col("d.all") / CHUNK)).alias("chunk"))
    dealt = dealt.join(classes.select("v", F.slice("prefix", 1, SKETCH).alias("sketch")).hint("merge"), "v")
    pairs = dealt.groupBy("member", "chunk").applyInArrow(_alike(percent), "a bigint, b bigint").distinct()
    pairs = materialize(pairs, "ngram-pairs")
    links = _links(plain, classes, pairs, n, percent)
    found = connected_components(links)
    first = materialize(found, "ngram-first-groups")
    release(found)
    groups = classes.select("v", "n_shingles").join(first.hint("merge"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    groups = materialize(groups, "ngram-groups")
    pairs, blocks = _candidates(plain, classes, groups, shared, n, percent)
    more = _links(plain, classes, pairs, n, percent)
    final = connected_components(links.unionByName(blocks).unionByName(more))

    placed = members.join(final.hint("merge"), "v", "left").select("row_id", "text_hash", "v", F.coalesce("component", "v").alias("root"))
    placed = materialize(placed, "ngram-placed")
    release(members, links, blocks, more, first, groups, final)
    names = materialize(placed.groupBy("root").agg(F.min("row_id").alias("component_id"), F.count("*").alias("k")), "ngram-names")
    sizes = materialize(classes.select("v", "n_shingles"), "ngram-sizes")
    release(classes)
    named = join_groups(placed, names, "root", "k", total).select("row_id", "text_hash", "root", "v", "component_id")
    sized = named.join(sizes.hint("merge"), "v").select("row_id", "n_shingles", "component_id", "text_hash", "root")
    return sized.unionByName(empty), [placed, names, sizes, empty]


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group the row with the smallest id (null last), one row where that repeats.

    Rows are told apart by id and text. Documents without words stay.
    """
    keys = row_keys(id_col, text_col, docs.columns)
    by_id, by_text = keys
    found, read = _groups(docs, n, percent, id_col, text_col)
    found = found.filter("root IS NOT NULL").groupBy("root", "row_id", "text_hash").agg(F.count("*").alias("n"))
    found = materialize(found, "ngram-found")
    first = F.min(F.struct(F.col("row_id").isNull().alias("no_id"), "row_id", "text_hash"))
    groups = materialize(found.groupBy("root").agg(first.alias("first"), F.sum("n").alias("k"), F.count("*").alias("rows")).filter("k > 1"), "ngram-kept")
    named = join_groups(found, groups, "root", "rows", found.count())
    named = named.withColumn("kept", F.col("row_id").eqNullSafe(F.col("first.row_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    named = named.withColumn(by_id, F.coalesce(F.concat(F.lit("i"), F.col("row_id").cast("string")), F.lit("n"))).withColumn(by_text, F.col("text_hash"))
    gone = materialize(named.filter("NOT kept").select(*keys), "ngram-gone")
    repeated = materialize(named.filter("kept AND n > 1").select(*keys), "ngram-repeated")
    release(found, groups, *read)
    return without_rows(docs, keys, gone, repeated)
