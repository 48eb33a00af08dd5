"""One pass of a text for a whole vocabulary: literals by an automaton, patterns by the literals that they can't do without."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from re import _constants as kinds
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tessella.operators.ranges import small_join

#: Terms of one automaton, which the driver hands to tasks; a larger vocabulary takes as many passes. Rows handed on at a time.
SHARD_TERMS, ROWS = 200_000, 256
_HIT = StructType([StructField("term", StringType()), StructField("start", IntegerType())])


def _found(terms: list[str], at: int, each: bool, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row with the hits of the text in its column number `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in terms:
            automaton.add_word(term, term)
        automaton.make_automaton()
        kind = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32())]))
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part, hits = batch.slice(first, ROWS), []
                for text in part.column(at):
                    free: dict[str, int] = {}
                    mine = []
                    for end, term in automaton.iter(text.as_py() or "") if terms else ():
                        start = end + 1 - len(term)
                        if start >= free.get(term, 0):
                            mine.append({"term": term, "start": start})
                            free[term] = end + 1 if each else 1 << 62
                    hits.append(mine)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hits, kind)], [*part.schema.names, name])

    return run


def with_hits(rows: DataFrame, text_col: str, terms: DataFrame, term_col: str = "term", name: str = "hits", each: bool = True, shard: int = SHARD_TERMS) -> DataFrame:
    """rows with an array of (term, start): the occurrences of each term in the text, start in code points.

    Occurrences of one term don't overlap, from the left; those of different terms may. each: all of them, else the first of
    each term. Null and empty terms have none, nor do null texts. The vocabulary's terms come to the driver, `shard` of
    them at a time by their hash; each shard is one automaton and one pass, whose work doesn't grow with its terms.
    """
    known = terms.select(F.col(term_col).alias("t")).filter("t <> ''").distinct()
    shards = max(1, -(-known.count() // shard))
    out, at = rows, rows.columns.index(text_col)
    for i in range(shards):
        some = sorted(r["t"] for r in known.filter(F.pmod(F.xxhash64("t"), F.lit(shards)) == i).collect())
        step = name if i == 0 else f"{name}_{i}"
        out = out.mapInArrow(_found(some, at, each, step), StructType([*out.schema.fields, StructField(step, ArrayType(_HIT))]))
    return out if shards == 1 else out.withColumn(name, F.concat(*(name if i == 0 else f"{name}_{i}" for i in range(shards)))).drop(*(f"{name}_{i}" for i in range(1, shards)))


def with_terms(rows: DataFrame, text_col: str, vocabulary: DataFrame, term_col: str = "term", outer: bool = False, shard: int = SHARD_TERMS) -> DataFrame:
    """rows x vocabulary where the text contains the term: an equi-join on the terms found. outer: rows without one stay, with nulls."""
    found = with_hits(rows, text_col, vocabulary, term_col, "_hits", each=False, shard=shard)
    explode = F.explode_outer if outer else F.explode
    return small_join(found.select(*rows.columns, explode("_hits.term").alias(term_col)), vocabulary, [term_col], "left" if outer else "inner")


def required_literals(pattern: str) -> list[str] | None:
    """Literals of which every match of the pattern contains one; None where there are none to be had.

    The longest run of plain characters of a sequence; of alternatives one for each. Patterns that ignore case, or that only
    Java's syntax knows, have none.
    """
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError):
        return None
    return None if tree.state.flags & re.IGNORECASE else _needed(list(tree))


def _needed(items: list) -> list[str] | None:
    options: list[list[str]] = []
    run = ""
    for kind, value in [*items, (None, None)]:
        if kind is kinds.LITERAL:
            run += chr(value)
            continue
        if run:
            options.append([run])
            run = ""
        if kind is kinds.BRANCH:
            each = [_needed(list(b)) for b in value[1]]
            if all(each):
                options.append([x for found in each for x in found])
        elif kind is kinds.SUBPATTERN and not value[1] & re.IGNORECASE:
            inner = _needed(list(value[3]))
            options += [inner] if inner else []
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] > 0:
            inner = _needed(list(value[2]))
            options += [inner] if inner else []
    return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=None)


def with_patterns(rows: DataFrame, text_col: str, patterns: DataFrame, pattern_col: str = "pattern", shard: int = SHARD_TERMS) -> DataFrame:
    """rows x patterns where the text matches the pattern. patterns: the author's table, which the driver reads.

    A text meets only the patterns one of whose required literals it contains, and those without any. Java decides each match.
    """
    spark = rows.sparkSession
    known = [r[0] for r in patterns.select(pattern_col).distinct().filter(F.col(pattern_col).isNotNull()).collect()]
    needs = {p: required_literals(p) for p in known}
    literals = spark.createDataFrame([(x, p) for p, found in needs.items() for x in found or ()], "literal string, needed string")
    always = F.array(*(F.lit(p) for p, found in needs.items() if not found)).cast("array<string>")
    found = with_hits(rows, text_col, literals, "literal", "_hits", each=False, shard=shard)
    of = {}
    for p, some in needs.items():
        for x in some or ():
            of.setdefault(x, []).append(p)
    table = F.create_map(*(c for x, some in of.items() for c in (F.lit(x), F.array(*map(F.lit, some))))) if of else F.create_map().cast("map<string,array<string>>")
    tried = F.array_distinct(F.concat(always, F.flatten(F.transform("_hits", lambda h: F.try_element_at(table, h["term"])))))
    met = found.select(*rows.columns, F.explode(tried).alias(pattern_col)).filter(F.expr(f"`{text_col}` rlike `{pattern_col}`"))
    return small_join(met, patterns, [pattern_col])
