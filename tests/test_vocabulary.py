"""Vocabularies matched in one pass, against plain containment and Java's own patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.operators import places, process, text_jobs, vocabulary


def some_texts(r, n, letters="abé🎉 "):
    return ["".join(r.choices(letters, k=r.randint(0, 25))) for _ in range(n)] + ["", None]


@pytest.mark.parametrize("shard", [3, 1000])
def test_occurrences_equal_plain_search(spark, shard):
    r = random.Random(1)
    texts, terms = some_texts(r, 300), ["a", "ab", "aba", "é🎉", "b b", "zz", "", None, "aa", "🎉"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("term", F.lit("clashes"))
    known = spark.createDataFrame([(t,) for t in terms], "word string")
    got = {x.k: sorted((h.term, h.start) for h in x.found) for x in vocabulary.with_hits(rows, "t", known, "word", "found", shard=shard).collect()}
    for i, text in enumerate(texts):
        assert got[i] == sorted((t, m.start()) for t in terms if t for m in re.finditer(re.escape(t), text or "")), text
    first = {x.k: sorted(h.term for h in x.found) for x in vocabulary.with_hits(rows, "t", known, "word", "found", each=False, shard=shard).collect()}
    assert first == {i: sorted(t for t in terms if t and t in (text or "")) for i, text in enumerate(texts)}
    nothing = vocabulary.with_hits(rows, "t", known.filter("false"), "word", "found")
    assert {len(x.found) for x in nothing.collect()} == {0}


def test_required_literals():
    for pattern, want in [("abc", ["abc"]), ("ab|c", ["ab", "c"]), ("x(?:yes|no)z+", ["yes", "no"]), ("a?b*", None), ("(?i)abc", None), (r"\d+원", ["원"]), ("(ab)+[cd]", ["ab"]), ("a|", None), ("(", None), (r"\Qx\E", None), ("[ab]", None)]:
        found = vocabulary.required_literals(pattern)
        assert (found is None and want is None) or sorted(found) == sorted(want), pattern


def test_patterns_equal_trying_all(spark):
    r = random.Random(2)
    patterns = ["a+b", "ab|é", "(?i)AB", r"\bb", "x?", "aba$", "(?:b a|🎉)b?", "a{2,}", "b(?=a)", "é.*a", None]
    rows = spark.createDataFrame(list(enumerate(some_texts(r, 200))), "k int, t string")
    table = spark.createDataFrame([(p, i) for i, p in enumerate(patterns)], "pattern string, n int")
    got = sorted((x.k, x.n) for x in vocabulary.with_patterns(rows, "t", table).select("k", "n").collect())
    want = rows.crossJoin(table).filter(F.expr("t rlike pattern")).select("k", "n")
    assert got == sorted(map(tuple, want.collect()))
    assert len(got) > 300


def test_no_text_meets_the_whole_vocabulary(spark):
    rows = spark.createDataFrame([(1, "the other text")], "k int, t string")
    words = spark.createDataFrame([("the", 1, "x", "c"), ("none", 2, "y", "d")], "trigger string, priority int, term string, code string")
    made = [
        text_jobs.expand_terms(rows, ["k"], "t", words), text_jobs.mentions(rows, ["k"], "t", words.select("term")), places.regions_by_alias(rows, "t", words.select(F.col("trigger").alias("alias"), F.lit(1).alias("specificity"), F.col("code").alias("region_code"))),
        process.process_events(rows, ["k"], "t", words.select(F.col("code").alias("event_type"), "priority", F.col("trigger").alias("pattern")), F.lit(None).cast("date")),
    ]
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
