"""Parser trees of any depth, and rules in force by an interval join, against plain Python."""

import datetime
import json
import random
import re

from pyspark.sql import functions as F

from tessella.operators import rules, text_jobs


def read(node, path, found):
    """Elements below a node in reading order."""
    if not isinstance(node, dict):
        return
    text = re.sub(r"[\s\xa0]+", " ", str(node.get("content") or "")).strip()
    if text:
        found.append((node.get("page number") or 1, text))
    for kind in ("kids", "list items"):
        for child in node.get(kind) or []:
            read(child, path, found)


def test_trees_of_any_depth(spark):
    r = random.Random(1)

    def tree(depth):
        node = {"type": "x", "page number": r.choice([1, 2, 3])} if r.random() < 0.8 else {}
        if r.random() < 0.6:
            node["content"] = r.choice(["a  b", "one\n\ntwo", "", "é\xa0x", None, "  "])
        if depth:
            for kind in r.sample(["kids", "list items"], r.randint(0, 2)):
                node[kind] = [tree(depth - 1) if r.random() < 0.9 else r.choice([None, 3, "text"]) for _ in range(r.randint(0, 3))]
        return node

    deep = {"content": "bottom", "page number": 7}
    for k in range(12):
        deep = {"list items" if k % 2 else "kids": [deep]}
    files = [(i, json.dumps({"number of pages": 3, "kids": [tree(5) for _ in range(2)]})) for i in range(60)] + [(100, json.dumps({"kids": [deep]})), (101, "no json"), (102, None), (103, "{}"), (104, '{"kids": 3}')]
    got = {}
    for x in text_jobs.tree_elements(spark.createDataFrame(files, "k int, file string"), ["k"], "file").orderBy("k", "path").collect():
        got.setdefault(x.k, []).append((x.page, x.text))
    pages = {(x.k, x.page): x.text for x in text_jobs.tree_pages(text_jobs.tree_elements(spark.createDataFrame(files, "k int, file string"), ["k"], "file"), ["k"]).collect()}
    for i, file in files:
        want: list = []
        if i < 101:
            for child in json.loads(file)["kids"]:
                read(child, "", want)
        assert got.get(i, []) == want
        for p in {p for p, _ in want}:
            assert pages[i, p] == "\n".join(t for q, t in want if q == p)
    assert got[100] == [(7, "bottom")]


def test_a_round_of_a_tree_walk_takes_several_levels(spark, monkeypatch):
    """A tree is written once for each round, not for each level, and the rounds don't change its elements."""
    deep = {"content": "level 9"}
    for k in range(8, -1, -1):
        deep = {"content": f"level {k}", "list items" if k % 2 else "kids": [{"content": " "}, deep, None, 3], "kids" if k % 2 else "list items": [{"content": f"beside {k}", "page number": 0}]}
    files = [(i, json.dumps({"kids": [{"content": "a", "page number": "2"}, deep] * (i % 3)})) for i in range(40)]
    written, settled = [], text_jobs.settled
    monkeypatch.setattr(text_jobs, "settled", lambda df, name: written.append(name) or settled(df, name))
    rows = spark.createDataFrame(files, "k int, file string")
    made = {}
    for levels in (1, 4, 20):
        written.clear()
        made[levels] = sorted(map(tuple, text_jobs.tree_elements(rows, ["k"], "file", levels=levels).collect()))
        assert len(written) == -(-10 // levels)
    assert made[1] == made[4] == made[20]
    want = []
    for i, file in files:
        found: list = []
        for child in json.loads(file)["kids"]:
            read(child, "", found)
        want += [(i, int(p), text) for p, text in found]
    assert [(k, page, text) for k, _, text, page in made[4]] == want
    written.clear()
    text_jobs.tree_elements(rows.filter("k % 3 = 0"), ["k"], "file")
    assert len(written) == 1


def test_rules_by_intervals_equal_all_pairs(spark):
    r, day = random.Random(2), datetime.date(2020, 1, 1)
    at = lambda: r.choice([None, day + datetime.timedelta(days=r.randint(-40, 900))])
    rows = [(i, r.choice([1, 2, 3, None]), at()) for i in range(120)]
    known = [(f"r{i}", r.choice([1, 2, 9, None]), at(), at(), r.random() < 0.9) for i in range(150)]
    made = rules.applicable_rules(spark.createDataFrame(rows, "k int, region long, as_of date"), spark.createDataFrame(known, "rule_id string, region_code int, valid_from date, valid_to date, active boolean"), "region", "as_of")
    got = sorted((x.k, x.rule_id, x.is_local, x.effective) for x in made.collect())
    want = []
    for k, region, d in rows:
        for name, code, start, end, active in known:
            if active and (code is None or code == region) and (end is None or (d is not None and end >= d)):
                want.append((k, name, code is not None, True if start is None else None if d is None else start <= d))
    assert got == sorted(want, key=lambda w: w[:2])
    assert rules.applicable_rules(spark.createDataFrame([], "k int, region long, as_of date"), spark.createDataFrame(known, "rule_id string, region_code int, valid_from date, valid_to date, active boolean"), "region", "as_of").count() == 0


def test_a_million_rules_are_not_broadcast(spark):
    many = spark.range(1_000_000).select(F.concat(F.lit("r"), "id").alias("rule_id"), (F.col("id") % 5000).alias("region_code"), F.lit(None).cast("date").alias("valid_from"), F.expr("date_add(DATE '2020-01-01', cast(id % 3000 AS int))").alias("valid_to"), F.lit(True).alias("active"))
    requests = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 7).alias("region"), F.expr("date_add(DATE '2024-01-01', cast(id % 30 AS int))").alias("as_of"))
    made = rules.rules_in_force(requests.select("region", "as_of"), many, "region", "as_of")
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    want = requests.join(many, (F.col("region") == F.col("region_code")) & (F.col("valid_to") >= F.col("as_of"))).count()
    assert made.count() == want > 1000
