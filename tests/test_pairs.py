"""Joins whose pairs are many more than their rows, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.operators import cases, intake, pack, permits, places, ranges


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("unit", [3, 20_000])
def test_levels_equal_all_pairs_and_pairs_arent_grouped(spark, unit):
    r = random.Random(1)
    some = lambda n: [(i, r.choice([1, 2, 3, None]), r.choice([1, 2, None]), r.choice([1, 2, None])) for i in range(n)]
    a, b = some(60), some(40)
    made = places.match_by_level(spark.createDataFrame(a, "t int, ri int, eup int, county int"), spark.createDataFrame(b, "m int, ri int, eup int, county int"), "t", "m", [("ri", "same_ri", 3), ("eup", "same_eup", 2), ("county", "same_county", 1)], ["county"], unit)
    want = []
    for t, *x in a:
        for m, *y in b:
            county = x[2] is None or y[2] is None or x[2] == y[2]
            level = next((k for k in range(3) if x[k] is not None and x[k] == y[k] and (county or k == 2)), None)
            if level is not None:
                want.append((t, m, ["same_ri", "same_eup", "same_county"][level], 3 - level))
    assert sorted(map(tuple, made.collect())) == sorted(want)
    assert "Aggregate" not in plan(made)


def test_written_pairs_of_levels_take_little_disk(spark, tmp_path):
    r = random.Random(7)
    a = spark.createDataFrame([(i, r.randrange(5), 1) for i in range(2000)], "t long, ri int, county int")
    b = spark.createDataFrame([(i, r.randrange(5), 1) for i in range(1203)], "m long, ri int, county int")
    places.match_by_level(a, b, "t", "m", [("ri", "same_ri", 3), ("county", "same_county", 1)], ["county"]).write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == 2000 * 1203
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.4 * 2000 * 1203


def test_lists_hold_all_ids_of_rows_that_agree(spark):
    r = random.Random(8)
    rows = [(r.choice([i, i, None]), r.choice(["x", "y", None]), r.choice([1, None])) for i in range(900)]
    made = places.id_lists(spark.createDataFrame(rows, "_id int, a string, b int"), ["a", "b"], 32, 100).collect()
    assert sorted(((x._id, m.a, m.b) for m in made for x in m._ids), key=repr) == sorted(rows, key=repr)
    assert all(m._size == len(m._ids) <= 32 and (m._size % 8 == 0 or m._size < 8) for m in made)


@pytest.mark.parametrize("least", [0.0, 0.25, 0.35, 0.6, 2.0])
def test_historical_matches_equal_all_pairs_and_pairs_arent_grouped(spark, least):
    r = random.Random(2)
    p = [(i, r.choice([1, 2, 3, None]), r.choice([1, 2, None]), r.choice([1, 2, None])) for i in range(50)]
    c = [(i, r.choice([1, 2, 3, None]), r.choice([1, 2, 3, None]), r.choice([1, 2, None]), r.choice([1, 2, None]), r.choice(["x", "y", None])) for i in range(60)]
    features = {"place:ri": (F.col("ri") == F.col("c_ri"), 0.35), "place:eup": (F.col("eup") == F.col("c_eup"), 0.25), "city": (F.col("city") == F.col("municipality"), 0.2), "kind": (F.col("kind") == "x", 0.1)}
    projects, known = spark.createDataFrame([*p, p[0]], "p int, city int, ri int, eup int"), spark.createDataFrame([*c, c[3]], "c int, municipality int, place_city int, c_ri int, c_eup int, kind string")
    want = []
    for i, city, ri, eup in p:
        for j, m, q, c_ri, c_eup, kind in c:
            if city is not None and city in (m, q):
                place = 0.35 if ri is not None and ri == c_ri else 0.25 if eup is not None and eup == c_eup else 0
                score = round(place + 0.2 * (city == m) + 0.1 * (kind == "x"), 4)
                if score >= least:
                    want.append((i, j, score, "place:ri" if place == 0.35 else "place:eup" if place else "city" if city == m else "none"))
    for equal in ({}, {"place:ri": ("ri", "c_ri"), "place:eup": ("eup", "c_eup")}):
        made = intake.historical_matches(projects, known, "p", "c", "city", features, least, ["place:ri", "place:eup", "city"], 7, equal)
        assert sorted(map(tuple, made.collect())) == sorted(want)
        assert not re.search(r"keys=\[p#\d+, c#", plan(made))


def test_blind_sites_meet_their_area_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ranges, "PAIRS", 50)
    r = random.Random(3)
    some = lambda n: [(i, r.choice(["a", "b", None]), r.choice([34.5, None]), r.choice([126.5, 127.5, None])) for i in range(n)]
    a, b = some(80), some(60)
    made = permits.nearby_or_same_area(spark.createDataFrame(a, "s int, area string, lat double, lon double"), spark.createDataFrame(b, "p int, area string, lat double, lon double"), "s", "p", "area", 9000, unit=5)
    want = []
    for s, area, lat, lon in a:
        for p, other, y, x in b:
            if None not in (lat, lon, y, x):
                want += [(s, p, "measured")] if lon == x else []
            elif area is not None and area == other:
                want.append((s, p, "unknown"))
    assert sorted((x.s, x.p, x.distance_status) for x in made.collect()) == sorted(want)
    tasks = made.filter("distance_status = 'unknown'").groupBy("s", F.spark_partition_id().alias("task")).count().select("task").distinct().count()
    assert tasks > 8


def rows_of_tasks(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect())


def test_evidence_is_numbered_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(ranges, "TASK_ROWS", 60)
    r = random.Random(4)
    evidence = [(r.randrange(90), i, r.choice(["a", "b", None])) for i in range(600)]
    owners = {c: r.choice([1, 2, 3, None]) for c in range(80)}
    table = spark.createDataFrame(evidence, "case int, paragraph int, role string")
    made = cases.evidence_view(table, spark.createDataFrame(list(owners.items()), "case int, place int"), spark.createDataFrame([(1, "x"), (2, "y")], "place int, name string"), "case", "place", "role", ["a", "b"])
    assert made.columns == ["place", "case", "paragraph", "role", "name", "position"]
    want = []
    for c, owner in owners.items():
        mine = sorted((x for x in evidence if x[0] == c), key=lambda x: ({"a": 0, "b": 1}.get(x[2], 2), x[1]))
        want += [(owner, c, p, role, {1: "x", 2: "y"}.get(owner), i) for i, (_, p, role) in enumerate(mine, 1)]
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, want))
    assert rows_of_tasks(made) < 200


def test_prompt_parts_are_ordered_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(ranges, "TASK_ROWS", 60)
    quotes = [(i % 40, i % 80, i, "q" * 300 + str(i)) for i in range(800)]
    reasons = spark.createDataFrame([(i % 40, i, i, "r") for i in range(80)], "k int, reason int, place int, text string")
    other = reasons.drop("reason")
    made = pack.prompt_pack(reasons, spark.createDataFrame(quotes, "k int, reason int, place int, text string"), other, other, "k", "reason")
    got = sorted((x.reason, x.rank, x.text) for x in made.filter("part = 'quote'").collect())
    assert got == [(i, 1, "q" * 220) for i in range(80)]
    assert rows_of_tasks(made.filter("part = 'quote'")) < 40


def test_areas_meet_the_best_passages_of_their_names(spark):
    r = random.Random(3)
    texts = [(i, " ".join(r.choices(["aaa", "bbb", "xxx", "yyy", "zzz", "Aaa"], k=r.randint(0, 4))), r.randrange(5), r.randrange(-2, 7)) for i in range(400)]
    sites = [(i, r.choice(["aaa", "bbb", "nope", None]), r.choice(["xxx", "yyy", "aaa", None])) for i in range(12)]
    made = permits.link_by_area(spark.createDataFrame(sites, "p int, a string, s string"), spark.createDataFrame(texts, "d int, t string, day int, n int"), "p", "a", "s", "d", "t", "day", "n", per_permit=4)
    want = []
    for p, a, s in sites:
        scored = []
        for d, t, day, n in texts:
            kind, base = ("same_sub_area", 1.0) if s and s in t else ("same_area", 0.86) if a and a in t else ("general", 0.62)
            scored.append((-round(base + min(0.08, 0.02 * n), 4), day, d, kind))
        want += [(p, d, kind, -score, i + 1) for i, (score, _, d, kind) in enumerate(sorted(scored)[:4])]
    assert sorted(map(tuple, made.collect())) == sorted(want)
    read = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" not in read  # texts were met before the areas
