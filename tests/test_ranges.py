"""Ranks, sums, order statistics, seats, joins and searches that no task does for all rows, against plain Python."""

import math
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tessella.operators import cases, episodes, permits, ranges, search, text_index, text_jobs


def test_running_ranks(spark):
    r = random.Random(1)
    rows = [(r.randrange(50), i) for i in range(2000)]
    made = ranges.running_rank(spark.createDataFrame(rows, "n int, k int").repartition(5), [F.desc("n"), "k"])
    assert {(x.n, x.k): x["rank"] for x in made.collect()} == {row: i for i, row in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])), 1)}
    assert ranges.running_rank(spark.createDataFrame([], "n int, k int"), ["n"]).count() == 0
    plan = ranges.running_rank(spark.createDataFrame(rows, "n int, k int"), ["n", "k"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0]


@pytest.mark.parametrize("parts", [4, 4096])
def test_nearest_ranks_equal_sorted_lists(spark, parts):
    r = random.Random(2)
    rows = [("a", r.lognormvariate(0, 3)) for _ in range(900)] + [("b", float(r.randrange(7))) for _ in range(300)] + [("c", 5.0)] * 40 + [("d", 1.5), ("e", -2.0), ("e", 1e300), ("e", 3.0), ("e", -1e-300)]
    values = spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").agg(F.count("*").alias("n"))
    fractions = {"p10": 0.1, "median": 0.5, "p90": 0.9, "low": 0.0, "high": 1.0}
    got = {x.k: (x.sample_size, *(x[f] for f in fractions)) for x in ranges.nearest_ranks(values, ["k"], "v", "n", fractions, parts).collect()}
    for k in "abcde":
        mine = sorted(v for g, v in rows if g == k)
        assert got[k] == (len(mine), *(mine[round(f * (len(mine) - 1))] for f in fractions.values())), k


def greedy_seats(groups, target):
    groups = {k: n for k, n in groups.items() if n > 0}
    target = min(target, sum(groups.values()))
    if target <= len(groups):
        return {k: 1 for k in sorted(groups)[:target]}
    seats = dict.fromkeys(groups, 1)
    for _ in range(target - len(groups)):
        k = max((g for g in groups if seats[g] < groups[g]), key=lambda g: (groups[g] / (seats[g] + 1), groups[g] - seats[g], g))
        seats[k] += 1
    return seats


def test_seats_equal_seats_in_turn(spark):
    r = random.Random(3)
    for sizes in ([r.randint(0, 40) for _ in range(30)], [7] * 12, [900, 1, 1, 2, 3], [1] * 5, [2, 1_000_000, 3]):
        groups = {f"g{i:02}": n for i, n in enumerate(sizes)}
        for target in (0, 3, len(sizes), len(sizes) + 4, 61, 200):
            made = permits.proportional_seats(spark.createDataFrame(list(groups.items()), "name string, n long"), "name", "n", target)
            assert {x.name: x.seats for x in made.collect()} == greedy_seats(groups, target), (sizes, target)


@pytest.fixture
def no_coalescing(spark):
    """Range partitions stay as they are, however small: documents spread over all of them."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_one_document_over_many_tasks(spark, no_coalescing):
    r = random.Random(4)
    rows = [(d, i, r.randrange(3), r.randrange(4), int(r.random() < 0.1)) for d, n in ((None, 30), ("a", 400), ("b", 1), ("c", 250), ("d", 12)) for i in range(n)]
    rows = [(d, i * 2 + r.randrange(3), a, e, b) for d, i, a, e, b in rows]
    rows = [(d, p, i, a, e, b) for i, (d, p, a, e, b) in enumerate(rows)]
    signals = spark.createDataFrame(rows, "doc string, paragraph long, k int, agenda int, entity int, brk int").repartition(6)
    order = ["paragraph", "k"]

    def made(most):
        counted = episodes.break_counts(signals, "doc", "k", F.col("brk") == 1, most)
        got = episodes.episodes(counted, "doc", order, "paragraph", F.col("agenda"), F.array("agenda"), F.array("entity"), breaks_upto=F.col("breaks_upto"), most=most)
        return sorted((str(x.doc), x.paragraph, x.k, x.breaks_upto, x.link_score, x.episode) for x in got.collect())

    whole, cut = made(10**6), made(10)
    assert whole == cut
    for d in (None, "a", "c"):
        mine = sorted((k, b) for doc, p, k, a, e, b in rows if doc == d)
        assert [x[3] for x in sorted((x for x in whole if x[0] == str(d)), key=lambda x: x[2])] == list(accumulate(b for _, b in mine))
    assert len({x[5] for x in whole if x[0] == "a"}) > 5
    sorted_rows = ranges.Stretches(signals.filter("doc = 'a'"), "doc", order).rows
    assert sorted_rows.select("_part").distinct().count() > 1


def test_offsets_of_long_documents(spark, no_coalescing):
    r = random.Random(9)
    rows = [(d, i, "x" * r.randrange(5)) for d, n in (("a", 300), ("b", 3), ("c", 90)) for i in range(n)]
    parts = spark.createDataFrame(rows, "doc string, i int, t string").repartition(4)
    got = [sorted(map(tuple, text_jobs.running_offsets(parts, ["doc"], ["i"], "t", most=most).select("doc", "i", "char_start", "char_end").collect())) for most in (10, 10**6)]
    want, at = [], {}
    for d, i, t in rows:
        want.append((d, i, at.get(d, 0), at.get(d, 0) + len(t)))
        at[d] = at.get(d, 0) + len(t) + 1
    assert got[0] == got[1] == sorted(want)


def distance(a, b):
    (p, x), (q, y) = ((math.radians(v) for v in z) for z in (a, b))
    s = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2
    return 2 * permits.EARTH * math.asin(min(1.0, math.sqrt(s)))


@pytest.mark.parametrize(("radius", "unit"), [(20_000, 20_000), (20_000, 50), (900_000, 40), (12_000_000, 30)])
def test_radius_join_equals_all_pairs_anywhere(spark, radius, unit):
    r = random.Random(radius + unit)
    n = 250 if radius < 10**6 else 60
    points = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(n)] + [(80 + r.uniform(-0.2, 0.2), 10 + r.uniform(-1, 1)) for _ in range(30)]
    points += [(r.uniform(-1, 1), r.choice([-180, 180]) + r.uniform(-0.1, 0.1)) for _ in range(40)] + [(r.choice([-90, 90]) * (1 - r.random() / 1000), r.uniform(-180, 180)) for _ in range(30)]
    points += [(35.0 + r.uniform(0, 0.01), 127.0) for _ in range(60)] + [(90.0, 0.0), (-90.0, 77.0), (0.0, 180.0), (0.0, -180.0), (10.0, 540.0)]
    rows = [(i, *p) for i, p in enumerate(points)]
    table = spark.createDataFrame([*rows, (9001, None, 1.0), (9002, 1.0, None), (9003, 95.0, 1.0), (9004, float("nan"), 0.0)], "k int, lat double, lon double")
    got = {(x.k, x.r_k) for x in permits.radius_join(table.filter("k % 2 = 0"), table, radius, unit=unit).select("k", "r_k").collect()}
    want = {(i, j) for i, *a in rows[::2] for j, *b in rows if distance(a, b) <= radius}
    near = {(i, j) for i, *a in rows[::2] for j, *b in rows if abs(distance(a, b) - radius) < 1e-3}
    assert got - near == want - near
    assert len(want) > 100


def test_pairs_that_were_lost_before(spark):
    a = spark.createDataFrame([(1, 0.0, 179.999), (2, 80.0, 0.0)], "k int, lat double, lon double")
    b = spark.createDataFrame([(3, 0.0, -179.999), (4, 80.0, 0.9)], "k int, lat double, lon double")
    assert sorted((x.k, x.r_k) for x in permits.radius_join(a, b, 20_000).collect()) == [(1, 3), (2, 4)]


@pytest.mark.parametrize("unit", [3, 20_000])
def test_unit_join_is_an_inner_join(spark, unit):
    r = random.Random(5)
    left = spark.createDataFrame([(r.choice([1, 1, 1, 2, 3, None]), i) for i in range(80)], "k int, a int")
    right = spark.createDataFrame([(r.choice([1, 1, 2, 4, None]), i) for i in range(60)], "k int, b int")
    made = sorted(map(tuple, ranges.unit_join(left, right, ["k"], unit).select("k", "a", "b").collect()))
    assert made == sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))


@pytest.mark.parametrize("low", [0.0, 0.3, 0.5, 0.95, 2.0])
def test_weighted_pairs_equal_all_pairs_of_blocks(spark, low):
    r = random.Random(6)
    rows = [(i, r.choice(["x", "y", None]), r.choice([1, 2, None]), r.randrange(3), r.sample(range(6), r.randint(0, 3))) for i in range(90)]
    table = spark.createDataFrame(rows, "id int, block string, size int, kind int, tags array<int>")
    features = {"size": (F.col("size"), 0.45), "kind": (F.col("kind"), 0.2), "tags": (F.col("tags"), 0.31)}
    got = sorted((x.left, x.right, x.score) for x in cases.weighted_pairs(table, "id", "block", features, low, 1.1, unit=7).collect())
    want = []
    for i, b, s, k, t in rows:
        for j, c, u, m, v in rows:
            score = round((0.45 if s is not None and s == u else 0) + (0.2 if k == m else 0) + (0.31 if set(t) & set(v) else 0), 4)
            if i < j and b is not None and b == c and low <= score < 1.1:
                want.append((i, j, score))
    assert got == sorted(want)


def test_a_large_block_makes_only_pairs_that_score(spark):
    rows = spark.range(20_000).select(F.col("id"), F.lit("one").alias("block"), F.col("id").alias("size"), (F.col("id") % 10_000).alias("digit"))
    got = cases.weighted_pairs(rows, "id", "block", {"size": (F.col("size"), 0.45), "digit": (F.col("digit"), 0.4)}, 0.35, 0.8)
    assert got.count() == 10_000


def test_an_index_kept_by_batches(spark, tmp_path):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcé1", k=r.randint(1, 5)))
    texts = {i: " ".join(word() for _ in range(r.randint(0, 8))) for i in range(120)}
    table = lambda some: spark.createDataFrame(sorted(some.items()), "k long, t string")
    index = text_index.create_index(table({**texts, 200: None}), str(tmp_path / "index"), "k", "t", buckets=3)
    newer = {5: "replaced wholly", 7: "", 300: "A new Text ab1"}
    text_index.add_texts(index, table(newer), "k", "t")
    texts |= newer
    terms = [(i % 4, t) for i, t in enumerate(["a", "AB", "abc", "é1", "new text", "wholly", "b c", "zz", "", "...", None, "1", "cab"])]
    again = text_index.open_index(spark, str(tmp_path / "index"), 3, "bigint")
    for x in (index, again):
        got = sorted(map(tuple, text_index.index_hits(x, spark.createDataFrame(terms, "request_id int, term string"), table(texts), "k", "t").collect()))
        assert got == sorted({(q, t.lower(), k) for q, t in terms if t and any(c.isalnum() for c in t) for k, s in texts.items() if t.lower() in s.lower()})
    counts = {}
    for s in texts.values():
        for w in set("".join(c if c.isalnum() else " " for c in s.lower()).split()):
            counts[w] = counts.get(w, 0) + 1
    assert {x.token: x.texts for x in index.frequencies().collect()} == counts
    plan = text_index.index_hits(index, spark.createDataFrame(terms, "request_id int, term string"), table(texts), "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


@pytest.mark.parametrize("ahead", [1, 8])
def test_search_by_bounds_equals_scoring_all(spark, ahead):
    r = random.Random(8)
    rows = [(i, " ".join(r.choices(["alpha", "beta", "gamma", "delta", "keit"], k=r.randint(0, 4))), f"s{r.randrange(6)}", r.randrange(900)) for i in range(150)]
    segments = spark.createDataFrame(rows, "k long, t string, src string, days int").withColumn("day", F.expr("date_add(DATE '2020-01-01', days)"))
    requests = spark.createDataFrame([(1, ["alpha", "beta"]), (2, ["gamma"]), (3, ["none"]), (4, ["delta", "alp", "gam"])], "request_id int, terms array<string>")
    args = {"requests": requests, "segments": segments, "key": "k", "text_col": "t", "date": "day", "as_of": F.to_date(F.lit("2024-01-01")), "spatial": F.lit(0.0), "source": F.lit(1.0), "eligible": F.col("t").contains("keit") | (F.col("request_id") != 2)}
    got = search.search(**args, meeting=["src"], limit=3, ahead=ahead)
    every = search.scored_passages(**args)
    want = search.diversified(every, "request_id", "text_key", ["src"], [F.desc("score"), F.col("k")], 3).select("request_id", "k", "hits", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 6


def test_hits_of_many_terms_and_an_unsorted_index(spark, tmp_path):
    texts = {i: " ".join(f"w{n:03d}x" for n in range(i, 150, 7)) + " w001xw002x" for i in range(20)}
    segments = spark.createDataFrame(sorted(texts.items()), "k long, t string")
    wanted = {1: [f"w{n:03d}" for n in range(140)] + ["W001", "w001x"], 2: ["w003", "w00"], 3: []}
    requests = spark.createDataFrame(sorted(wanted.items()), "request_id int, terms array<string>")
    index = text_index.create_index(segments, str(tmp_path / "index"), "k", "t", buckets=3)
    want = sorted((q, k, n) for q, terms in wanted.items() for k, t in texts.items() if (n := sum(x in t for x in {x.lower() for x in terms})))
    made = search._hits(requests, segments, "k", "t", index)
    assert sorted(map(tuple, made.collect())) == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "collect_set" not in plan and "Sort [token" not in plan
