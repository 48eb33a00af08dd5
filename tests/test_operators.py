import math
import random

from pyspark.sql import functions as F

from tessella.operators import cases, episodes, pack, permits, rules, search


def test_seats_equal_turn_by_turn_allocation(spark):
    random.seed(8)
    for target in (3, 20, 57, 500):
        sizes = {f"g{i:02d}": random.randint(1, 15) for i in range(12)}
        got = {r["name"]: r["seats"] for r in permits.proportional_seats(spark.createDataFrame(list(sizes.items()), "name string, n long"), "name", "n", target).collect()}
        left = min(target, sum(sizes.values()))
        want = {g: 1 for g in sorted(sizes)[:left]}
        left -= len(want)
        while left:
            g = max((g for g in want if want[g] < sizes[g]), key=lambda g: (sizes[g] / (want[g] + 1), sizes[g] - want[g], g))
            want[g] += 1
            left -= 1
        assert got == want


def test_even_selection(spark):
    rows = spark.createDataFrame([("a", i) for i in range(23)], "g string, i int")
    seats = spark.createDataFrame([("a", 3)], "g string, seats long")
    want = sorted({round(i * 22 / 5) for i in range(6)})[:3]
    assert sorted(r.i for r in permits.evenly_selected(rows, "g", ["i"], seats).collect()) == want


def test_radius_join_equals_all_pairs(spark):
    random.seed(4)
    a = [(i, random.uniform(34, 35), random.uniform(126, 127)) for i in range(60)]
    b = [(i, random.uniform(34, 35), random.uniform(126, 127)) for i in range(60)]

    def metres(p, q):
        x = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(x))

    schema = "id int, lat double, lon double"
    for radius in (150.0, 9000.0):
        got = {(r.id, r.r_id) for r in permits.radius_join(spark.createDataFrame(a, schema), spark.createDataFrame([*b, (99, None, 126.5)], schema), radius).collect()}
        assert got == {(p[0], q[0]) for p in a for q in b if metres(p, q) <= radius}


def test_episodes_join_neighbours_and_break(spark):
    rows = [("d", 1, 0, "x", "e"), ("d", 2, 0, "x", "e"), ("d", 3, 1, "x", "e"), ("d", 20, 1, "x", "e")]
    df = spark.createDataFrame(rows, "d string, p int, b int, i string, e string")
    got = episodes.episodes(df, "d", ["p"], "p", F.lit(1), F.array("i"), F.array("e"), breaks_upto=F.col("b")).orderBy("p").collect()
    assert [r.episode for r in got] == [1, 1, 2, 3] and got[1].link_score == 1.0


def test_facility_alone_is_no_identity(spark):
    df = spark.createDataFrame([(1, None, None), (2, "삼호읍", None)], "e int, place string, project string")
    assert [r.k for r in df.select(cases.case_key(F.col("place"), F.col("project"), F.col("e")).alias("k")).collect()] == ["episode:1", "place:삼호읍"]


def test_cap_passes_beyond_and_is_open_within(spark):
    df = spark.createDataFrame([(250.0,), (150.0,), (None,)], "x double")
    assert [r.s for r in df.select(rules.cap_status(F.col("x"), F.lit(200.0)).alias("s")).collect()] == ["pass", "check_required", "check_required"]
    assert [r.s for r in df.select(rules.rule_status(rules.operator_result(F.lit("gte"), F.col("x"), F.lit(200.0))).alias("s")).collect()] == ["pass", "fail", "check_required"]


def test_grounding_audit(spark):
    df = spark.createDataFrame([(1, "1,234명과 35% 그리고 99", ["E1", "E9"], ["E1"], ["1234", "0.35", "case-2024-99x", "http://x/99"], ["도로 3개"])], "k int, prose string, cited array<string>, ok array<string>, facts array<string>, seen array<string>")
    r = pack.audit_answers(df, "k", "prose", "cited", "ok", "facts", "seen").first()
    assert (r.unknown_citations, r.unverified_numbers, r.digits_in_observations, r.grounded) == (["E9"], ["99"], True, False)


def test_diversified_equals_one_pass(spark):
    random.seed(6)
    rows = [(1, i, random.choice(["a", "b", "c", ""]), random.choice("mno"), random.random()) for i in range(40)]
    df = spark.createDataFrame(rows, "r int, i int, t string, m string, s double")
    df = df.withColumn("t", search.text_key(F.col("t")))
    got = [x.i for x in search.diversified(df, "r", "t", ["m"], [F.desc("s"), F.col("i")], 10).orderBy("rank").collect()]
    texts, meetings, want = set(), set(), []
    for _, i, t, m, _ in sorted(rows, key=lambda x: (-x[4], x[1])):
        if t and t in texts:
            continue
        texts.add(t)
        if m in meetings:
            continue
        meetings.add(m)
        want.append(i)
    assert got == want[:10]


def test_term_hits_equal_containment(spark):
    random.seed(9)
    word = lambda: "".join(random.choice("abcé") for _ in range(random.randint(1, 5)))
    texts = [None, "", "...", "1 2"] + [" ".join(word().capitalize() if random.random() < 0.2 else word() for _ in range(random.randint(1, 8))) for _ in range(60)]
    terms = [None, "", "!", "a", "ab"] + [word() for _ in range(40)] + [f"{word()} {word()}" for _ in range(20)] + ["B, a", "ab"]
    segments = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = search.term_hits(segments, spark.createDataFrame([(i % 3, t) for i, t in enumerate(terms)], "request_id int, term string"), "k", "t")
    wanted = {(i % 3, t.lower(), k) for i, t in enumerate(terms) if t and any(c.isalpha() for c in t) for k, x in enumerate(texts) if x and t.lower() in x.lower()}
    rows = [tuple(r) for r in got.select("request_id", "term", "k").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == wanted


def test_layers_and_candidates_without_a_match(spark):
    orders = spark.createDataFrame([(1, ["AF"]), (2, None), (3, []), (4, ["RX", None])], "k int, names array<string>")
    got = {(r.k, r.check): r.status for r in rules.layer_checks(orders, "k", "names", {"farmland": ["^R"], "forest": ["AF"]}).collect()}
    assert got == {(1, "farmland"): "pass", (1, "forest"): "fail", (2, "farmland"): "check_required", (2, "forest"): "check_required", (3, "farmland"): "check_required", (3, "forest"): "check_required", (4, "farmland"): "fail", (4, "forest"): "pass"}
