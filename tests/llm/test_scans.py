"""Secret scans, hard negatives and periodic runs against brute force, and their defined results for odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import verify
from tessella.llm import hard_negatives, periodic, queries, secrets

SF = "/root/testdata/sf0.001"
ODD = [(None, None), (1, ""), (2, "der Hund und die Katze"), (2, "der Hund und die Katze"), (3, "x" * 300_000), (4, "   "), (5, "na " * 50_000), (6, "password: hunter22 " * 3)]
#: The base patterns, kind by kind, as plain expressions.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row_id", "spans", "runs", "n_words", "w", "h", "no", "label")})


def plain_spans(text):
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_base_secrets_equal_plain_patterns():
    r = random.Random(4)
    pieces = ["token", "Api_Key", "passwd", " ", '"', "'", ":", "=", "=", " = ", "abcdef12", "AKIA", "ABCDEFGHIJ1234567", "0123456789abcdef01234567", "é", "\n", "\xa0", ".", "x", "secret: ", 'PASSWORD="', "/", "ſ", "K", "api-key", "İ"]
    hits = 0
    for _ in range(20_000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 30)))
        assert secrets.base_spans(text) == plain_spans(text), repr(text)
        hits += len(plain_spans(text))
    assert hits > 10_000
    assert secrets.base_spans("token=token: abcdefgh") == []  # a failing match isn't tried again from within


def brute_model(samples):
    """Plain counts of characters after the two before, and the same chances written out."""
    alphabet = [None, *secrets.ALPHABET.decode()]
    counts = [collections.Counter(), collections.Counter()]
    for text, is_random in samples:
        said = [None, None, *(c if c in alphabet else None for c in re.sub(r"[^\x00-\x7f]", lambda m: "\x00" * len(m[0].encode()), text or ""))]
        for k in range(2, len(said)):
            counts[is_random][said[k - 2], said[k - 1], said[k]] += 1

    def chance(n, a, b, c):
        one, two, twos, ones, total = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter(), 0
        for (x, y, z), k in n.items():
            one[z] += k
            two[y, z] += k
            twos[x, y] += k
            ones[y] += k
            total += k
        p1 = (one[c] + 1) / (total + len(alphabet))
        p2 = (two[b, c] + secrets.BACKED * p1) / (ones[b] + secrets.BACKED)
        return (n[a, b, c] + secrets.BACKED * p2) / (twos[a, b] + secrets.BACKED)

    def score(s):
        said = [None, None, *s]
        return sum(math.log2(chance(counts[1], *said[k - 2 : k + 1])) - math.log2(chance(counts[0], *said[k - 2 : k + 1])) for k in range(2, len(said)))

    return score


def test_model_equals_brute_force(spark):
    r = random.Random(1)
    samples = [("the other one, thé-é and others", False), ("A1x9/_Zz 77q", True), (None, True), ("", False), ("".join(r.choices("ab1-", k=5000)), True), ("lost", None)]
    model = secrets.fit_secrets(spark.createDataFrame(samples, "text string, random boolean").repartition(3))
    score = brute_model([s for s in samples if s[1] is not None])
    for s in ("theother", "a1b-a1b1", "A1x9/_Zz", "Q", "zzzzzz"):
        assert model.score(s) == pytest.approx(score(s), abs=1e-3)
    nothing = secrets.fit_secrets(spark.createDataFrame([], "text string, random boolean"))
    assert nothing.score("anything-16chars") == 0


def test_random_strings_are_told_from_names(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model, r = secrets.fit_secrets(secrets.labelled_samples(d)), random.Random(9)
    spellings = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789ABCDEF"]
    planted = [(i, "r", f"le {''.join(r.choices(spellings[i % 3], k=24))} enon") for i in range(300)]
    words = [w for row in d.limit(60).collect() for w in (row.text or "").split() if w.isascii() and w.isalpha()]
    names = ["_".join(words[i : i + 4]) if i % 8 else "/".join(words[i : i + 4]) for i in range(0, 1200, 4)]
    rows = spark.createDataFrame(planted + [(1000 + i, "n", f"le {n} enon") for i, n in enumerate(names)], "doc_id long, what string, text string")
    found = {x.row_id: [(s.kind, x.text[s.start : s.stop]) for s in x.spans] for x in secrets.find_secrets(rows, model).collect()}
    assert sum(found[i] == [("random", t.split()[1])] for i, _, t in planted) >= 295
    assert sum(bool(found[1000 + i]) for i in range(len(names))) <= 3
    assert not any(s for i, s in found.items() if i >= 1000 and names[i - 1000].isalpha())


def test_secrets_query_equals_a_plain_scan(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = secrets.fit_secrets(secrets.labelled_samples(d))
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    for r in queries.op11_secrets(spark, SF).collect():
        text = texts[r.doc_id]
        base = plain_spans(text)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        more = []
        for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", text):
            beside = text[m.start() - 1 : m.start()] + text[m.end() : m.end() + 1]
            pairs = [m[0][k : k + 2] for k in range(min(64, len(m[0]) - 1))]
            if re.search("[A-Za-z]", m[0]) and not re.search(r"\w", beside) and len(set(pairs)) >= 0.6 * len(pairs) and model.score(m[0]) >= 40 and not any(a <= m.start() and m.end() <= b for _, a, b in base):
                more.append(("random", m.start(), m.end()))
        order = ["assign", "access", "hex", "random"]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(base + more, key=lambda s: (s[1], order.index(s[0]))))


def test_redacted_texts(spark):
    model = secrets.fit_secrets(spark.createDataFrame([], "text string, random boolean"))
    rows = [(1, "é token = " + "ab" * 20 + " end"), (2, None), (3, "none"), (4, "AKIA" + "Q" * 16 + "," + "0f" * 12)]
    got = {r.row_id: r.clean_text for r in secrets.redact(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), model)).collect()}
    assert got == {1: "é [ASSIGN] end", 2: None, 3: "none", 4: "[ACCESS],[HEX]"}


def test_secrets_of_odd_rows(spark):
    for rows in (ODD, []):
        d = docs(spark, rows)
        got = secrets.find_secrets(d, secrets.fit_secrets(secrets.labelled_samples(d))).collect()
        assert sorted((str(r.row_id), len(r.spans)) for r in got) == sorted((str(i), 3 if i == 6 else 0) for i, _ in rows)


def brute_negatives(rows, positives=5, negatives=5, percent=80):
    sound = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(v)) for v in x]) for i, x, label in rows if label is not None and x and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for at, (a, a_label, x) in enumerate(sound):
        if a is None or a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), (i is None, i or 0), label) for k, (i, label, y) in enumerate(sound) if k != at and len(x) == len(y)]
        for s, (_, p), _ in sorted(z for z in scored if z[2] == a_label)[:positives]:
            inside = sorted(z[:2] for z in scored if z[2] != a_label and percent * -s <= 100 * -z[0] <= 100 * -s)[:negatives]
            out += [(a, p, rank, n if not none else None, -s, -t) for rank, (t, (none, n)) in enumerate(inside, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, n=40, **more):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("row_id", "no", "width", "vector")}).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted((tuple(r) for r in hard_negatives.mine_hard_negatives(d, F.col("vec_id") % 100 == 0, label, **more).collect()), key=repr)


def test_residue_products_are_exact():
    r = np.random.default_rng(0)
    for high, width in ((160, 64), (3, 5), (1 << 20, 700), (1 << 24, 3000), (1 << 28, 17)):
        a, b = (r.integers(-high, high + 1, (n, width)).astype(float) for n in (13, 57))
        a[0], b[0], b[1] = high, -high, high
        bound = int(max((a * a).sum(1).max(), (b * b).sum(1).max()) * (1 + 1e-9)) + 1
        primes = hard_negatives.primes_for(bound)
        got = hard_negatives.reconstruct([hard_negatives.residue_product(hard_negatives.residues(a, p), hard_negatives.residues(b, p), p) for p in primes], primes, bound)
        assert (got.astype(object) == a.astype(np.int64).astype(object) @ b.T.astype(np.int64).astype(object)).all()
    assert len(hard_negatives.primes_for(hard_negatives.LARGEST_SCORE)) == len(hard_negatives.PRIMES)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 70), ("BLOCK_ANCHORS", 2), ("AT_ONCE", 1)):
        monkeypatch.setattr(hard_negatives, name, value)
    r = random.Random(5)
    rows = [(i, [r.choice([0.5, 0.25, -0.1, r.random()]) for _ in range(6)], r.randrange(3)) for i in range(320)]
    rows += [(100 + k, [0.5] * 6, 1) for k in range(60)] + [(200, [0.5] * 6, 2)] * 7 + [(None, [0.5] * 6, 1), (None, [0.4] * 6, 2)]
    rows += [(300 + k, [0.25, -1.0], 1 + k % 2) for k in range(9)]
    got = mined(spark, rows)
    assert got == brute_negatives(rows)
    assert len(got) > 100 and {g[2] for g in got} == {1, 2, 3, 4, 5}


def test_hard_negatives_of_odd_rows(spark):
    assert mined(spark, []) == []
    odd = [(0, None, 1), (100, [], 1), (200, [1.0, None], 1), (300, [1.0, float("nan")], 1), (400, [float("inf"), 1.0], 1), (500, [1.0, 1.0], None), (600, [0.0, 0.0], 1), (601, [0.0, 0.0], 1), (602, [0.0, 0.0], 2)]
    assert mined(spark, odd) == [(600, 601, 1, 602, 0, 0)] == brute_negatives(odd)
    wide = [(100 + i, [float(i % 3)] * 3000, i % 2) for i in range(12)]
    assert mined(spark, wide) == brute_negatives(wide)
    large = [(100 + i, [i * 1e5, 3.0, -i * 1e4], i % 2) for i in range(12)]
    assert mined(spark, large) == brute_negatives(large)
    with pytest.raises(ValueError, match="exceed"):
        mined(spark, [(100, [1e30], 1), (101, [1e30], 1)])


def brute_runs(words, least_words=24, least_periods=3):
    n, out = len(words), []
    for q in range(1, n // least_periods + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(least_words, least_periods * q):
                part = words[start : start + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((start, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_periodic_runs_equal_brute_force():
    r, hits = random.Random(1), 0
    for _ in range(2500):
        n, kinds = r.randint(0, 160), r.choice([1, 2, 2, 3, 5, 40])
        words = [r.randrange(kinds) for _ in range(n)]
        for _ in range(r.randint(0, 3) if n > 30 else 0):
            at, period = r.randrange(n - 20), r.randint(1, 40)
            for i in range(at + period, min(n, at + r.randint(20, 120))):
                words[i] = words[i - period]
        least = r.choice([24, 24, 4, 6, 12, 13, 30])
        got = [tuple(x) for x in periodic.periodic_runs_of(np.array(words, dtype=np.int64), least).tolist()]
        assert got == brute_runs(words, least)
        hits += len(got)
    assert hits > 1000


def test_repetitions_of_a_long_text_take_no_quadratic_time():
    for words, want in ((np.zeros(400_000, dtype=np.int64), [[0, 400_000, 1]]), (np.tile(np.arange(100_000), 4), [[0, 400_000, 100_000]])):
        assert periodic.periodic_runs_of(words).tolist() == want


def test_periodic_query_equals_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") < 4000)
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    repeated = {r.doc_id: r.text for r in queries.repeating_words(d).collect()}
    rows, runs_seen = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}, 0
    for i, text in texts.items():
        words, h = text.encode().split(), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        assert (repeated[i] or "").encode().split() == words
        runs = brute_runs(words)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        r = rows[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()
        runs_seen += len(runs)
    assert runs_seen > 5 and len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_periodic_runs_of_odd_rows(spark):
    empty = hashlib.sha256(b"").hexdigest()
    got = sorted((str(r.row_id), r.n_words, [tuple(x) for x in r.runs], r.n_dropped) for r in periodic.find_runs(docs(spark)).collect())
    assert got == sorted([("None", 0, [], 0), ("1", 0, [], 0), ("2", 5, [], 0), ("2", 5, [], 0), ("3", 1, [], 0), ("4", 0, [], 0), ("5", 50_000, [(0, 50_000, 1)], 49_999), ("6", 6, [], 0)])
    assert {r.collapsed_sha256 for r in periodic.find_runs(docs(spark, [(1, None), (2, "")])).collect()} == {empty}
    assert periodic.find_runs(docs(spark, [])).count() == 0
    assert queries.repeating_words(docs(spark)).count() == len(ODD)


def test_hard_negatives_against_sql(spark):
    assert verify.compare(spark, SF, "op12_hard_negatives").startswith("same")
