"""Texts made to collide, and members that one large group shares with a few outsiders."""

import random

from pyspark.sql import functions as F

from tessella.llm import ngram_join, substring


def colliding_words():
    """Two words of 1,024 letters that every polynomial modulo 2^64 gives one value: Thue and Morse's sequence and its complement."""
    bits = [0]
    for _ in range(10):
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_defeat_polynomials_stay_apart(spark):
    one, other = colliding_words()
    rows = [(1, one), (2, other), (3, "same " + one), (4, "same " + other)]
    got = {r.row_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=4).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    before = " ".join(f"w{i}" for i in range(34))
    texts = spark.createDataFrame([(1, f"{before} {one}"), (2, f"{before} {other}")], "doc_id long, text string")
    assert [r.n_removed for r in substring.remove_repeats(texts).collect()] == [0, 0]
    many = {tuple(one[i : i + 8] for i in range(0, 1024, 8)), tuple(other[i : i + 8] for i in range(0, 1024, 8))}
    assert len({int(substring.folded_hashes(substring.word_hashes([w.encode() for w in words]), 60)[3]) for words in many}) == 2


def test_word_hashes_depend_on_whole_words_only():
    r = random.Random(1)
    words = [bytes(r.choices(b"abcd\xc3\x00", k=r.choice([1, 2, 7, 8, 9, 15, 16, 17, 255, 256, 257, 600]))) for _ in range(20_000)]
    known: dict[bytes, int] = {}
    for word, h in zip(words, substring.word_hashes(words).tolist(), strict=True):
        assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)
    assert [int(substring.word_hashes([w])[0]) for w in words[:50]] == [known[w] for w in words[:50]]
    assert len(substring.word_hashes([])) == 0


def test_a_large_group_is_not_squared_by_an_outsider(spark):
    """5,000 classes of one group share a member with one class of another: 5,000 pairs, not 12 million."""
    rows = spark.range(5001).select(F.col("id").alias("v"), F.lit(7).cast("bigint").alias("member"), F.when(F.col("id") < 5000, 0).otherwise(5000).cast("bigint").alias("component"), F.lit(100).cast("bigint").alias("n_shingles"))
    largest = ngram_join._largest(rows, "test-largest")
    assert [(r.all, r.largest) for r in largest.collect()] == [(5001, 0)]
    met = rows.join(largest, "member")
    assert ngram_join._pairs(met, ["v", "component", "n_shingles"], 80).count() == 5000
    # The side that a member's rows are joined from is that of the outsider alone.
    assert met.filter("component <> largest").count() == 1


def test_variants_and_outsiders_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCKED", 2)
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    r = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(50)]
    texts += [" ".join(base[:30] + [f"y{r.randrange(5)}" for _ in range(30)]) for _ in range(40)] + [" ".join(base[:20])] * 2 + [" ".join(base[10:])]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=3, percent=70).collect()
    assert {x.row_id: x.component_id for x in got} == dict(enumerate(root))
