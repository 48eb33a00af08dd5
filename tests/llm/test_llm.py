"""The training-data operators against brute force, and their defined results for odd inputs."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

import verify
from tessella.llm import common, components, embed_dedup, exact, langid, mixing, ngram_join, packing, pii, quality, substring, tokencount
from tessella.llm import queries as registered

PIECES, BYTES = str(public_tokenizers.path("piece_bpe_32k.model")), str(public_tokenizers.path("byte_bpe_50k.json"))
SF = "/root/testdata/sf0.001"
ODD = [(None, None, None, None, 1), (1, "", "en", "a", 1), (2, "der Hund und die Katze", None, None, 1), (2, "der Hund und die Katze", None, None, 1), (3, "x" * 40_000, "de", "b", 2), (4, "   ", "en", "a", 3)]
SCHEMA = "doc_id long, text string, lang string, source string, row_id int"


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"v": F.lit(1), "size": F.lit(1), "h": F.lit("h"), "key": F.lit("k"), "t": F.lit("t")})


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_nulls_empty_long_and_clashing_names(spark, rows):
    d, n = docs(spark, rows), len(rows)
    model = langid.fit_languages(d)
    assert langid.predict_languages(d, model).count() == n
    assert langid.keep_identified(d, model).columns == d.columns
    assert tokencount.count_tokens(d, PIECES).count() == n
    assert exact.exact_groups(d).count() == n
    assert exact.drop_exact_duplicates(d).columns == d.columns
    assert mixing.mix_sources(d).count() == n
    assert mixing.take_mix(d).columns == d.columns
    assert substring.remove_repeats(d).count() == n
    assert quality.score_quality(d, quality.fit_quality(d, d.select("doc_id"))).count() == n
    assert pii.find_personal_data(d).count() == n
    assert ngram_join.near_duplicates(d).count() == n
    assert ngram_join.drop_near_duplicates(d).columns == d.columns
    packed = packing.pack_sequences(d, BYTES).agg(F.countDistinct("row_id").alias("k"), F.count("*").alias("n")).first()
    assert packed["n"] >= n


def test_values_of_null_empty_and_long_texts(spark):
    """Null, empty and blank texts of ODD (ids None, 1, 4), the sentence (2, twice) and the long word (3)."""
    d = docs(spark)
    sentence, blank, m = "der Hund und die Katze", (None, 1, 4), tokencount.PieceCounter(PIECES).model
    lang = {r.row_id: (r.lang_pred, r.score) for r in langid.predict_languages(d, langid.fit_languages(d)).collect()}
    assert all(lang[k] == ("und", 0) for k in blank) and lang[2][0] != "und"
    tokens = {r.row_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(d, PIECES).collect()}
    assert tokens[None] == tokens[1] == (0, 0, False) and tokens[2][1] == len(m.encode(sentence)) and tokens[3][:2] == (40_000, len(m.encode("x" * 40_000)))
    mixed = collections.defaultdict(set)
    for r in mixing.mix_sources(d).collect():
        mixed[r.doc_id].add(r.mix_size)
    assert mixed == {None: {0}, 1: {0}, 2: {5}, 3: {1}, 4: {0}}
    words = sorted((str(r.row_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(d).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert words == sorted([*((str(k), 0, 0, sha("")) for k in blank), *[("2", 5, 0, sha(sentence))] * 2, ("3", 1, 0, sha("x" * 40_000))])
    scores = {r.row_id: r.score for r in quality.score_quality(d, quality.fit_quality(d, d.select("doc_id"))).collect()}
    assert scores[None] == scores[1] == scores[4] and all(0 <= v <= 1 for v in scores.values())
    assert {sum(len(r[k]) for k in (*pii.PATTERNS, "term")) for r in pii.find_personal_data(d).collect()} == {0}
    pieces = collections.defaultdict(list)
    for r in packing.pack_sequences(d, BYTES).collect():
        pieces[r.row_id].append((r.start, r.length, r.doc_tokens))
    assert pieces[None] == pieces[1] == [(0, 1, 1)] and len(pieces[2]) == 2 and sum(n for _, n, _ in pieces[3]) == pieces[3][0][2]
    sizes = {r.row_id: r.n_shingles for r in ngram_join.near_duplicates(d).collect()}
    assert sizes == {None: 0, 1: 0, 2: 1, 3: 1, 4: 0}


def test_dropped_duplicates_leave_one_row_of_each_text(spark):
    d = docs(spark)
    rows = [(r.doc_id, r.text) for r in exact.drop_exact_duplicates(d).collect()]
    assert sorted(rows) == [(1, ""), (2, "der Hund und die Katze"), (3, "x" * 40_000), (4, "   ")]
    rows = [(r.doc_id, r.text) for r in ngram_join.drop_near_duplicates(d).collect()]
    assert sorted(rows, key=repr) == sorted([(None, None), (1, ""), (2, "der Hund und die Katze"), (3, "x" * 40_000), (4, "   ")], key=repr)


def test_dropped_duplicates_go_by_row_not_by_id(spark):
    rows = [(7, "a b c"), (7, "d e f"), (5, "d e f"), (None, "g h i"), (None, "g h i"), (7, "j k l"), (None, "j k l")]
    kept = [("None", "g h i"), ("5", "d e f"), ("7", "a b c"), ("7", "j k l")]
    for drop in (exact.drop_exact_duplicates, ngram_join.drop_near_duplicates):
        got = drop(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((str(r.doc_id), r.text) for r in got) == sorted(kept)


def test_release_deletes_scratch_tables_only(spark, tmp_path):
    spark.range(3).write.parquet(path := str(tmp_path / "kept"))
    mine, own = common.materialize(spark.range(5).groupBy("id").count(), "test"), spark.read.parquet(path)
    empty = common.materialize(spark.range(0), "test-empty")
    assert mine.count() == 5
    assert empty.count() == 0
    files = mine.inputFiles() + empty.inputFiles()
    common.release(mine, empty, own)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert own.count() == 3


def test_exact_groups_when_hashes_collide(spark):
    texts = ["a  b", "a b", "a\tb ", "c", None, "", "d d", "a b"]
    got = {r.row_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(frame(spark, texts), content_hash=lambda c: F.substring(F.md5(c), 1, 0)).collect()}
    plain = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    assert got == {i: (plain.index(p), plain.count(p), plain.index(p) == i, hashlib.sha256(p.encode()).hexdigest()) for i, p in enumerate(plain)}


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_against_sql(spark, name):
    assert verify.compare(spark, SF, name).startswith("same")


def test_mix_targets_and_limits(spark):
    random.seed(3)
    rows = [(i, "w " * random.randint(0, 60), "en", random.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(900)]
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.mix_copies for r in sorted(got, key=lambda r: r.doc_id)] == [r.mix_copies for r in sorted(mixing.mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect(), key=lambda r: r.doc_id)]
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    assert abs(sum(v[0].mix_target for v in by.values()) - sum(r.mix_size for r in got)) < 1e-6
    for v in by.values():
        assert v[0].mix_target <= 3 * v[0].mix_source_size and max(r.mix_copies for r in v) <= 3
        assert abs(sum(r.mix_copies * r.mix_size for r in v) - v[0].mix_target) <= 30


def test_very_many_sources_are_ordered_by_range(spark, monkeypatch):
    random.seed(4)
    rows = [(i, "w " * random.randint(0, 9), "en", random.choice([None, *map(str, range(150))]), 0) for i in range(700)]
    d = spark.createDataFrame(rows, SCHEMA)
    plain = sorted((r.doc_id, r.mix_target, r.mix_copies) for r in mixing.mix_sources(d).collect())
    monkeypatch.setattr(mixing, "ONE_TASK", 0)
    assert plain == sorted((r.doc_id, r.mix_target, r.mix_copies) for r in mixing.mix_sources(d).collect())


def test_spliced_counts_equal_whole_counts():
    small, random_ = tokencount.PieceCounter(PIECES, chunk=40, overlap=4), random.Random(2)
    for _ in range(400):
        s = "".join(random_.choice(["a", "é", " ", "  ", "\n", "🎉", "word", "of the", "ワ", "▁", "</s>"]) for _ in range(random_.randint(0, 120)))
        assert small.count(s) == len(small.model.encode(s)), repr(s)


def test_byte_ids_equal_the_tokenizers():
    e, random_ = packing.ByteEncoder(BYTES), random.Random(5)
    for _ in range(600):
        s = "".join(random_.choice(["a", "é", " ", "  ", "\n", "🎉", "word", "'s", "12", "\t", "\xa0", "<|endoftext|>", "of"]) for _ in range(random_.randint(0, 30)))
        assert np.frombuffer(e.encode([s])[0], "<u4").tolist() == e.exact.encode(s, add_special_tokens=False).ids, repr(s)


def test_hilbert_curve_moves_one_step():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert_key(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid))) and np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


def test_packing_round_trip(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    e, pieces, sequences = packing.ByteEncoder(BYTES), collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack_sequences(d, BYTES).collect():
        pieces[r.row_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for x in d.collect():
        ids, at = np.array([*e.exact.encode(x.text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(pieces[x.doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024


def brute_repeats(texts, window):
    words = [(t or "").encode().split() for t in texts]
    n = collections.Counter(tuple(w[j : j + window]) for w in words for j in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if n[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark):
    random.seed(3)
    base = [" ".join(random.choice("abcdefgh") for _ in range(random.randint(0, 60))) for _ in range(40)]
    texts = [random.choice(base) + random.choice([" ", "\n", "\t "]) + random.choice(base) for _ in range(90)] + [None, "a " * 100, "a " * 35, "a " * 34, ""]
    for window, gram in ((35, 8), (9, 4)):
        got = [(r.n_words, r.n_removed, r.kept_sha256) for r in sorted(substring.remove_repeats(frame(spark, texts), window, gram).collect(), key=lambda r: r.row_id)]
        assert got == brute_repeats(texts, window)


def test_long_documents_are_hashed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_WORDS", 50)
    words = [[b"%d" % (i % 60) for i in range(200)]]
    first = {k for block, _ in substring._blocks(words, 35, 8) for f, la, keys, _ in [block.runs(35)] for k in block.windows(f, la, keys, 35)[1].tolist()}
    monkeypatch.setattr(substring, "BLOCK_WORDS", 1 << 18)
    whole = {k for block, _ in substring._blocks(words, 35, 8) for f, la, keys, _ in [block.runs(35)] for k in block.windows(f, la, keys, 35)[1].tolist()}
    assert first == whole and len(whole) == 60


def brute_near(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


@pytest.mark.parametrize("costly", [8, 1])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, costly):
    if costly == 1:
        for k, v in {"COSTLY": 1, "LONGEST": 4, "MANY": 2, "BLOCKED": 2, "CHUNK": 7}.items():
            monkeypatch.setattr(ngram_join, k, v)
    random.seed(0)
    words = [f"w{i}" for i in range(300)]
    common_lines = [" ".join(random.choice(words) for _ in range(25)) for _ in range(2)]
    texts = [None, "", "A B", "a b", " a  b c"]
    for _ in range(40):
        w = [random.choice(words) for _ in range(random.randint(0, 100))]
        w = random.choice(common_lines).split() + w if random.random() < 0.6 else w
        for _ in range(random.choice([1, 1, 5])):
            v = list(w)
            for _ in range(random.choice([0, 1, 2, 3])):
                if v:
                    v[random.randrange(len(v))] = random.choice(words)
            texts.append(" ".join(v))
    got = sorted((r.row_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, texts), 4, 85).collect())
    assert got == brute_near(texts, 4, 85)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 201), (201, 200), (5, 5)], "a long, b long")
    assert {(r.v, r.component) for r in components.connected_components(links).collect()} == {(i, 0) for i in range(71)} | {(200, 200), (201, 200)}


@pytest.mark.parametrize(("rows", "block"), [(16_384, 1024), (40, 16)])
def test_embeddings_equal_brute_force(spark, monkeypatch, rows, block):
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", rows)
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", block)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((20, 8))
    made = [(i, [float(np.float32(x)) for x in base[rng.integers(20)] + rng.standard_normal(8) * 0.25], int(rng.integers(3))) for i in range(250)]
    made += [(600, None, 1), (601, [0.0] * 8, 1), (602, [float("nan")] + [1.0] * 7, 1), (603, [None] + [1.0] * 7, 1), (604, [1.0] * 8, None), (605, [1.0] * 3, 1), (606, [1.0] * 3, 1), (607, made[0][1], made[0][2])]
    root, n = {v: v for v, _, _ in made}, collections.Counter()
    good = [(v, np.array(e) / np.linalg.norm(e), k) for v, e, k in made if e and k is not None and None not in e and np.isfinite(e).all() and any(e)]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (v, x, k) in enumerate(good):
        for w, y, m in good[:i]:
            if k == m and len(x) == len(y) and x @ y >= 0.93:
                n[v] += 1
                n[w] += 1
                a, b = find(v), find(w)
                root[max(a, b)] = min(a, b)
    got = embed_dedup.near_embeddings(spark.createDataFrame(made, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.row_id, r.n_links, r.component_id, r.kept) for r in got) == sorted((v, n[v], find(v), find(v) == v) for v, _, _ in made)


def test_embeddings_of_odd_rows_and_sizes(spark):
    schema = "vec_id long, embedding array<double>, label string, row_id int, v int, key string"
    assert embed_dedup.near_embeddings(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1e200] * 4), (2, [2e200] * 4), (3, [1e-200, 0.0, 0.0, 0.0]), (4, [0.0, 1e-200, 0.0, 0.0]), (5, [1e-310] * 4), (5, [3.0] * 4), (None, [1.0] * 4), (6, None), (6, []), (7, [0.0] * 4)]
    got = embed_dedup.near_embeddings(spark.createDataFrame([(i, e, "a", 0, 0, "k") for i, e in rows], schema)).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = [(1, 4, 1, True), (2, 4, 1, False), (5, 4, 1, False), (5, 4, 1, False), (None, 4, 1, False), (3, 0, 3, True), (4, 0, 4, True), (6, 0, 6, True), (6, 0, 6, True), (7, 0, 7, True)]
    assert sorted(map(key, got)) == sorted(map(key, want))


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, match):
    d = re.sub("[^0-9]", "", match)
    luhn = sum((int(c) * (1 + i % 2) - 9 if int(c) * (1 + i % 2) > 9 else int(c) * (1 + i % 2)) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in match.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def test_base_spans_equal_plain_patterns(spark):
    random.seed(4)
    parts = ["a", "b.c", "@", "x.y", "1", "2", "300", "255", ".", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "é", "🎉", "\n", "1.2.3.4", "a@b.c", "+49 30 1234567", "%", "_", "00"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(500)] + [None, "", "9" * 30_000, "a@b.c " * 700]
    for r in pii.find_personal_data(frame(spark, texts)).collect():
        for kind, pattern in PLAIN.items():
            assert [(s.start, s.stop) for s in r[kind]] == [m.span() for m in re.finditer(pattern, texts[r.row_id] or "") if passes(kind, m.group())], (kind, texts[r.row_id])


def test_revealing_terms_are_found_and_generalised(spark):
    texts = [f"Kontakt zu Zebrafink bitte an bob@x.org {w} melden" for w in ("heute", "morgen", "dienstag")] + [f"ganz andere Worte {i} ueber melden und bitte kontakt" for i in range(600)]
    found = pii.find_personal_data(frame(spark, texts))
    assert {s.match for r in found.filter("size(term) > 0").collect() for s in r.term} == {"Zebrafink"}
    assert pii.sanitise(found.filter("row_id = 0")).first()["clean_text"] == "Kontakt zu [TERM] bitte an [EMAIL] heute melden"


@pytest.mark.parametrize(
    ("texts", "names"),
    [
        ([f"Zebrafink zu bob@x.org {w} melden" for w in ("heute", "morgen", "dienstag", "mittwoch") for _ in range(3)], {"Zebrafink"}),
        ([f"Zebrafink {'melden und bitte kontakt ' * 9} bob@x.org {w}" for w in ("heute", "morgen", "dienstag")], {"Zebrafink"}),
        ([f"Bo 김민 Kim zu bob@x.org {w} melden" for w in ("heute", "morgen", "dienstag")], {"Bo", "김민", "Kim"}),
    ],
    ids=["copies", "far", "short"],
)
def test_revealing_terms_of_copies_far_and_short(spark, texts, names):
    found = pii.find_personal_data(frame(spark, texts + [f"ganz andere Worte {i} ueber melden und bitte kontakt" for i in range(600)]))
    assert [{s.match for s in r.term} for r in found.filter(f"row_id < {len(texts)}").collect()] == [names] * len(texts)


def brute_terms(texts, support=3, share=0.5, bits=6.0, class_share=0.3, class_bits=2.0, sure=3.0):
    once = {}
    for t in texts:
        key = re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
        once[key] = min(once.get(key, t or ""), t or "")
    n_t, n_e, n_te = collections.Counter(), collections.Counter(), collections.Counter()
    word = regex.compile(r"[\p{L}\p{N}\p{M}]+")
    for t in once.values():
        found = {(k, m.group().lower()) for k, p in PLAIN.items() for m in re.finditer(p, t) if passes(k, m.group())}
        named = {("entity", m) for _, m in found} | {("class", k) for k, _ in found} | ({("class", "any")} if found else set())
        words = [w for w in word.findall(re.sub(PLAIN["email"], " ", t)) if regex.search(r"\p{L}", w)]
        terms = {w.lower() for w in words if len(w) > 2 or regex.fullmatch(r"[\p{Lo}\p{M}]+|\p{Lu}\p{L}", w)}
        n_t.update({w.lower() for w in words})
        n_e.update(named)
        n_te.update((w, e) for w in terms for e in named)
    out = set()
    for (w, e), k in n_te.items():
        n, p, z = n_t[w], k / n_t[w], sure * sure
        low = (p + z / (2 * n) - sure * np.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)
        limit, least, b = (p, share, bits) if e[0] == "entity" else (low, class_share, class_bits)
        if k >= support and limit >= least and np.log2(limit * len(once) / n_e[e]) >= b:
            out.add(w)
    return out


def test_revealing_terms_equal_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    texts += [f"Zebrafink {w} bob@x.org" for w in ("heute", "morgen", "dienstag")] + [f"konto77 {i} an a{i}@b{i}.de" for i in range(9)]
    texts += [f"İstanbulx {w} contact straße cafe\u0301x carol@y.org" for w in ("eins", "zwei", "drei", "vier", "fünf", "sechs")]
    texts += [" ".join([*(f"t{i}q{k if i % 2 else ''}" for i in range(1500)), *(f"m{i}@n.org" for i in range(400))]) for k in range(3)]
    got = {r.term for r in pii.revealing_terms(frame(spark, texts), 3, 0.5, 6.0).collect()}
    assert got == brute_terms(texts) and {"zebrafink", "konto77", "token", "i\u0307stanbulx", "straße", "cafe\u0301x", "t0q"} <= got and "t1q0" not in got
    found = {r.row_id: [r.text[s.start : s.stop] for s in r.term] for r in pii.find_personal_data(frame(spark, texts)).collect()}
    assert found[len(texts) - 4] == ["İstanbulx", "contact", "straße", "cafe\u0301x"]


def test_label_words_of_secrets_are_found(spark):
    folder = "/root/testdata/sf0.01"
    got = registered.op8_personal_data(spark, folder).filter("n_term > 0").select("doc_id").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    planted = {k for k, t in texts.items() if re.search(r"\btoken\b", t)}
    assert planted and planted == {r.doc_id for r in got}


def test_held_out_languages_and_quality(spark):
    folder = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = registered.op1_language_id(spark, folder).filter("held_out").join(d.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    scores = registered.op7_quality(spark, folder).filter("held_out").join(labels, "doc_id").collect()
    good, bad = [r.score for r in scores if r.quality == 1], [r.score for r in scores if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_a_text_of_two_languages_is_ambiguous(spark):
    rng = random.Random(8)
    say = lambda words: " ".join(rng.choice(words) for _ in range(40))
    german, english = ["der", "und", "nicht", "ich", "auch"], ["the", "of", "with", "this", "you"]
    model = langid.fit_languages(spark.createDataFrame([(say(german), "de") for _ in range(20)] + [(say(english), "en") for _ in range(20)], "text string, lang string"))
    margins = lambda t: model.margins(langid.letter_codes(t))
    a, b = margins(" ".join(german)), margins(" ".join(english))
    texts = [" ".join(german * 9), " ".join(english * 9)] + [" ".join(german * i + english * j) for i in range(1, 30) for j in range(1, 30)]
    got = {r.row_id: r for r in langid.predict_languages(frame(spark, texts), model).collect()}
    assert (got[0].lang_pred, got[0].ambiguous, got[1].lang_pred, got[1].ambiguous) == ("de", False, "en", False)
    assert a[0] * b[0] < 0 and any(r.ambiguous for r in got.values())
    kept = {r.doc_id for r in langid.keep_identified(frame(spark, texts), model).collect()}
    assert kept == {k for k, r in got.items() if not r.ambiguous}


def test_language_codes_keep_rows_apart():
    for n in (2, 3, 4, 5, 20):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n


def test_texts_without_letters_are_undetermined(spark):
    model = langid.fit_languages(spark.createDataFrame([("der und die", "de"), ("the and of", "en")], "text string, lang string"))
    rows = frame(spark, ["123 !", None, "", "the of"])
    assert [r.lang_pred for r in sorted(langid.predict_languages(rows, model).collect(), key=lambda r: r.row_id)] == ["und", "und", "und", "en"]


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    one, two, three, four, five = (f for _, f in corpus_pipeline.STAGES)
    a = common.materialize(one(spark, d, SF), "test")
    assert a.columns == d.columns and a.count() >= 0.98 * d.filter("text IS NOT NULL").count()
    b = common.materialize(two(spark, a, SF), "test")
    first = {}
    for r in sorted(a.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r.text or ""), r.doc_id)
    assert {r.doc_id for r in b.collect()} == set(first.values())
    c = common.materialize(three(spark, b, SF), "test")
    texts = sorted(b.collect(), key=lambda r: r.doc_id)
    assert {r.doc_id for r in c.collect()} == {texts[i].doc_id for i, _, k in brute_near([r.text for r in texts], 5, 80) if i == k}
    m = common.materialize(four(spark, c, SF), "test")
    copies = {r.doc_id: r.mix_copies for r in mixing.mix_sources(c).collect()}
    assert m.columns == d.columns and collections.Counter(r.doc_id for r in m.collect()) == {k: v for k, v in copies.items() if v}
    lengths = five(spark, m, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert {r.doc_id: r.n for r in lengths} == {r.doc_id: r.t * copies[r.doc_id] for r in lengths}
