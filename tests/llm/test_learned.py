"""Languages decoded and quality learned as plain loops do it."""

import collections
import math
import random

import numpy as np
import pytest

from tessella.llm import langid, quality

SAID = {"de": ["der", "und", "nicht", "ich", "für", "schön"], "en": ["the", "of", "with", "this", "you"], "fr": ["les", "été", "nous", "avec", "ça"], "es": ["los", "niño", "con", "para", "ésta"], "nl": ["het", "een", "zijn", "niet", "ook"], "xx": ["𐐨𐐩", "qq", "zyz"]}


def texts(n, seed):
    r = random.Random(seed)
    return [(lang, " ".join(r.choices(SAID[lang] + SAID["en"][:1], k=r.randint(1, 12))) + r.choice(["", "!", " 12", "  ,"])) for lang in r.choices(sorted(SAID), k=n)]


def plain_features(text):
    codes = [0]
    for c in text.lower():
        codes.append(ord(c) if c.isalpha() else 0)
    codes = [c for k, c in enumerate([*codes, 0]) if k == 0 or c or codes[k - 1]]
    if not any(codes):
        return []
    found = []
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            if n == 1 and not codes[i]:
                continue
            h = n
            for c in codes[i : i + n]:
                h = ((h ^ c) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
            found.append(h >> (32 - langid.FEATURE_BITS))
    return found


@pytest.mark.parametrize(("languages", "at_once"), [(["de", "en", "fr"], 1000), (sorted(SAID), 2)])
def test_languages_equal_plain_decoding(spark, monkeypatch, languages, at_once):
    monkeypatch.setattr(langid, "LANGUAGES", at_once)
    learned = [(lang, t) for lang, t in texts(200, 1) if lang in languages]
    model = langid.fit_languages(spark.createDataFrame([*learned, (None, "lost"), ("de", None)], "lang string, text string").repartition(3))
    size, code = 1 << langid.FEATURE_BITS, langid.codewords(len(languages)).tolist()
    assert model.languages == languages
    chance = []
    for lang in languages:
        n = collections.Counter(f for x, t in learned if x == lang for f in plain_features(t))
        total = sum(n.values()) + 0.5 * size
        chance.append({"seen": {f: (k + 0.5) / total for f, k in n.items()}, "none": 0.5 / total})
    of = lambda i, f: chance[i]["seen"].get(f, chance[i]["none"])
    bits = range(len(code[0]))

    def weight(f, b):
        sides = [[of(i, f) for i in range(len(languages)) if code[i][b] == s] for s in (1, -1)]
        up, down = (sum(x) / len(x) if x else 1 / size for x in sides)
        return math.log(up) - math.log(down)

    weights = {}
    trust = []
    unseen = [weight(-1, b) for b in bits]
    for b in bits:
        own = []
        for i in range(len(languages)):
            known = {f for c in chance for f in c["seen"]}
            for f in known:
                weights[f, b] = weight(f, b)
            own.append(code[i][b] * (sum(of(i, f) * weights[f, b] for f in known) + (size - len(known)) * chance[i]["none"] * unseen[b]))
        trust.append(max(0.05, min(own)))
    trust = [t / (sum(trust) / len(trust)) for t in trust]
    rows = [*texts(60, 2), ("und", ""), ("und", "12 !"), ("und", None)]
    got = {r.row_id: r for r in langid.predict_languages(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string"), model).collect()}
    for k, (_, text) in enumerate(rows):
        found = plain_features(text or "")
        if not found:
            assert (got[k].lang_pred, got[k].score) == ("und", 0)
            continue
        z = [sum(weights.get((f, b), unseen[b]) for f in found) / math.sqrt(len(found)) for b in bits]
        losses = [sum(t * math.log1p(math.exp(-max(-30, min(30, m)) * c)) for t, m, c in zip(trust, z, word, strict=True)) for word in code]
        like = [math.exp(min(losses) - x) for x in losses]
        assert got[k].lang_pred == languages[losses.index(min(losses))]
        assert got[k].score == pytest.approx(max(like) / sum(like), abs=1e-6)


def plain_risk(model, positive, unlabelled, ridge=1e-3):
    """prior R+(P) + max(0, R-(U) - prior R-(P)) with the logistic loss, and the ridge, written out."""
    soft = lambda v: math.log1p(math.exp(-abs(v))) + max(v, 0)
    z = lambda x: float(np.clip((x - model.mean) / model.scale, -8, 8) @ model.weights + model.bias)
    mean = lambda f, rows: sum(f(z(x)) for x in rows) / len(rows)
    return model.prior * mean(lambda v: soft(-v), positive) + max(0.0, mean(soft, unlabelled) - model.prior * mean(soft, positive)) + ridge / 2 * float(model.weights @ model.weights)


def test_quality_minimises_the_plain_risk():
    rng = np.random.default_rng(3)
    width = quality.STATISTICS + quality.HASHED
    good = rng.normal(0.6, 1, (150, width)) * (np.arange(width) < 6)
    bad = rng.normal(-0.6, 1, (240, width)) * (np.arange(width) < 6)
    unlabelled = np.concatenate([rng.normal(0.6, 1, (160, width)) * (np.arange(width) < 6), bad])
    model = quality.fit_positive_unlabelled(good, unlabelled)
    assert 0.25 < model.prior < 0.6
    least = plain_risk(model, good, unlabelled)
    for k in range(width + 1):
        for step in (-0.05, 0.05):
            moved = quality.QualityModel(model.mean, model.scale, model.weights + step * (np.arange(width) == k), model.bias + step * (k == width), model.prior)
            assert plain_risk(moved, good, unlabelled) > least - 2e-3
    nothing = quality.QualityModel(model.mean, model.scale, np.zeros(width), 0.0, model.prior)
    assert plain_risk(nothing, good, unlabelled) > least + 0.1
    assert (model.scores(good) > 0.5).mean() > 0.8 > 0.3 > (model.scores(bad) > 0.5).mean()
