"""Language identification by error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize, release

#: Hashed n-gram features (2**FEATURE_BITS each for orders 1 to 3 together) and bits of a codeword.
FEATURE_BITS, ORDERS = 14, (1, 2, 3)
#: Characters handled at once, texts decoded at once, languages whose counts a task or the driver holds at once.
BLOCK, PREDICTED, LANGUAGES = 1 << 18, 256, 1000
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point of the basic plane is a letter."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def letter_codes(text: str) -> np.ndarray:
    """Lower-cased code points, each run of other characters as one 0, with a 0 at both ends; no element if no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(codes):
        return codes
    table = _letters()
    letter = table[np.minimum(codes, 0xFFFF)] & (codes < 1 << 16)
    if (codes >> 16).any():
        letter |= np.isin(codes, [c for c in np.unique(codes[codes >= 1 << 16]) if chr(c).isalpha()])
    codes = np.concatenate(([0], np.where(letter, codes, 0), [0])).astype(np.uint32)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = codes[keep]
    return codes if len(codes) > 1 and codes.any() else codes[:0]


def features(codes: np.ndarray) -> np.ndarray:
    """Hashed n-grams of orders 1 to 3 that have a letter, one index for each."""
    found = []
    for n in ORDERS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, dtype=np.uint32)
            for i in range(n):
                h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            found.append((h >> np.uint32(32 - FEATURE_BITS))[codes[: len(h)] != 0] if n == 1 else h >> np.uint32(32 - FEATURE_BITS))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A +1/-1 row for each language: every split of up to four languages, random splits with distant rows beyond."""
    if languages <= 4:
        splits = [[1 if i == 0 or m >> (i - 1) & 1 else -1 for i in range(languages)] for m in range((1 << max(0, languages - 1)) - 1)]
        return np.array(splits or [[1] * languages], dtype=np.int8).T.reshape(languages, -1)
    bits, rng, best, most = max(15, int(np.ceil(6 * np.log2(languages)))), np.random.default_rng(seed), None, (-1, -1)
    for _ in range(40):
        code = np.where(rng.random((languages, bits)) < 0.5, 1, -1).astype(np.int8)
        agree = code.astype(int) @ code.T
        np.fill_diagonal(agree, -bits)
        split = int(np.min(np.minimum((code > 0).sum(0), (code < 0).sum(0))))
        if split and (-int(agree.max()), split) > most:
            best, most = code, (-int(agree.max()), split)
    return best if best is not None else code


@dataclass
class LanguageModel:
    """Languages, their codewords, a weight table (feature x bit) of the binary classifiers, and each bit's weight."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    ambiguity: float = 0.6

    def margins(self, codes: np.ndarray) -> np.ndarray:
        """Each bit's classifier output: log-odds summed over the whole text, scaled by the root of its n-grams."""
        total, n = np.zeros(self.weights.shape[1]), 0
        overlap = max(ORDERS) - 1
        for at in range(0, len(codes), BLOCK):
            block = codes[at : at + BLOCK + overlap]
            counts = np.bincount(features(block), minlength=1 << FEATURE_BITS)
            total += counts @ self.weights
            n += counts.sum()
        return total / np.sqrt(max(1, n))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss-weighted decoding: the language whose codeword has the least weighted logistic loss; its share; ambiguity."""
        z = np.clip(margins, -30, 30)
        losses = np.stack([(np.logaddexp(0, -z * c) * self.trust).sum(axis=1) for c in self.code], axis=1)
        like = np.exp(-(losses - losses.min(axis=1, keepdims=True)))
        share = like / like.sum(axis=1, keepdims=True)
        best = losses.argmin(axis=1)
        top = share[np.arange(len(best)), best]
        return best, top, top < self.ambiguity


def fit_languages(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """Learn from all rows with a language: n-gram counts per language over every whole text, summed by Spark.

    Each bit's classifier weighs an n-gram by its log-odds between the languages on the bit's two sides, each language
    counting alike. The counts are a table, of which the driver reads LANGUAGES languages at a time, twice: first for the
    sides of each bit, then for how well a bit separates the languages' own n-grams, its weight in decoding.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_count_features, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "language-counts")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    size = 1 << FEATURE_BITS
    if not languages:
        return LanguageModel([], np.zeros((0, 1)), np.zeros((size, 1), np.float64), np.ones(1))
    code = codewords(len(languages))

    def chances() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some languages' codewords and chances of each n-gram, until all have come."""
        for at in range(0, len(languages), LANGUAGES):
            some = languages[at : at + LANGUAGES]
            got = counts.filter(F.col("lang").between(some[0], some[-1])).toPandas()
            table = np.full((len(some), size), 0.5)
            table[got["lang"].map({x: i for i, x in enumerate(some)}).to_numpy(), got["feature"].to_numpy()] += got["n"].to_numpy()
            yield code[at : at + LANGUAGES], table / table.sum(axis=1, keepdims=True)

    sums = {s: np.zeros((size, code.shape[1])) for s in (1, -1)}
    for words, chance in chances():
        for s, total in sums.items():
            total += chance.T @ (words == s)
    number = {s: (code == s).sum(axis=0) for s in sums}
    sides = {s: np.where(number[s] > 0, sums[s] / np.maximum(1, number[s]), 1.0 / size) for s in sums}
    weights = np.log(sides[1]) - np.log(sides[-1])
    least = np.min([((chance @ weights) * words).min(axis=0) for words, chance in chances()], axis=0)
    release(counts)
    trust = np.clip(least, 0.05, None)
    return LanguageModel(languages, code, weights, trust / trust.mean())


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the task for each language: at most LANGUAGES tables of 2**FEATURE_BITS counts are held."""
    sums: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, n in sums.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64())], ["lang", "feature", "n"])
        sums.clear()

    overlap = max(ORDERS) - 1
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            codes = letter_codes(text.as_py())
            n = sums.setdefault(lang, np.zeros(1 << FEATURE_BITS, dtype=np.int64))
            for at in range(0, len(codes), BLOCK):
                n += np.bincount(features(codes[at : at + BLOCK + overlap]), minlength=1 << FEATURE_BITS)
        if len(sums) > LANGUAGES:
            yield from rows()
    yield from rows()


def _predictions(model: LanguageModel, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Each text's language, its share, and whether it is ambiguous or undetermined."""
    n = len(texts)
    known, margins = np.zeros(n, dtype=bool), np.zeros((n, model.weights.shape[1]))
    for i, text in enumerate(texts):
        codes = letter_codes(text.as_py() or "")
        if len(codes) and model.languages:
            known[i], margins[i] = True, model.margins(codes)
    lang, share, unsure = [UNDETERMINED] * n, np.zeros(n), np.ones(n, dtype=bool)
    if known.any():
        best, share[known], unsure[known] = model.decode(margins[known])
        for i, b in zip(np.flatnonzero(known), best, strict=True):
            lang[i] = model.languages[b]
    return lang, share, unsure


def _predicted(model: LanguageModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PREDICTED):
                part = batch.slice(at, PREDICTED)
                lang, share, unsure = _predictions(model, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(share), pa.array(unsure)], ["row_id", "lang_pred", "score", "ambiguous"])

    return run


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row_id, lang_pred, score (0 to 1), ambiguous. The whole text decides, and nothing else does.

    A text that is null or has no letter is `und` with score 0, as all are if no language was learned. Ids may be null or
    repeat; an empty table gives no row; other columns of docs don't matter. No shuffle.
    """
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.mapInArrow(_predicted(model), f"row_id {kind}, lang_pred string, score double, ambiguous boolean")


def _identified(model: LanguageModel, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows, by PREDICTED at a time, whose text in column `at` is identified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, PREDICTED):
                part = batch.slice(first, PREDICTED)
                yield part.filter(pa.array(~_predictions(model, part.column(at))[2]))
        pa.default_memory_pool().release_unused()

    return run


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose whole text has a language that is neither undetermined nor ambiguous.

    Rows are filtered where they stand: nothing is joined or shuffled, so null or repeated ids don't matter. If no language
    was learned, no row is identified. An empty table stays empty.
    """
    return docs.mapInArrow(_identified(model, docs.columns.index(text_col)), docs.schema)
