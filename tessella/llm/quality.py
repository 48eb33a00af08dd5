"""Quality scores by positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed features: pairs of neighbouring character classes, and words by their shape.
HASHED = 64
#: Documents of either kind (trusted, unlabelled) that the classifier is fitted on, those with the smallest id hashes.
MAX_FIT = 20_000


def _class_table() -> np.ndarray:
    """The class of each UTF-8 byte: lower-case, upper-case, digit, space, line feed, beyond ASCII, or itself as a sign."""
    t = np.zeros(256, dtype=np.int64)
    for b in range(256):
        c = chr(b)
        t[b] = 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 4 if c == "\n" else 3 if c in " \t\r\x0b\x0c" else 5 if b >= 128 else 6 + b
    return t


_CLASSES = _class_table()
STATISTICS = 20


def text_features(text: str) -> np.ndarray:
    """Shares and shapes of the whole text; zeros with a marker for an empty one."""
    out = np.zeros(STATISTICS + HASHED)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    out[0] = not words
    if not words:
        return out
    raw = np.frombuffer(data, dtype=np.uint8)
    kinds = np.zeros(134)
    pairs = np.zeros(HASHED)
    for at in range(0, len(raw), 1 << 18):
        k = _CLASSES[raw[at : at + (1 << 18) + 1]]
        kinds += np.bincount(k[: 1 << 18], minlength=134)
        pairs += np.bincount((k[:-1] * 31 + k[1:]) * 2_654_435_761 % 4_294_967_296 >> 26, minlength=HASHED)
    n = len(raw)
    letters = kinds[0] + kinds[1] + kinds[5]
    signs = kinds[6:].sum()
    lines = [x.strip() for x in data.split(b"\n")]
    lines = [x for x in lines if x]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    usual = sum(kinds[6 + ord(c)] for c in ".,;:'-?!()\"")
    out[1:STATISTICS] = (
        np.log1p(n) / 10, np.log1p(len(words)) / 10, kinds[1] / max(1, letters), kinds[2] / n, signs / n, (signs - usual) / n, kinds[3] / n,
        min(1.0, kinds[4] * 20 / n), letters / n, min(20.0, sizes.mean()) / 10, min(20.0, sizes.std()) / 10, len(set(words)) / len(words),
        len(set(lines)) / max(1, len(lines)), np.log1p(sizes.max()) / 5, (sizes <= 3).mean(), (kinds[6 + ord(".")] * 20 + 1) / (len(words) + 20),
        min(1.0, (signs - usual) * 2 / len(words)), min(1.0, kinds[6 + ord("|")] * 2 / len(words)), min(1.0, kinds[6 + ord("!")] * 2 / len(words)),
    )
    out[STATISTICS:] = np.sqrt(pairs / n)
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(x: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int, ridge: float) -> tuple[np.ndarray, float]:
    """Adam on a linear score; gradient gives the risk's derivative by each row's score."""
    w, m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        d = gradient(x @ w[:-1] + w[-1])
        g = np.append(x.T @ d + ridge * w[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.1) -> float:
    """The share of positives in unlabelled rows: the least ratio of tail shares over cuts that keep enough of both.

    Above a cut, unlabelled rows hold at least prior times the positives' share; for the best cut that bound is tight.
    """
    cuts = np.quantile(positive, np.linspace(0.02, 1 - least, 80))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    slack = np.sqrt(np.maximum(u * (1 - u), 1e-12) / max(1, len(unlabelled)))
    return float(np.clip(np.min((u + slack) / p), 0.05, 0.98))


def fit_positive_unlabelled(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, ridge: float = 1e-3) -> QualityModel:
    """Minimise prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) with the logistic loss.

    Where the second part is negative its gradient is turned, as in non-negative risk estimation. The prior is estimated
    from a first classifier that tells positive from unlabelled rows.
    """
    if not len(positive) or not len(unlabelled):
        width = STATISTICS + HASHED
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.5)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    x = np.clip((both - mean) / scale, -8, 8)
    n, is_p = len(positive), np.arange(len(both)) < len(positive)
    share_p, share_u = is_p / n, ~is_p / len(unlabelled)

    def apart(z: np.ndarray) -> np.ndarray:
        return 0.5 * (share_u * _sigmoid(z) - share_p * _sigmoid(-z))

    w, b = _descend(x, apart, steps // 2, ridge)
    first = x @ w + b
    prior = class_prior(first[is_p], first[~is_p])

    def risk(z: np.ndarray) -> np.ndarray:
        soft = np.logaddexp(0, z)
        negative = (share_u * soft).sum() - prior * (share_p * soft).sum()
        as_negative = (share_u - prior * share_p) * _sigmoid(z)
        return -as_negative if negative < 0 else -prior * share_p * _sigmoid(-z) + as_negative

    w, b = _descend(x, risk, steps, ridge)
    return QualityModel(mean, scale, w, b, prior)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_features(t.as_py() or "") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["trusted", "x"])


def fit_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fit: int = MAX_FIT) -> QualityModel:
    """Learn from the texts of trusted (ids of good documents) and from docs as unlabelled web text.

    Fitted on at most max_fit documents of either kind, chosen by hashed id; their feature vectors go to the driver.
    """
    order = F.xxhash64(F.col(id_col))
    rows = docs.filter(F.col(id_col).isNotNull())
    good = trusted.select(id_col).distinct().orderBy(order, id_col).limit(max_fit)
    other = rows.select(id_col).orderBy(order, id_col).limit(max_fit)
    x = {}
    for kind, ids in (("good", good), ("other", other)):
        chosen = rows.join(F.broadcast(ids), id_col, "left_semi").select(F.lit(True).alias("trusted"), F.col(text_col).alias("text"))
        got = chosen.mapInArrow(_features, "trusted boolean, x array<double>").toPandas()["x"]
        x[kind] = np.array(got.tolist()).reshape(-1, STATISTICS + HASHED)
        x[kind] = x[kind][np.lexsort(x[kind].T)]
    return fit_positive_unlabelled(x["good"], x["other"])


def _scored(model: QualityModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([text_features(t.as_py() or "") for t in batch.column(1)]).reshape(-1, STATISTICS + HASHED)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["row_id", "score"])

    return run


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row_id, score (0 to 1). Only the whole text decides; null texts count as empty and get a score too.

    Ids may be null or repeat; an empty table gives no row; other columns of docs don't matter. No shuffle.
    """
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scored(model), f"row_id {rows.schema['row_id'].dataType.simpleString()}, score double")
