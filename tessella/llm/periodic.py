"""Periodic runs of words, found by a sparse diagonal table that is filled from left to right.

Write words[i] = words[i - d] as a match on diagonal d. A run of period q and length n is a diagonal of n - q matches in a
row, so the table keeps for each word the lags at which diagonals are active and lengthens their matches; a diagonal that
ends long enough is a run.

The table stays sparse as a word isn't looked up by itself but with the words after it. For periods above g / 2 and up to
g, places are named by the sequence of g words that begins there, and of the earlier places of a name only the nearest one
is an active lag. That loses nothing: where a stretch of at least 3q words has the smallest period q <= g, a sequence of g
of its words can't recur at a smaller lag, since two periods d < q of g + d words would give a common divisor as a period
of the whole stretch (Fine and Wilf). For the same reason lags that aren't the smallest period are never active. So each
word has one active lag for each doubling of g, and a text of n words takes O(n log^2 n) steps, however often it repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: A run has at least this many words, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3


def _numbers(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def _doubled(names: np.ndarray, g: int) -> np.ndarray:
    """Names of sequences of 2g words from those of g words. Equal names stand for equal words, not for equal hashes."""
    if len(names) <= g:
        return names[:0]
    pairs = names[:-g] * (int(names.max()) + 1) + names[g:]
    return np.unique(pairs, return_inverse=True)[1].reshape(-1)


def _lags(names: np.ndarray) -> np.ndarray:
    """How far back the nearest earlier place of the same name is, 0 where there is none."""
    order = np.argsort(names, kind="stable")
    lags = np.zeros(len(names), dtype=np.int64)
    same = names[order[1:]] == names[order[:-1]]
    lags[order[1:]] = np.where(same, order[1:] - order[:-1], 0)
    return lags


def _ended(lags: np.ndarray, g: int, least: int, most: int, least_words: int, least_periods: int) -> Iterator[np.ndarray]:
    """Runs (start, length, period) of diagonals between the lags least and most, whose matches of g words end somewhere."""
    active = np.flatnonzero((lags >= least) & (lags <= most))
    if not len(active):
        return
    held = lags[active]
    begins = np.ones(len(active), dtype=bool)
    begins[1:] = (active[1:] != active[:-1] + 1) | (held[1:] != held[:-1])
    at = np.flatnonzero(begins)
    first, last, period = active[at], active[np.append(at[1:], len(active)) - 1], held[at]
    length = last - first + g + period
    enough = (length >= least_words) & (length >= least_periods * period)
    if enough.any():
        yield np.stack([first - period, length, period], axis=1)[enough]


def periodic_runs_of(numbers: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) by start, then period: stretches of at least least_words words and least_periods smallest periods.

    No neighbouring word extends a run keeping its period. least_words must be 4 or more, least_periods 3 or more.
    """
    if least_words < 4 or least_periods < 3:
        raise ValueError("runs have at least 4 words and 3 periods")
    n = len(numbers)
    # A run of period q has at least max(least_words - q, 2q) matches: the first sequences are as long as any period they serve and no longer than that.
    g = 1
    while 3 * 2 * g <= least_words:
        g *= 2
    names, size = numbers, 1
    while size < g:
        names, size = _doubled(names, size), size * 2
    found, least = [np.zeros((0, 3), dtype=np.int64)], 1
    while len(names) and least * least_periods <= n:
        lags = _lags(names)
        found += _ended(lags, g, least, g, least_words, least_periods)
        if not lags.any():
            break  # no sequence of g words recurs, so no longer one does
        names, least, g = _doubled(names, g), g + 1, g * 2
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def dropped_words(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    edges = np.bincount(runs[:, 0] + runs[:, 2], minlength=n + 1) - np.bincount(runs[:, 0] + runs[:, 1], minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def _found(least_words: int, least_periods: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_words": [], "runs": [], "n_dropped": [], "collapsed_sha256": []}
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()
                runs = periodic_runs_of(_numbers(words), least_words, least_periods)
                gone = dropped_words(runs, len(words)) if len(runs) else np.zeros(len(words), dtype=bool)
                kept = list(compress(words, (~gone).tolist())) if len(runs) else words
                out["n_words"].append(len(words))
                out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()])
                out["n_dropped"].append(len(words) - len(kept))
                out["collapsed_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, schema.field(k).type) for k, v in out.items())], schema=schema)

    return run


def find_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row_id, n_words, runs (start, length, period; by start, then period), n_dropped, collapsed_sha256.

    Words are maximal runs without white space, unchanged, numbered from 0. A run is a stretch of words with smallest period
    `period`, of at least least_words words and least_periods periods, that no neighbouring word extends keeping the period.
    collapsed_sha256 is of the words left, joined by spaces, once each run keeps its first period only. A null or empty text
    has no words and no runs. Ids may be null or repeat: each row is a document. An empty table gives no row. Other columns
    don't matter. No shuffle; a document is one task's work.
    """
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema(
        [
            pa.field("row_id", to_arrow_type(rows.schema["row_id"].dataType)), pa.field("n_words", pa.int64()), pa.field("runs", pa.list_(run)), pa.field("n_dropped", pa.int64()),
            pa.field("collapsed_sha256", pa.string()),
        ]
    )
    kind = rows.schema["row_id"].dataType.simpleString()
    out = f"row_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, n_dropped bigint, collapsed_sha256 string"
    return rows.mapInArrow(_found(least_words, least_periods, schema), out)
