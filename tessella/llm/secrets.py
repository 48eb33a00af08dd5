"""Secret scans: exact patterns, and strings that a Markov model of random strings explains better than one of ordinary text.

Both models give each character by the two before it. They are trained from labelled samples: texts of ordinary words and
identifiers, and random strings. labelled_samples draws both from a corpus: its texts without what the patterns found, and
names made of their words, are ordinary; what the patterns found, and digests of its texts in the usual spellings, are random. Counts are sums over all
samples, added up by Spark; the models have a fixed size, whatever the corpus.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Patterns of the base kinds, in the order of results; letters of `assign` before the value stand in either case. What a
#: match needs besides: characters of the group that is counted.
PATTERNS = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
#: The kind of spans that the models find.
RANDOM = "random"
#: The characters that the models tell apart; 0 stands for all others, which end a string.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
SYMBOLS = len(ALPHABET) + 1
#: Strings that the models judge: with a letter, and with no letter, figure or mark of another script beside them.
CANDIDATE = re.compile(r"(?<![\w+/-])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}(?![\w+/-])")
#: Pseudo-counts that a model gives to what the next shorter context predicts.
BACKED = 8.0
_OF_BYTE = np.zeros(256, dtype=np.int64)
_OF_BYTE[np.frombuffer(ALPHABET, dtype=np.uint8)] = np.arange(1, SYMBOLS)
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])


def _long_words(text: str) -> Iterator[tuple[int, str]]:
    """(place, word) of the words that are long enough for any kind but `assign`."""
    at = 0
    for word in text.split():
        if len(word) >= 16:
            at = text.index(word, at)
            yield at, word
            at += len(word)


def _may_assign(text: str) -> bool:
    """Whether a colon or equals sign stands after the last letter of a name, as every match of `assign` needs."""
    for sign in ":=":
        at = text.find(sign)
        while at >= 0:
            end = at
            while end and text[end - 1] == " ":
                end -= 1
            end -= text[end - 1 : end] in ("'", '"')
            if text[end - 1 : end].lower() in ("d", "t", "n", "y"):
                return True
            at = text.find(sign, at + 1)
    return False


def base_spans(text: str, long_words: list[tuple[int, str]] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of all matches that pass, by start, then kind as listed. Per kind leftmost, without overlap; failing ones aren't tried again."""
    words = list(_long_words(text)) if long_words is None else long_words
    found = []
    for order, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        # Matches of the other kinds hold no white space, so they lie within a word.
        for at, part in ([(0, text)] if _may_assign(text) else []) if kind == "assign" else words:
            found += [(at + m.start(), order, kind, at + m.end()) for m in pattern.finditer(part) if m.end(group) - m.start(group) >= least]
    return [(kind, start, stop) for start, _, kind, stop in sorted(found)]


def _without(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with a space for each stretch of spans."""
    out, at = [], 0
    for _, start, stop in spans:
        if stop > at:
            out += [text[at : max(at, start)], " "]
            at = stop
    return "".join([*out, text[at:]])


def identifier_spellings(text: str) -> str:
    """The words of a text as names of things: each joined to the next three by the usual marks, capitals or figures."""
    words = [w for w in text.split() if w.isascii() and w.isalnum()]
    out = []
    for k in range(0, len(words), 4):
        some, turn = words[k : k + 4], k // 4 % 6
        if turn == 0:
            out.append("_".join(some))
        elif turn == 1:
            out.append("".join([some[0], *(w[:1].upper() + w[1:] for w in some[1:])]))
        elif turn == 2:
            out.append("_".join(some).upper())
        elif turn == 3:
            out.append("/".join(some))
        elif turn == 4:
            out.append("-".join(some))
        else:
            out.append("".join(some) + f"_{k}-{len(words)}")
    return " ".join(out)


def random_spellings(text: str) -> str:
    """A digest of the text as strings of random characters: hexadecimal, base 64 in both alphabets, base 32, letters and figures."""
    data = hashlib.sha512(text.encode("utf-8", "surrogatepass")).digest()
    mixed = bytes(ALPHABET[b % 62] for b in data if b < 248)
    return b" ".join([data[:20].hex().encode(), base64.b64encode(data[:30]), base64.urlsafe_b64encode(data[30:]), base64.b32encode(data[:20]).rstrip(b"="), mixed[:40]]).decode()


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ordinary, random = [], []
        for value in batch.column(0):
            text = value.as_py() or ""
            spans = base_spans(text)
            plain = _without(text, spans)
            ordinary.append(f"{plain} {identifier_spellings(plain)}")
            random.append(" ".join([random_spellings(text), *(text[a:b] for kind, a, b in spans if kind != "assign")]))
        yield pa.RecordBatch.from_arrays([pa.array(ordinary + random), pa.array([False] * len(ordinary) + [True] * len(random))], ["text", "random"])


def labelled_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """text, random: for each document its text without base spans and names made of its words (false), and random strings (true). Null texts count as empty."""
    return docs.select(F.col(text_col).alias("text")).mapInArrow(_labelled, "text string, random boolean")


def _symbols(text: str) -> np.ndarray:
    return _OF_BYTE[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]


def _codes(symbols: np.ndarray) -> np.ndarray:
    """A number for each symbol with the two before it, at the start of a text as after other characters."""
    s = np.concatenate(([0, 0], symbols))
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each code occurs in a task's samples of either label: two tables of fixed size."""
    tables = np.zeros((2, SYMBOLS**3), dtype=np.int64)
    for batch in batches:
        for text, random in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            if random is not None:
                codes = _codes(_symbols(text.as_py() or ""))
                np.add.at(tables[int(random)], codes, 1) if len(codes) < 4096 else np.add(tables[int(random)], np.bincount(codes, minlength=SYMBOLS**3), out=tables[int(random)])
    label, code = np.nonzero(tables)
    yield pa.RecordBatch.from_arrays([pa.array(label == 1), pa.array(code, pa.int32()), pa.array(tables[label, code])], ["random", "code", "n"])


@dataclass
class SecretModel:
    """bits: for each code the log of its chance among random strings over that in ordinary text, base 2."""

    bits: np.ndarray

    def score(self, candidate: str) -> float:
        """The log-likelihood ratio of a string in bits: above 0 where it is likelier a random one."""
        return float(self.bits[_codes(_symbols(candidate))].sum())


def _chances(counts: np.ndarray) -> np.ndarray:
    """Chance of each symbol after the two before it, each context backed by the next shorter one, the shortest by equal chances."""
    triples = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    pairs, singles = triples.sum(axis=0), triples.sum(axis=(0, 1))
    one = (singles + 1) / (singles.sum() + SYMBOLS)
    two = (pairs + BACKED * one) / (pairs.sum(axis=1, keepdims=True) + BACKED)
    return ((triples + BACKED * two) / (triples.sum(axis=2, keepdims=True) + BACKED)).reshape(-1)


def fit_secrets(samples: DataFrame, text_col: str = "text", random_col: str = "random") -> SecretModel:
    """Both models from all labelled samples; a null label is left out, a null text is empty. Without samples every score is 0.

    The driver gets at most 2 * 67^3 counts, however many samples there are.
    """
    rows = samples.select(F.col(text_col).alias("text"), F.col(random_col).alias("random"))
    counts = rows.mapInArrow(_counted, "random boolean, code int, n bigint").groupBy("random", "code").agg(F.sum("n").alias("n")).toPandas()
    tables = np.zeros((2, SYMBOLS**3))
    tables[counts["random"].to_numpy(dtype=np.int64), counts["code"].to_numpy(dtype=np.int64)] = counts["n"]
    return SecretModel((np.log2(_chances(tables[1])) - np.log2(_chances(tables[0]))).astype(np.float32))


def random_spans(long_words: list[tuple[int, str]], spans: list[tuple[str, int, int]], model: SecretModel, bits: float, variety: float) -> list[tuple[int, int]]:
    """(start, stop) of candidates outside the spans that score at least `bits` and whose neighbouring pairs differ enough.

    A repeated character or pattern isn't random, however rare it is in ordinary text: of a string's pairs of neighbours at
    least `variety` must be different ones, or of its first 64 where it is longer.
    """
    found = []
    for at, word in long_words:
        for m in CANDIDATE.finditer(word):
            said, start, stop = m.group(), at + m.start(), at + m.end()
            pairs = {said[i : i + 2] for i in range(min(64, len(said) - 1))}
            if len(pairs) >= variety * min(64, len(said) - 1) and model.score(said) >= bits and not any(a <= start and stop <= b for _, a, b in spans):
                found.append((start, stop))
    return found


def _scanned(model: SecretModel, bits: float, variety: float, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    order = [*PATTERNS, RANDOM]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for value in batch.column(1):
                text = value.as_py() or ""
                words = list(_long_words(text))
                base = base_spans(text, words)
                added = [(RANDOM, a, b) for a, b in random_spans(words, base, model, bits, variety)]
                found = sorted([*base, *added], key=lambda s: (s[1], order.index(s[0])))
                spans.append([{"kind": k, "start": a, "stop": b} for k, a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(_SPAN))], schema=schema)

    return run


def find_secrets(docs: DataFrame, model: SecretModel, bits: float = 40.0, variety: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row_id, text, spans (kind, start, stop in code points; by start, then kind: assign, access, hex, random).

    Base spans are those of the patterns, all of each match. Random spans are strings of at least 16 characters (letters,
    figures, + / _ -, one letter at least) outside base spans whose log-likelihood ratio reaches `bits`: a string is taken if it is 2^bits times
    likelier as a random string than as an ordinary one. A null text counts as empty and stays null in the column text. Ids
    may be null or repeat. An empty table gives no row. Other columns don't matter. No shuffle.
    """
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([pa.field("row_id", to_arrow_type(rows.schema["row_id"].dataType)), pa.field("text", pa.string()), pa.field("spans", pa.list_(_SPAN))])
    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.mapInArrow(_scanned(model, bits, variety, schema), f"row_id {kind}, text string, spans array<struct<kind:string,start:int,stop:int>>")


def listed(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:stop of the spans of some kinds, or of all, joined by commas."""
    some = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(found: DataFrame) -> DataFrame:
    """row_id, clean_text: each stretch of spans replaced by the kind of its first one in brackets."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"])
        new = F.array(F.concat(gap, F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["out"], new)).otherwise(s["out"]).alias("out"))

    whole = F.aggregate("spans", state, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return found.select("row_id", whole.alias("clean_text"))
