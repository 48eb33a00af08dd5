"""Removal of passages that repeat anywhere in the corpus, located by sharded Aho-Corasick automata.

1. Anchors. Each window of `window` words has an anchor: its `gram`-word sequence with the smallest hash. Equal windows
   have equal anchors at equal places, so only about every fourteenth word starts an anchor (for 35 and 8). An anchor and
   all windows that chose it form a context. Anchors that occur once prove their windows unique.
2. Confirmation. An anchor that always stands in one context confirms all its windows at once. Where contexts differ, the
   windows themselves are counted, by their own 64-bit hash under that of the anchor. Each also gets a checksum of the
   places of its anchor: neighbouring windows with equal checksums occur together everywhere and form one passage.
3. Dictionary. One shard of documents, the first that holds a passage, hands out its words: the dictionary has each
   recurring passage once, as text. It is dealt to the shards whose documents hold the passage somewhere.
4. Location. Each shard compiles what it was dealt into automata of bounded size and streams its documents through them,
   word for word; every word inside an occurrence is removed.

What is shuffled besides the texts (three times) are hashes and the dictionary; a passage of all documents costs a row for
each shard, not for each pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, compress, repeat
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.common import blank_null, materialize, release

#: Bytes of text for a shard, words of a block of several documents, of one automaton, of any block (anchors are found within it).
SHARD_BYTES, SHARED_WORDS, AUTOMATON_WORDS, BLOCK_WORDS = 4 << 20, 1 << 16, 400_000, 1 << 18
_INDEX_BITS = 20
#: Bytes above which a word is hashed by itself.
LONG_WORD = 256


#: A factor for each place of a sequence: odd numbers drawn once. Words are hashed whole before, so that texts can't be
#: made to fit the factors; powers of one base would stand in a relation that texts can use.
_FACTORS = np.random.default_rng(35).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes at a time, mixed after each; of long words at once by xxhash."""
    data = b" ".join(words)
    raw = np.frombuffer(data, dtype=np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(raw))
    eights = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=data + bytes(8), strides=(1,))
    left = (ends - starts).astype(np.int64) if words else np.zeros(0, dtype=np.int64)
    out = left.astype(np.uint64) * _FACTORS[62]
    some = np.flatnonzero(left <= LONG_WORD)
    at, left = starts[some], left[some]
    while len(some):
        chunk = eights[at] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * np.clip(left, 1, 8).astype(np.uint64)))
        out[some] = _mix((out[some] ^ chunk) * _FACTORS[63])
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist() if words else ():
        out[i] = xxhash.xxh3_64_intdigest(words[i], seed=35)
    return out


def folded_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` values in a row, size at most 60; none of size 0."""
    n = len(values) - size + 1 if size else 0
    total = np.zeros(max(0, n), dtype=np.uint64)
    for k in range(size if n > 0 else 0):
        total += values[k : k + n] * _FACTORS[k]
    return _mix(total)


class Block:
    """Hashes of the word sequences of a block: some documents' words, one after the other."""

    def __init__(self, parts: list[list[bytes]], gram: int) -> None:
        sizes = [len(p) for p in parts]
        self.n, self.gram = sum(sizes), gram
        self.doc = np.repeat(np.arange(len(parts)), sizes)
        self.grams = folded_hashes(word_hashes(list(chain.from_iterable(parts))), gram)

    def hashes(self, first: np.ndarray, size: int) -> np.ndarray:
        """Of `size` words from the words `first` on, by the grams that cover them."""
        total = np.zeros(len(first), dtype=np.uint64)
        for k, at in enumerate([*range(0, size - self.gram, self.gram), size - self.gram]):
            total += self.grams[first + at] * _FACTORS[k]
        return _mix(total)

    def runs(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one anchor: first and last window start, the anchor's key, the context's key."""
        n, grams, wide = self.n, self.grams, window - self.gram + 1
        none = np.zeros(0, dtype=np.int64)
        if n < window:
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        low = np.uint64((1 << _INDEX_BITS) - 1)
        order = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span * 2 <= wide:
            order = np.minimum(order[:-span], order[span:])
            span *= 2
        if span < wide:
            order = np.minimum(order[: len(order) - (wide - span)], order[wide - span :])
        starts = np.flatnonzero(self.doc[: n - window + 1] == self.doc[window - 1 :])
        anchor = (order[starts] & low).astype(np.int64)
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        heads = np.flatnonzero(new)
        if not len(heads):
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        first, last = starts[heads], starts[np.append(heads[1:], len(starts)) - 1]
        keys = grams[anchor[heads]]
        # Two windows cover a run's words, as no run has more windows than a window has words.
        ends = self.hashes(first, window) * _FACTORS[0] + self.hashes(last, window) * _FACTORS[1] + (last - first).astype(np.uint64)
        return first, last, keys, _mix(ends ^ keys * np.uint64(5))

    def windows(self, first: np.ndarray, last: np.ndarray, keys: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows of some runs: their starts and keys."""
        sizes = last - first + 1
        starts = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return starts, _mix(self.hashes(starts, window) ^ np.repeat(keys, sizes) * np.uint64(11))


def _blocks(words_of: list[list[bytes]], window: int, gram: int) -> Iterator[tuple[Block, list[tuple[int, int]]]]:
    """Blocks of documents with at least a window of words, each with (document, its first word) of its parts.

    A document of more than BLOCK_WORDS words spreads over parts that share window - 1 words: each window is in one part.
    """
    parts: list[list[bytes]] = []
    owners: list[tuple[int, int]] = []
    count = 0
    for i, words in enumerate(words_of):
        for at in range(0, max(1, len(words) - window + 1), BLOCK_WORDS - window + 1):
            if len(words) < window:
                continue
            part = words[at : at + BLOCK_WORDS]
            if parts and count + len(part) > SHARED_WORDS:
                yield Block(parts, gram), owners
                parts, owners, count = [], [], 0
            parts.append(part)
            owners.append((i, at))
            count += len(part)
    if parts:
        yield Block(parts, gram), owners


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return np.unique(column.to_numpy().astype(np.int64).view(np.uint64))


def _paired(anchors: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Pairs as records, which sort and compare by both."""
    out = np.empty(len(anchors), dtype=[("anchor", "<u8"), ("key", "<u8")])
    out["anchor"], out["key"] = anchors, keys
    return out


def _position(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each of x is in the sorted array known, -1 if nowhere."""
    if not len(known):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return _position(x, known) >= 0


def word_slices(texts: pa.ChunkedArray | pa.Array, n_bytes: int = 1 << 20, lower: bool = False) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of some documents at a time, with the first one's row; A to Z in lower case if asked."""
    held: list[list[bytes]] = []
    size = at = 0
    for i, text in enumerate(texts):
        data = (text.as_py() or "").encode()
        held.append((data.lower() if lower else data).split())
        size += len(data)
        if size > n_bytes:
            yield at, held
            held, size, at = [], 0, i + 1
    if held:
        yield at, held


def _anchors(window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = batch.column(1).to_numpy()
            for at, words_of in word_slices(batch.column(0)):
                for block, owners in _blocks(words_of, window, gram):
                    first, _, keys, contexts = block.runs(window)
                    shard = np.array([shards[at + i] for i, _ in owners], dtype=np.int32)[block.doc[first]]
                    yield pa.RecordBatch.from_arrays([_signed(keys), _signed(contexts), pa.array(shard, pa.int32())], ["anchor", "context", "shard"])

    return run


def _count_windows(window: int, gram: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A shard's windows under the wanted anchors: how often each occurs, and the checksum of the places of its anchor."""

    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        known = _unsigned(wanted.column("anchor"))
        shard = (docs.column("shard") if docs.num_rows else wanted.column("shard"))[0].as_py()
        none, seen = np.zeros(0, dtype=np.uint64), 0
        anchors, windows, places = [none], [none], [none]
        if len(known):
            for _, words_of in word_slices(docs.column("text")):
                for block, _ in _blocks(words_of, window, gram):
                    first, last, keys, _ = block.runs(window)
                    some = _among(keys, known)
                    first, last, keys = first[some], last[some], keys[some]
                    sizes = last - first + 1
                    windows.append(block.windows(first, last, keys, window)[1])
                    anchors.append(np.repeat(keys, sizes))
                    place = (np.uint64(shard) << np.uint64(40)) + np.arange(seen, seen + len(keys), dtype=np.uint64)
                    places.append(np.repeat(_mix(place), sizes))
                    seen += len(keys)
        anchor, key, place = map(np.concatenate, (anchors, windows, places))
        order = np.lexsort((key, anchor))
        anchor, key, place = anchor[order], key[order], place[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (anchor[1:] != anchor[:-1])
        heads = np.flatnonzero(new)
        sums = np.bitwise_xor.reduceat(place, heads) if len(heads) else place
        n = np.diff(np.append(heads, len(key)))
        columns = [pa.array(np.full(len(heads), shard), pa.int32()), _signed(anchor[heads]), _signed(key[heads]), pa.array(n, pa.int64()), _signed(sums)]
        return pa.table(columns, names=["shard", "anchor", "key", "n", "places"])

    return run


def _passages(window: int, gram: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The words of the passages that a shard is asked for: whole contexts (places null), and windows, joined where neighbours have equal checksums.

    A passage is keyed by its anchor and its context or its first window.
    """

    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        asked = _paired(*(wanted.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("anchor", "key")))
        order = np.argsort(asked, order=("anchor", "key"))
        asked = asked[order]
        single = wanted.column("places").is_valid().to_numpy()[order]
        places = wanted.column("places").fill_null(0).to_numpy().astype(np.int64)[order]
        times = wanted.column("n").to_numpy()[order]
        given, anchors = np.zeros(len(asked), dtype=bool), np.unique(asked["anchor"])
        out: tuple[list, list, list] = ([], [], [])

        def hand_out(at: int, text: bytes) -> None:
            for column, value in zip(out, (int(asked["anchor"][at].view(np.int64)), int(asked["key"][at].view(np.int64)), text), strict=True):
                column.append(value)

        for _, words_of in word_slices(docs.column("text")) if len(asked) else ():
            for block, owners in _blocks(words_of, window, gram):
                first, last, keys, contexts = block.runs(window)
                some = np.flatnonzero(_among(keys, anchors))
                part_start = np.searchsorted(block.doc, np.arange(len(owners)))

                def words(a: int, b: int, block: Block = block, owners: list = owners, part_start: np.ndarray = part_start, words_of: list = words_of) -> bytes:
                    i, offset = owners[block.doc[a]]
                    at = int(a - part_start[block.doc[a]]) + offset
                    return b" ".join(words_of[i][at : at + int(b - a) + window])

                whole = _position(_paired(keys[some], contexts[some]), asked)
                for run_at, at in zip(some[whole >= 0], whole[whole >= 0], strict=True):
                    if not given[at] and not single[at]:
                        given[at] = True
                        hand_out(at, words(first[run_at], last[run_at]))
                starts, window_keys = block.windows(first[some], last[some], keys[some], window)
                sizes = (last - first + 1)[some]
                owner = np.repeat(some, sizes)
                at = _position(_paired(np.repeat(keys[some], sizes), window_keys), asked)
                new = np.flatnonzero((at >= 0) & single[at] & ~given[at])
                # Of windows that the block holds several times, the first stays.
                new = new[np.sort(np.unique(at[new], return_index=True)[1])]
                given[at[new]] = True
                if not len(new):
                    continue
                places_of, times_of = places[at[new]], times[at[new]]
                head = np.ones(len(new), dtype=bool)
                head[1:] = (new[1:] != new[:-1] + 1) | (owner[new[1:]] != owner[new[:-1]]) | (places_of[1:] != places_of[:-1]) | (times_of[1:] != times_of[:-1])
                heads = np.flatnonzero(head)
                for a, b in zip(new[heads], new[np.append(heads[1:], len(new)) - 1], strict=True):
                    hand_out(at[a], words(starts[a], starts[b]))
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["anchor", "key", "passage"])

    return run


def _codes(words: set[bytes]) -> dict[bytes, str]:
    """Two characters for each word, from two alphabets: an automaton's state then has few ways on, and words stay aligned. b"" is any other word."""
    base = isqrt(len(words)) + 1
    return {w: chr(1 + i // base) + chr(1 + 2 * base + i % base) for i, w in enumerate((b"", *sorted(words)))}


def _automata(passages: Iterable[str]) -> Iterator:
    """Automata over words' codes, each of at most AUTOMATON_WORDS words or one passage; a match's value is its number of words."""
    import ahocorasick

    made, size = None, 0
    for p in passages:
        n = len(p) // 2
        if made is not None and size + n > AUTOMATON_WORDS:
            made.make_automaton()
            yield made
            made, size = None, 0
        if made is None:
            made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        made.add_word(p, n)
        size += n
    if made is not None:
        made.make_automaton()
        yield made


def _remove(window: int, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Each document of a shard with the words removed that lie in an occurrence of a passage dealt to the shard."""

    def run(docs: pa.Table, dealt: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        said = sorted(set(dealt.column("passage").to_pylist()))
        codes = _codes({w for p in said for w in p.split(b" ")})
        automata = list(_automata("".join(map(codes.__getitem__, p.split(b" "))) for p in said))
        del said
        out: dict[str, list] = {"n_words": [], "n_removed": [], "removed": [], "kept_sha256": []}
        for _, words_of in word_slices(docs.column("text")):
            for words in words_of:
                n = len(words)
                edges = np.zeros(n + 1, dtype=np.int64)
                if automata and n >= window:
                    line = "".join(map(codes.get, words, repeat(codes[b""])))
                    hits = np.array([hit for automaton in automata for hit in automaton.iter(line)], dtype=np.int64).reshape(-1, 2)
                    ends = (hits[:, 0] + 1) // 2
                    edges = np.bincount(ends - hits[:, 1], minlength=n + 1) - np.bincount(ends, minlength=n + 1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = list(compress(words, (~gone).tolist())) if gone.any() else words
                flips = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                out["n_words"].append(n)
                out["n_removed"].append(n - len(kept))
                out["removed"].append([{"start": int(a), "stop": int(b)} for a, b in zip(flips[::2], flips[1::2], strict=True)])
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.table([docs.column("row_id"), *(pa.array(v, schema.field(k).type) for k, v in out.items())], schema=schema)

    return run


def remove_repeats(docs: DataFrame, window: int = 35, gram: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row_id, n_words, n_removed, removed (word ranges), kept_sha256 (of the kept words, joined by spaces).

    Words are maximal runs without white space, unchanged. Removed is each word inside a window of `window` words whose
    word sequence also starts anywhere else, in the same document too; windows are judged on the input. A null text has no
    words, shorter texts than a window lose none. Ids may be null or repeat: each row is a document. An empty table gives
    no row. Other columns of docs don't matter.
    """
    text = blank_null(F.col(text_col))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // SHARD_BYTES))
    rows = docs.select(F.col(id_col).alias("row_id"), text.alias("text"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"))
    rows = materialize(rows, "repeats-rows")

    anchors = rows.select("text", "shard").mapInArrow(_anchors(window, gram), "anchor bigint, context bigint, shard int")
    anchors = materialize(anchors, "repeats-anchors")
    contexts = anchors.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min("shard").alias("shard"))
    recurring = contexts.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("contexts"), F.min("context").alias("key"), F.min("shard").alias("first_shard"))
    recurring = materialize(recurring.filter("n > 1"), "repeats-recurring")

    # A row for each anchor and shard at most on the left: no anchor is hot. Merge joins, as these sizes can't be guessed.
    held = anchors.select("anchor", "shard").distinct()
    varied = held.join(recurring.filter("contexts > 1").select("anchor").hint("merge"), "anchor")
    counted = rows.groupBy("shard").cogroup(varied.groupBy("shard"))
    windows = materialize(counted.applyInArrow(_count_windows(window, gram), "shard int, anchor bigint, key bigint, n bigint, places bigint"), "repeats-windows")
    repeated = windows.groupBy("anchor", "key").agg(F.sum("n").alias("n"), F.bit_xor("places").alias("places"), F.min("shard").alias("shard"))
    whole = recurring.filter("contexts = 1").select(F.col("first_shard").alias("shard"), "anchor", "key", "n", F.lit(None).cast("bigint").alias("places"))
    asked = repeated.filter("n > 1").select("shard", "anchor", "key", "n", "places").unionByName(whole)

    handed = rows.select("shard", "text").groupBy("shard").cogroup(asked.groupBy("shard"))
    passages = materialize(handed.applyInArrow(_passages(window, gram), "anchor bigint, key bigint, passage binary"), "repeats-passages")
    holders = windows.select("anchor", "key", "shard").unionByName(held.join(whole.select("anchor", "key").hint("merge"), "anchor").select("anchor", "key", "shard"))
    dealt = materialize(holders.join(passages.hint("merge"), ["anchor", "key"]).select("shard", "passage"), "repeats-dealt")
    release(anchors, recurring, windows, passages)

    out = f"row_id {rows.schema['row_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, removed array<struct<start:int,stop:int>>, kept_sha256 string"
    schema = pa.schema(
        [
            pa.field("row_id", to_arrow_type(rows.schema["row_id"].dataType)), pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()),
            pa.field("removed", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.field("kept_sha256", pa.string()),
        ]
    )
    return rows.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(_remove(window, schema), out)
