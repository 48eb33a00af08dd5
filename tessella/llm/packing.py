"""Packing token sequences along a space-filling curve: similar documents become neighbours and share sequences."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import blank_null, materialize

#: Dimensions of the projected document vectors, and bits of each on the curve: keys of DIMS * BITS <= 60 bits.
DIMS, BITS = 4, 12
#: Bytes of token ids aimed at for one range of the curve, tokens of a slice (rows of the range sort: so short that ranges
#: of like numbers of rows hold like numbers of bytes), segments remembered.
RANGE_BYTES, SLICE, REMEMBERED = 12 << 20, 512, 400_000


class ByteEncoder:
    """Token ids of a byte-level BPE, as little-endian unsigned 32-bit bytes, equal to those of tokenizers' encode.

    Where the file is a byte-level BPE with the standard split whose ids are its merge ranks (plain_byte_bpe), tiktoken's
    engine is loaded with its vocabulary, because it is faster; any other file is encoded by tokenizers. White space splits words: where a text has single spaces and line feeds only, each segment up to
    the next of them is encoded on its own and remembered. Other texts are encoded whole, and those that hold an added
    token's string go to tokenizers itself.
    """

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.known: dict[str, bytes] = {}
        self.engine = None
        if not plain_byte_bpe(spec):
            return
        printable = _printable_bytes()
        ranks = {bytes(printable[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.engine = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.width[list(ranks.values())] = [len(b) for b in ranks]

    def ids(self, text: str) -> np.ndarray:
        return self.engine.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def learn(self, segments: list[str]) -> None:
        """Encode new segments in one text, each after the white space that it follows, and remember each one's ids."""
        texts = [s if s[0] == "\n" else " " + s for s in segments]
        ids = self.ids("".join(texts))
        stops = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(t.encode()) for t in texts]))
        data, at = ids.tobytes(), 0
        for s, stop in zip(segments, ((stops + 1) * 4).tolist(), strict=True):
            self.known[s] = data[at:stop]
            at = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split, new = [], set()
        for i, text in enumerate(texts):
            if self.engine is None or any(a in text for a in self.added):
                out[i] = np.asarray(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            flat = text.replace("\n", " ")
            if not flat.isprintable() or "  " in flat or not flat or flat[0] == " " or flat[-1] == " ":
                out[i] = self.ids(text).tobytes()
                continue
            first, *segments = text.replace("\n", " \n").split(" ")
            parts = list(map(self.known.get, segments))
            if None in parts:
                new.update(s for s, ids in zip(segments, parts, strict=True) if ids is None)
            split.append((i, first, segments, parts))
        if new:
            self.learn(list(new))
        for i, first, segments, parts in split:
            if None in parts:
                parts = map(self.known.__getitem__, segments)
            out[i] = self.ids(first).tobytes() + b"".join(parts)
        return out


def plain_byte_bpe(spec: dict) -> bool:
    """Whether a tokenizer file is a BPE over bytes with the standard split, no normaliser, and ids in the order of its merges."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    standard = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
    if model.get("type") != "BPE" or not standard or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    ids = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    single = [i for s, i in model["vocab"].items() if len(s) == 1]
    return len(single) == 256 and ids == sorted(set(ids)) and (not ids or max(single) < ids[0])


def _printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes for themselves, then the rest from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


@lru_cache(maxsize=2)
def _projection(size: int, dims: int) -> np.ndarray:
    """A pseudo-random direction for each token id (hashed vectors of tokens, projected)."""
    return np.random.default_rng(20_240).standard_normal((size, dims)).astype(np.float32)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows of cells, each in [0, 2**bits)).

    By Skilling's method: undo the curve's rotations from the highest bit down, Gray-decode, interleave the bits.
    """
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap if i else 0
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        t ^= np.where(x[:, n - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= t[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def _encoded(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = enc.exact.get_vocab_size(with_added_tokens=True)
        directions = _projection(width, DIMS)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        small = width <= 1 << 16
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                slices, packed, lengths, points = [], [], [], []
                for row, data in enumerate(enc.encode(part.column(1).to_pylist())):
                    ids = np.frombuffer(data + end, dtype="<u4")
                    points.append(sum(directions[ids[i : i + 65_536]].sum(axis=0) for i in range(0, len(ids), 65_536)) / np.sqrt(len(ids)))
                    lengths.append(len(ids))
                    held = ids.astype("<u2" if small else "<u4")
                    for first in range(0, len(ids), SLICE):
                        slices.append((row, first))
                        packed.append(held[first : first + SLICE].tobytes())
                cells = np.clip((np.arctan(np.asarray(points, dtype=np.float64)) / np.pi + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
                rows = np.array([r for r, _ in slices], dtype=np.int64)
                curve, lengths = hilbert_key(cells.astype(np.int64), BITS)[rows], np.array(lengths, dtype=np.int64)[rows]
                columns = [part.column(0).take(pa.array(rows)), part.column(2).take(pa.array(rows)), pa.array(curve), pa.array([f for _, f in slices], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lengths), pa.array(packed, pa.binary())], ["row_id", "row_no", "curve", "first", "doc_tokens", "ids"])

    return run


def _packed(sequence: int, small: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Slices laid end to end and cut; neighbouring slices of one document make one piece where they share a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, filled = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                which, pieces, last, upto = [], [], None, 0
                columns = (part.column(i).to_pylist() for i in (1, 2, 3, 4))
                for row, (number, begin, n, data) in enumerate(zip(*columns, strict=True)):
                    ids = np.frombuffer(data, dtype="<u2" if small else "<u4").astype("<u4")
                    cut = 0
                    while cut < len(ids):
                        room = sequence - filled % sequence
                        length = min(len(ids) - cut, room)
                        chunk = ids[cut : cut + length]
                        if room < sequence and last == number and upto == begin + cut:
                            pieces[-1][1] += length
                            pieces[-1][2] = zlib.crc32(chunk, pieces[-1][2])
                        else:
                            which.append(row)
                            pieces.append([begin + cut, length, zlib.crc32(chunk), n, base + filled // sequence, filled % sequence])
                        cut, filled, last, upto = cut + length, filled + length, number, begin + cut + length
                arrays = [part.column(0).take(pa.array(which, pa.int64())), *(pa.array(v, pa.int64()) for v in zip(*pieces, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, ["row_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack_sequences(
    docs: DataFrame, tokenizer_path: str, sequence: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of documents in sequences of at most `sequence` tokens: row_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its token ids, then end_id; a null text is an empty one, which leaves end_id alone. Document vectors
    (sums of hashed token directions, scaled by length) are projected to DIMS dimensions and keyed by their place on a
    Hilbert curve. Documents are range-sorted by (key, id, row) in slices of SLICE tokens: equal keys, such as copies, split
    over ranges by their ids, and ranges get like numbers of tokens however long the documents are. Each range is laid end
    to end in that order and cut every `sequence` tokens, so only its last sequence may need padding. Null ids are kept and
    sort first; of repeated ids each row is packed on its own; an empty table gives no piece.

    Token ids are written once, in two bytes where the vocabulary allows, and move once, in the range sort.
    """
    kind = docs.select(F.col(id_col).alias("row_id")).schema["row_id"].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("row_id"), blank_null(F.col(text_col)).alias("text"), F.monotonically_increasing_id().alias("row_no"))
    encoded = materialize(
        rows.mapInArrow(_encoded(tokenizer_path, end_id), f"row_id {kind}, row_no bigint, curve bigint, first bigint, doc_tokens bigint, ids binary"), "pack-encoded"
    )
    small = encoder(tokenizer_path).exact.get_vocab_size(with_added_tokens=True) <= 1 << 16
    total = encoded.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)).alias("n")).first()["n"]
    order = ("curve", "row_id", "row_no", "first")
    ranges = encoded.repartitionByRange(max(1, -(-total // RANGE_BYTES)), *order).sortWithinPartitions(*order)
    schema = f"row_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return ranges.select("row_id", "row_no", "first", "doc_tokens", "ids").mapInArrow(_packed(sequence, small), schema)
