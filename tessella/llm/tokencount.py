"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced at proven boundaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts above CHUNK bytes are encoded in chunks of that size; neighbouring chunks overlap by 2 * OVERLAP bytes at first.
CHUNK, OVERLAP = 8_192, 256


class PieceCounter:
    """Counts the pieces that a sentencepiece .model gives, without begin or end pieces.

    Encodings are those of the library. ends() tells where each piece of a slice ends, in bytes of the whole text.
    """

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.width = np.array([1 if m.is_byte(i) else len(p.replace("▁", " ").encode()) for i, p in enumerate(pieces)])
        #: Whether any piece spans another character and then a space: if none does, no merge crosses that place.
        self.spaces_start_pieces = not any(b == "▁" != a for p in pieces for a, b in zip(p, p[1:], strict=False))

    def stable(self, data: bytes, at: int) -> bool:
        """Proof that the pieces left and right of this byte don't depend on each other."""
        return self.spaces_start_pieces and data[at] == 0x20 and data[at - 1] != 0x20

    def ends(self, data: bytes, start: int, stop: int) -> np.ndarray | None:
        """Piece ends of data[start:stop]. The library puts a space before a text: it stands for the slice's own first space."""
        own = start > 0 and data[start] == 0x20
        text = data[start + own : stop].decode()
        ids = self.model.encode(text) if text else [self.model.piece_to_id("▁")] if own else []
        at = start + own - 1 + np.cumsum(self.width[ids])
        return at if len(at) and at[-1] == stop else None

    def count(self, text: str) -> int:
        """As many pieces as the text in one go has: neighbouring chunks are spliced at a common, stable piece end.

        If the overlap of two chunks has no such place, chunk and overlap are doubled, up to the whole rest of the text.
        """
        data = text.encode()
        if len(data) <= self.chunk or "▁" in text:
            return len(self.model.encode(text))
        total, start = 0, 0
        size, reach = self.chunk, self.overlap
        while True:
            end = _at_character(data, start + size)
            mine = self.ends(data, start, end)
            if mine is None:
                return len(self.model.encode(text))
            if end == len(data):
                return total + len(mine)
            behind = _at_character(data, max(start + 1, end - reach))
            ahead = self.ends(data, behind, _at_character(data, end + reach))
            shared = [] if ahead is None else np.intersect1d(mine[(mine > behind) & (mine < end)], ahead)
            cut = next((int(c) for c in shared[::-1] if self.stable(data, int(c))), None)
            if cut is None:
                size, reach = size * 2, reach * 2
                continue
            total += int(np.searchsorted(mine, cut, side="right"))
            start, size, reach = cut, self.chunk, self.overlap

    def counts(self, texts: list[str]) -> list[int]:
        got = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) * 4 <= self.chunk]
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1) if short else [], strict=True):
            got[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) * 4 > self.chunk:
                got[i] = self.count(t)
        return got


class JsonCounter:
    """Counts for a .json tokenizer, without added special tokens, truncation or padding."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(self.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def _at_character(data: bytes, at: int) -> int:
    """The last start of a character at or before this byte."""
    at = min(at, len(data))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


@lru_cache(maxsize=4)
def counter(path: str):
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def _counted(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path).counts
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = counts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(got, pa.int64())], ["row_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). No shuffle.

    A null text counts as empty (0 bytes, 0 tokens); special strings in texts are treated as the library does by default.
    Null and repeated ids are kept as they are; an empty table gives none. Other columns of docs don't matter.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("row_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["row_id"].dataType.simpleString()
    out = rows.mapInArrow(_counted(tokenizer_path), f"row_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
