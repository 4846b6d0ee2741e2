"""Token counts of whole texts, long ones by chunks that are resynchronised in their overlap.

Chunks of a long text are encoded with offsets, each with some text that the next one repeats.  Where both
put a token border before a space after a non-space, nothing left of the border depends on what is
right of it and the other way round: no piece of the vocabulary has its space mark after another
character, so no merge crosses the border.  There the counts are spliced.  An overlap without such a
border is widened until it has one or the text ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.llm import words

CHUNK = 1 << 16  # bytes that a chunk advances
OVERLAP = 1 << 10  # bytes repeated at first
GROUP = 256  # texts encoded at once
SPACE_MARK = "▁"


class Counter:
    """Counts the tokens of a sentencepiece model, without begin, end or added tokens."""

    def __init__(self, model_path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        #: Whether the borders are proven for this vocabulary; else long texts are encoded whole.
        self.proven = not any(SPACE_MARK in piece.lstrip(SPACE_MARK) for piece in pieces)

    def count(self, texts: list[str], sizes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        short = [i for i, size in enumerate(sizes) if size <= self.chunk or not self.proven]
        for lo in range(0, len(short), GROUP):
            part = short[lo : lo + GROUP]
            out[part] = [len(ids) for ids in self.model.encode([texts[i] for i in part], num_threads=1)]
        for i in set(range(len(texts))) - set(short):
            out[i] = self.count_long(texts[i].encode())
        return out

    def _borders(self, text: bytes, start: int, end: int) -> list[int]:
        """Where the tokens of ``text[start:end]`` begin, as places in ``text``."""
        encoded = self.model.encode(text[start:end].decode(), return_type="proto")
        return [start + piece.begin for piece in encoded.pieces]

    def count_long(self, text: bytes) -> int:
        total, start, first = 0, 0, 0  # the tokens from ``first`` on are those of this chunk
        while True:
            after = _character(text, start + self.chunk)
            overlap, splice = self.overlap, None
            while True:
                end = _character(text, after + overlap)
                here = self._borders(text, start, end)
                if end >= len(text):
                    break
                there = set(self._borders(text, after, end))
                # The first token of a chunk carries a space mark of its own; it proves nothing.
                splice = next((b for b in here if b > after and b in there and text[b] == 0x20 and text[b - 1] != 0x20), None)
                if splice is not None:
                    break
                overlap *= 2
            if splice is None:
                return total + sum(b >= first for b in here)
            total += sum(first <= b < splice for b in here)
            start, first = after, splice


def _character(text: bytes, at: int) -> int:
    """The first place from ``at`` on where a character begins."""
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(text))


def token_counts(block: DataFrame, model_path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``block`` (doc_id, content).

    ``model_path`` is a sentencepiece model that every executor can read.  The counts are those of encoding the whole
    content at once.  Null and empty content has no byte and no token.  Repeated rows repeat.  An empty
    block gives no rows.  Further columns of ``block`` are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model_path, chunk, overlap)
        for batch in batches:
            content = words.column(batch, "content")
            sizes = np.concatenate([np.diff(t.offsets) for t in words.slices(content)] or [np.zeros(0, np.int64)])
            tokens = [counter.count(content.slice(lo, GROUP).to_pylist(), sizes[lo : lo + GROUP])
                      for lo in range(0, len(content), GROUP)]
            yield pa.RecordBatch.from_arrays(
                [words.column(batch, "doc_id"), pa.array(sizes), pa.array(np.concatenate(tokens or [sizes]))],
                names=["doc_id", "n_bytes", "n_tokens"])

    text = block.select("doc_id", F.coalesce("content", F.lit("")).alias("content"))
    return text.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
