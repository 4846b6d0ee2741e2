"""Words and word windows of Arrow text columns as numpy arrays.

A batch is walked in slices of about ``SLICE`` bytes, so the arrays stay small whatever
the batch holds; only a single longer text makes a longer slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
PIECE = 4 << 20  # bytes hashed at once
U64 = np.uint64
# Odd multipliers of the polynomial hashes; any odd numbers would do.
BYTE_BASE, WORD_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters and digits and the bytes of other scripts.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(size, b, U64)
            out[0] = 1
            pair.append(np.multiply.accumulate(out))
        known = _powers[base] = tuple(pair)
    return known[0][:n], known[1][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x + U64((seed * BYTE_BASE + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Texts:
    """Some texts of a batch: row numbers ``lo`` to ``hi``, their bytes and offsets."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE) -> Iterator[Texts]:
    """Slices of a string column; null reads as the empty text."""
    lo = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if chunk.null_count:
            chunk = pc.fill_null(chunk, "")
        kind = np.int64 if pa.types.is_large_string(chunk.type) else np.int32
        _, places, body = chunk.buffers()
        offsets = np.frombuffer(places, kind)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64) if len(chunk) else np.zeros(1, np.int64)
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(chunk):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
            yield Texts(lo + i, lo + j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j
        lo += len(chunk)


@dataclass
class Words:
    """Words in order: byte places, number of their text, hash; ``first[i]:first[i + 1]`` are those of text i."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def split(texts: Texts, separator: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are no separators, never across two texts."""
    data, offsets = texts.data, texts.offsets
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(texts.n + 1, np.int64), np.zeros(0, U64))
    inside = ~separator[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[0] = after[-1] = False
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(row, np.arange(texts.n + 1))
    return Words(start, end, row, first, hashes(data, start, end))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; ranges are ascending and don't overlap."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
        lo, hi = start[i], end[j - 1]
        power, inverse = powers(BYTE_BASE, int(hi - lo))
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum((data[lo:hi].astype(U64) + U64(1)) * power, out=total[1:])
        out[i:j] = (total[end[i:j] - lo] - total[start[i:j] - lo]) * inverse[start[i:j] - lo]
        i = j
    return mix(out)


def windows(word_hash: np.ndarray, size: int, base: int = WORD_BASE) -> np.ndarray:
    """Hash of every ``size`` consecutive words, also of those that span two texts."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    power, inverse = powers(base, len(word_hash))
    total = np.zeros(len(word_hash) + 1, U64)
    np.cumsum(word_hash * power, out=total[1:])
    return mix((total[size:] - total[:-size]) * inverse[:n])


def within(row: np.ndarray, size: int) -> np.ndarray:
    """Whether the window that starts at each word lies in one text."""
    n = len(row) - size + 1
    return row[:n] == row[size - 1 :] if n > 0 else np.zeros(0, bool)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles, by text; a shorter text is one shingle of all its words."""
    row, value = [], []
    full = windows(words.hash, size)
    if len(full):
        ok = within(words.row, size)
        row.append(words.row[: len(full)][ok])
        value.append(full[ok])
    count = np.diff(words.first)
    for k in range(1, size):  # texts of fewer words
        short = np.flatnonzero(count == k)
        if len(short):
            at = words.first[short][:, None] + np.arange(k)
            power, _ = powers(WORD_BASE, size)
            row.append(short)
            value.append(mix((words.hash[at] * power[:k]).sum(axis=1, dtype=U64), k))
    if not row:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    row, value = np.concatenate(row), np.concatenate(value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[fresh], value[fresh]


def kept_text(texts: Texts, w: Words, keep: np.ndarray) -> pa.Array:
    """The texts reduced to the words ``keep`` marks, joined by one space."""
    # The byte before a word that is not the first is white space: it becomes the one space.
    data = texts.data.copy()
    start, end, row = w.start[keep], w.end[keep], w.row[keep]
    later = np.ones(len(row), bool)
    later[1:] = row[1:] == row[:-1]
    later[:1] = False
    data[start[later] - 1] = 0x20
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start - later] += 1
    edge[end] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
    places = np.concatenate([[0], np.cumsum(mask)])[texts.offsets]
    return pa.StringArray.from_buffers(
        texts.n, pa.py_buffer(places.astype(np.int32).tobytes()), pa.py_buffer(data[mask].tobytes()))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
