"""Periodic runs of words, found with string synchronising sets at dyadic scales.

At scale t every window of t words has a fingerprint.  A position is selected when the least fingerprint of
the windows that start in it and the next t places is the first or the last of them; windows whose words
already repeat with a period of at most t/3 have none.  Selection depends on 2t words alone, so a run selects
the same places in each of its periods, and two selected places 3t to 6t apart with the same 2t words
propose their distance as a period.  A proposal is extended both ways as far as the words agree.

Two kinds of runs escape the pairs.  Periods below ``SMALL`` are read from comparisons at a fixed distance.  And
where one period of a run is itself highly periodic, its two copies are two highly periodic regions that
touch: the distances at which such neighbours are in step are proposed as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.llm import words
from pagelight.llm.words import U64, WORD_BASE, mix

MIN_LENGTH = 12
FIRST_SCALE = 4
SMALL = 3 * FIRST_SCALE
NO_PRINT = U64(0xFFFFFFFFFFFFFFFF)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # first place, place after the last, period


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of True as (first, after last)."""
    edge = np.diff(np.concatenate([[0], equal.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _small_periods(text: np.ndarray, below: int) -> Runs:
    """All stretches of a period below ``below`` that hold it twice."""
    found = []
    for p in range(1, min(below, len(text))):
        first, last = _stretches(text[p:] == text[:-p])
        twice = last - first >= p
        found.append((first[twice], last[twice] + p, np.full(int(twice.sum()), p)))
    return _joined(found)


def _joined(found: list[Runs]) -> Runs:
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *(f[i] for f in found)]) for i in range(3))


def _distinct(runs: Runs) -> Runs:
    """One run for each stretch, of its smallest period."""
    first, last, period = runs
    order = np.lexsort((period, last, first))
    first, last, period = first[order], last[order], period[order]
    fresh = np.ones(len(first), bool)
    fresh[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    return first[fresh], last[fresh], period[fresh]


class _Extender:
    """How far words agree, by range hashes; what it returns is compared word by word."""

    def __init__(self, text: np.ndarray) -> None:
        power, self.inverse = words.powers(WORD_BASE, len(text) + 1)
        self.text = text
        self.total = np.zeros(len(text) + 1, U64)
        np.cumsum(text * power[: len(text)], out=self.total[1:])

    def _same(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        total, inverse = self.total, self.inverse
        return (total[a + size] - total[a]) * inverse[a] == (total[b + size] - total[b]) * inverse[b]

    def runs(self, place: np.ndarray, period: np.ndarray) -> Runs:
        """The maximal stretches of the periods around the places that hold the period twice."""
        if not len(place):
            return _joined([])
        n = len(self.text)
        right, left = place.copy(), place.copy()
        for k in range(n.bit_length() - 1, -1, -1):
            size = 1 << k
            ok = np.flatnonzero(right + period + size <= n)
            ok = ok[self._same(right[ok], right[ok] + period[ok], size)]
            right[ok] += size
            ok = np.flatnonzero(left >= size)
            ok = ok[self._same(left[ok] - size, left[ok] + period[ok] - size, size)]
            left[ok] -= size
        last = right + period
        twice = last - left >= 2 * period
        first, last, period = _distinct((left[twice], last[twice], period[twice]))
        wrong = [i for i, (a, b, p) in enumerate(zip(first, last, period))
                 if not np.array_equal(self.text[a : b - p], self.text[a + p : b])]
        if wrong:  # hashes that agree by chance: compare at these distances word by word
            kept = np.setdiff1d(np.arange(len(first)), wrong)
            again = [(first[kept], last[kept], period[kept])]
            for p in np.unique(period[wrong]):
                a, b = _stretches(self.text[p:] == self.text[:-p])
                twice = b - a >= p
                again.append((a[twice], b[twice] + p, np.full(int(twice.sum()), p)))
            return _joined(again)
        return first, last, period


def _selected(prints: np.ndarray, excluded: np.ndarray, scale: int) -> np.ndarray:
    """The synchronising set: places whose least print among ``scale`` + 1 is the first or the last one."""
    prints = np.where(excluded, NO_PRINT, prints)
    low, size = prints, 1
    while size < scale + 1:
        step = min(size, scale + 1 - size)
        low = np.minimum(low[: len(low) - step], low[step:])
        size += step
    n = len(low)
    return np.flatnonzero((low != NO_PRINT) & ((prints[:n] == low) | (prints[scale : scale + n] == low)))


def _pairs(place: np.ndarray, context: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the selected places with the same context 3 to 6 scales on.

    A context is not highly periodic, so it occurs a bounded number of times in 6 scales.
    """
    order = np.lexsort((place, context))
    place, context = place[order], context[order]
    out, k = [], 1
    while k < len(place):
        apart = place[k:] - place[:-k]
        near = (context[k:] == context[:-k]) & (apart < 6 * scale)
        if not near.any():
            break
        near &= apart >= 3 * scale
        out.append((place[:-k][near], apart[near]))
        k += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(p for p, _ in out)]), np.concatenate([none, *(d for _, d in out)])


def _in_step(text: np.ndarray, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) at which two touching regions of one small period agree."""
    first, last, period = runs
    long = last - first >= 4 * period
    first, last, period = first[long], last[long], period[long]
    order = np.lexsort((first, period))
    first, last, period = first[order], last[order], period[order]
    next_to = np.flatnonzero((period[1:] == period[:-1]) & (first[1:] <= last[:-1]))
    places, distances = [], []
    for i in next_to:
        q, a1, b1, a2, b2 = period[i], first[i], last[i], first[i + 1], last[i + 1]
        root = text[b1 - q : b1]
        at = np.flatnonzero(words.windows(np.concatenate([root, root]), q)[:q] == words.windows(text[a2 : a2 + q], q)[0])
        if len(at):
            step = (a2 - b1 - int(at[0])) % q  # going back by it from the right region gives the left one's words
            distance = np.arange(step + 2 * q, min(b1 - a1, b2 - a2) + q, q)
            places.append(np.maximum(a1, a2 - distance))
            distances.append(distance)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *distances])


def maximal_runs(text: np.ndarray, row: np.ndarray, n_rows: int, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, ...]:
    """(text number, first word, after the last word, smallest period), by text, first word and period.

    ``text`` are word hashes of the texts 0 to ``n_rows`` - 1 one after the other, ``row`` the text of each word.
    """
    # One word that occurs nowhere else ends every text, so nothing repeats across two texts.
    at = np.searchsorted(row, np.arange(n_rows), "right")
    whole = np.insert(text, at, mix(np.arange(n_rows, dtype=U64), 99))
    begin = np.concatenate([[0], at])[:n_rows] + np.arange(n_rows)
    sizes = np.diff(np.concatenate([[0], at])) + 1
    extender = _Extender(whole)
    small = _small_periods(whole, SMALL)
    found = [small]
    place, prints, scale, owner = np.arange(len(whole)), whole, 1, np.repeat(np.arange(n_rows), sizes)
    while len(place):
        if scale >= FIRST_SCALE:
            fits = sizes[owner] > 6 * scale  # a text that can hold the period twice
            if not fits.all():
                place, prints, owner = place[fits], prints[fits], owner[fits]
            if len(place) < 2 * scale:
                break
            periodic = np.zeros(len(whole) + 1, np.int64)
            for first, last, period in found:
                high = (period * 3 <= scale) & (last - first >= scale)
                np.add.at(periodic, first[high], 1)
                np.add.at(periodic, last[high] - scale + 1, -1)
            excluded = (np.cumsum(periodic[:-1]) > 0)[place]
            chosen = _selected(prints, excluded, scale)
            chosen = chosen[chosen + scale < len(prints)]
            context = mix(prints[chosen] * U64(WORD_BASE) + prints[chosen + scale], 1)
            found.append(extender.runs(*_pairs(place[chosen], context, scale)))
        n = len(prints) - scale
        if n <= 0:
            break
        # Windows beyond the end are of no text; they get prints of their own.
        prints = np.concatenate([mix(prints[:n] * U64(WORD_BASE) + prints[scale:]), mix(np.arange(scale, dtype=U64), 98)])
        scale *= 2
    runs = _distinct(_joined(found))
    runs = _distinct(_joined([runs, extender.runs(*_in_step(whole, runs))]))
    first, last, period = runs
    enough = last - first >= np.maximum(min_length, 2 * period)
    first, last, period = first[enough], last[enough], period[enough]
    number = np.searchsorted(begin, first, "right") - 1
    return number, first - begin[number], last - begin[number], period


def _finder(min_length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            document = words.column(batch, "doc_id")
            for texts in words.slices(words.column(batch, "content")):
                w = words.split(texts)
                number, first, last, period = maximal_runs(w.hash, w.row, texts.n, min_length)
                gone = np.zeros(len(w.start) + 1, np.int64)
                again = w.first[number]
                np.add.at(gone, again + first + period, 1)
                np.add.at(gone, again + last, -1)
                order = np.lexsort((period, first, number))
                number, first, last, period = number[order], first[order], last[order], period[order]
                runs = pa.StructArray.from_arrays(
                    [pa.array(first), pa.array(last - first), pa.array(period)], names=["start", "length", "period"])
                offsets = np.searchsorted(number, np.arange(texts.n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [document.slice(texts.lo, texts.n), pa.array(np.diff(w.first)),
                     pa.ListArray.from_arrays(pa.array(offsets), runs), words.kept_text(texts, w, np.cumsum(gone[:-1]) == 0)],
                    names=["doc_id", "n_words", "runs", "content"])

    return find


def periodic_runs(block: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, content) of every row of ``block`` (doc_id, content).

    Words are runs without white space, unchanged, numbered from 0.  ``runs`` lists (start, length, period) by start and
    period: each stretch of consecutive words with smallest period ``period``, at least ``min_length`` words and two
    periods long, that neither neighbouring word extends.  ``content`` is the text without the repeats: a word goes
    when a run contains it after the run's first ``period`` words; what stays is joined by one space.

    Null and empty content has no words, no runs and comes back empty.  A doc_id may be null or repeat; each row is
    judged alone.  An empty block gives no rows.  Further columns are ignored.  Texts are never shuffled; a task holds
    about a megabyte of texts at a time, or one longer text, with a few numbers a word.
    """
    text = block.select("doc_id", F.coalesce("content", F.lit("")).alias("content"))
    return text.mapInArrow(_finder(min_length), f"doc_id long, n_words long, runs {RUNS}, content string")


def longest_run(runs: str) -> F.Column:
    """The run of greatest length, ties to the smallest start, then period; null where there is none."""
    return F.expr(f"""aggregate({runs}, cast(null AS struct<start:bigint,length:bigint,period:bigint>),
        (best, r) -> if(best IS NULL OR r.length > best.length, r, best))""")
