"""Removing passages that repeat across documents, by level-wise doubling of word windows.

Level 1 looks at windows of half the wanted length.  Of those inside a full window the one of
least hash is its anchor, whatever surrounds the full window, so a repeated full window has a
repeated anchor and one row per anchor is enough.  Anchors that occur in one document alone are
out.  Level 2 doubles the others: the run of full windows around an anchor either equals a run of
an earlier document as a whole, or, where documents part within a run, its windows are compared
one by one.  At full length nothing longer can change what is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.llm import words
from pagelight.llm.storage import cut
from pagelight.llm.words import SECOND_BASE, U64, WORD_BASE, mix

WINDOW = 50
RUN_BITS = 16  # a place is start << RUN_BITS | number of windows


def _last_minimum(value: np.ndarray, span: int) -> np.ndarray:
    """Position of the last minimum of every ``span`` consecutive values."""
    at, size = np.arange(len(value)), 1
    while size < span:
        step = min(size, span - size)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(value[right] <= value[left], right, left)
        size += step
    return at


def _range_hash(total: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = words.powers(base, len(total))
    return mix((total[end] - total[start]) * inverse[start], 7) ^ mix((end - start).astype(U64))


def _totals(w: words.Words, base: int) -> np.ndarray:
    power, _ = words.powers(base, len(w.hash))
    total = np.zeros(len(w.hash) + 1, U64)
    np.cumsum(w.hash * power, out=total[1:])
    return total


def _runs(texts: words.Texts, window: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, number of windows, anchor, two hashes of the run's words) of each run."""
    w = words.split(texts)
    half = window // 2
    full = np.flatnonzero(words.within(w.row, window))
    if not len(full):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    anchor = words.windows(w.hash, half)
    at = _last_minimum(anchor, window - half + 1)[full]
    fresh = np.ones(len(full), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (full[1:] != full[:-1] + 1)
    first = np.flatnonzero(fresh)
    count = np.diff(first, append=len(full))
    start = full[first]
    end = start + count - 1 + window
    hashes = [_range_hash(_totals(w, base), base, start, end).view(np.int64) for base in (WORD_BASE, SECOND_BASE)]
    row = w.row[start]
    return row, start - w.first[row], count, anchor[at[first]].view(np.int64), *hashes


def _anchors(window: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            document, mark = words.column(batch, "doc_id"), words.column(batch, "print")
            for texts in words.slices(words.column(batch, "content")):
                row, start, count, *hashes = _runs(texts, window)
                yield pa.RecordBatch.from_arrays(
                    [document.take(pa.array(row + texts.lo)), mark.take(pa.array(row + texts.lo)), pa.array(start << RUN_BITS | count),
                     *map(pa.array, hashes)],
                    names=["doc_id", "print", "place", "anchor", "run1", "run2"])

    return find


def _places(places: list | None) -> np.ndarray:
    """The windows that packed places name."""
    packed = np.array(places if places is not None else [], np.int64)
    start, count = packed >> RUN_BITS, packed & ((1 << RUN_BITS) - 1)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.unique(np.repeat(start, count) + within)


def _open_windows(window: int):
    """Hashes of the full windows at the places of each document."""

    def hash_them(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            document, mark = words.column(batch, "doc_id"), words.column(batch, "print")
            places = words.column(batch, "places").to_pylist()
            for texts in words.slices(words.column(batch, "content")):
                if not any(places[texts.lo : texts.hi]):
                    continue
                w = words.split(texts)
                totals = [(base, _totals(w, base)) for base in (WORD_BASE, SECOND_BASE)]
                own = [_places(p) for p in places[texts.lo : texts.hi]]
                last = np.diff(w.first) - window
                own = [p[p <= m] for p, m in zip(own, last)]
                row = np.repeat(np.arange(texts.n), [len(p) for p in own])
                start = np.concatenate(own) + w.first[row]
                hashes = [_range_hash(t, base, start, start + window).view(np.int64) for base, t in totals]
                yield pa.RecordBatch.from_arrays(
                    [document.take(pa.array(row + texts.lo)), mark.take(pa.array(row + texts.lo)),
                     pa.array(start - w.first[row] << RUN_BITS | 1), *map(pa.array, hashes)],
                    names=["doc_id", "print", "place", "window1", "window2"])

    return hash_them


def _remover(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Content without the words under the windows at the places, one space between those kept."""
        for batch in batches:
            given = [words.column(batch, name).to_pylist() for name in ("runs", "places")]
            total, removed, kept = [], [], []
            for texts in words.slices(words.column(batch, "content")):
                w = words.split(texts)
                gone = np.zeros(len(w.start) + 1, np.int64)
                for i in range(texts.n):
                    for places in (column[texts.lo + i] for column in given):
                        if places:
                            packed = np.array(places, np.int64)
                            start = packed >> RUN_BITS
                            end = start + (packed & ((1 << RUN_BITS) - 1)) - 1 + window
                            size = w.first[i + 1] - w.first[i]
                            np.add.at(gone, w.first[i] + np.minimum(start, size), 1)
                            np.add.at(gone, w.first[i] + np.minimum(end, size), -1)
                keep = np.cumsum(gone[:-1]) == 0
                count = np.diff(w.first)
                left = np.bincount(w.row[keep], minlength=texts.n)
                total.append(count)
                removed.append(count - left)
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
                kept.append(pa.StringArray.from_buffers(
                    texts.n, pa.py_buffer(places.astype(np.int32).tobytes()), pa.py_buffer(data[mask].tobytes())))
            yield pa.RecordBatch.from_arrays(
                [words.column(batch, "doc_id"), pa.array(np.concatenate(total)), pa.array(np.concatenate(removed)),
                 pa.concat_arrays(kept)], names=["doc_id", "n_words", "n_removed", "content"])

    return remove


def remove_repeated_passages(block: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, content) of every row of ``block`` (doc_id, content).

    Words are runs without white space, unchanged.  A word goes when it lies in ``window`` consecutive words that
    also occur, as words, in the content of a smaller doc_id; all windows are judged on the given content.
    What stays is joined by one space.  Null and empty content has no words and comes back empty; content of fewer than
    ``window`` words stays whole.  Rows that share a doc_id take nothing from each other, and each loses what its own text repeats.  A null doc_id
    loses nothing and takes nothing away.  An empty block gives no rows.  Further columns are ignored.

    Windows are known by 128-bit hashes.  An anchor's rows are aggregated before they are shuffled and
    joined back, where skewed anchors are split; no group is gathered but the places of one text.
    """
    if not 2 <= window < 1 << RUN_BITS:
        raise ValueError("window must be at least 2 and less than 65536 words")
    text = block.select("doc_id", F.coalesce("content", F.lit("")).alias("content")).withColumn("print", F.xxhash64("content"))
    row = ["doc_id", "print"]  # places are those of one text, also where texts share a doc_id
    run = text.filter("doc_id IS NOT NULL").mapInArrow(
        _anchors(window), "doc_id long, print long, place long, anchor long, run1 long, run2 long")
    repeated = run.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter(
        "low < high").select("anchor")
    survivor = cut(run.join(repeated, "anchor"))
    # Level 2: equal runs first, then single windows where an anchor's runs differ.
    kind = survivor.groupBy("anchor", "run1", "run2").agg(F.min("doc_id").alias("first"))
    kinds = kind.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    judged = survivor.join(kind.join(kinds, "anchor"), ["anchor", "run1", "run2"]).select(*row, "place", "first", "kinds")
    judged = cut(judged.filter("doc_id > first OR kinds > 1"))
    by_text = F.collect_list("place")
    covered = judged.filter("doc_id > first").groupBy(*row).agg(by_text.alias("runs"))
    open_run = judged.filter("doc_id = first").groupBy(*row).agg(by_text.alias("places"))
    # The same left side as below, so that both joins read one exchange of the texts.
    single = text.join(open_run, row, "left").mapInArrow(
        _open_windows(window), "doc_id long, print long, place long, window1 long, window2 long")
    first = single.groupBy("window1", "window2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter(
        "first < last").drop("last")
    later = single.join(first, ["window1", "window2"]).filter("doc_id > first").groupBy(*row).agg(
        by_text.alias("places"))
    return text.join(covered, row, "left").join(later, row, "left").mapInArrow(
        _remover(window), "doc_id long, n_words long, n_removed long, content string")
