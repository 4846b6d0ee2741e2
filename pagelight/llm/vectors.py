"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments, and each segment keeps its mean and deviation.  For two vectors the squared distance
is at least the sum over segments of width * ((mean - mean)^2 + (deviation - deviation)^2).  The inner product is half
of what the distance leaves of the two squared norms, so it is at most the sum of width * (mean * mean + deviation *
deviation).  Wide segments come first, narrow ones judge what is left, exact products decide.

Vectors lie in blocks of similar coarse means.  A block keeps the ranges of its statistics, so whole blocks are
left out when they cannot reach a query's k-th best score, which the block of greatest bound provides first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelight.llm import words
from pagelight.llm.storage import cut

WIDTHS = (16, 4)  # of a segment, coarse to fine; narrower ones hold as many numbers as the vector itself
SCALE = 256.0
EXACT = float(1 << 53)  # integers below it are exact as double
GROUP = 64  # queries bounded at once
LONG = np.iinfo(np.int64)


def _segments(size: int, width: int) -> np.ndarray:
    """Where each segment begins; the last one takes the rest."""
    return np.arange(0, max(size - width + 1, 1), width) if size else np.zeros(0, np.int64)


def statistics(x: np.ndarray, width: int) -> np.ndarray:
    """Means and deviations of the segments of each row, weighted so that a plain product bounds the inner product."""
    begin = _segments(x.shape[1], width)
    if not len(begin):
        return np.zeros((len(x), 0))
    weight = np.diff(begin, append=x.shape[1]).astype(float)
    mean = np.add.reduceat(x, begin, axis=1) / weight
    square = np.add.reduceat(np.square(x - np.repeat(mean, weight.astype(int), axis=1)), begin, axis=1) / weight
    return np.concatenate([mean, np.sqrt(square)], axis=1) * np.sqrt(np.concatenate([weight, weight]))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _prepared(scale: float):
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scaled vectors without those that take no part, with their size and the order for blocks."""
        for batch in batches:
            vector = words.column(batch, "vector")
            values = np.floor(vector.flatten().to_numpy(zero_copy_only=False).astype(float) * scale)
            length = pc.fill_null(pc.list_value_length(vector), 0).to_numpy().astype(np.int64)
            wrong = np.zeros(len(length) + 1, np.int64)
            np.add.at(wrong, np.repeat(np.arange(len(length)), length)[~np.isfinite(values)], 1)
            whole = (wrong[:-1] == 0) & vector.is_valid().to_numpy(zero_copy_only=False)
            begin = np.concatenate([[0], np.cumsum(length)])
            for size in np.unique(length[whole]):
                rows = np.flatnonzero(whole & (length == size))
                x = values[begin[rows][:, None] + np.arange(size)]
                coarse = statistics(x, WIDTHS[0])[:, : len(_segments(size, WIDTHS[0]))][:, :62]
                word = (coarse > 0) @ (1 << np.arange(coarse.shape[1]))
                offsets = pa.array((np.arange(len(rows) + 1) * size).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [words.column(batch, "vec_id").take(pa.array(rows)), pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1))),
                     pa.array(np.full(len(rows), size)), pa.array(word.astype(np.int64)), pa.array(np.sqrt(np.square(x).sum(axis=1)))],
                    names=["vec_id", "vector", "size", "word", "norm"])

    return prepare


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition of each row is its block."""
    block = TaskContext.get().partitionId()
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(batch.num_rows, block)), *(words.column(batch, name) for name in ("size", "vec_id", "vector"))],
            names=["block", "size", "vec_id", "vector"])


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest statistics of the rows of each size and block."""
    low, high = {}, {}
    for batch in batches:
        sizes, block = words.column(batch, "size").to_numpy(), words.column(batch, "block").to_numpy()
        for size, number in set(zip(sizes.tolist(), block.tolist())):
            rows = np.flatnonzero((sizes == size) & (block == number))
            s = statistics(_matrix(words.column(batch, "vector").take(pa.array(rows)), size), WIDTHS[0])
            key = (size, number)
            low[key] = np.minimum(low.get(key, s.min(axis=0)), s.min(axis=0))
            high[key] = np.maximum(high.get(key, s.max(axis=0)), s.max(axis=0))
    keys = list(low)
    kind = pa.list_(pa.float64())
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
         pa.array([low[k].tolist() for k in keys], kind), pa.array([high[k].tolist() for k in keys], kind)],
        names=["size", "block", "low", "high"])


class Boxes:
    """The statistics' ranges of every block, by vector size."""

    def __init__(self, rows: list) -> None:
        self.by_size = {}
        for size in {r[0] for r in rows}:
            own = sorted(r for r in rows if r[0] == size)
            self.by_size[size] = (np.array([r[1] for r in own]), *(np.array([r[i] for r in own]).reshape(len(own), -1) for i in (2, 3)))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block numbers, greatest inner product that each query can reach in each block)."""
        block, low, high = self.by_size.get(x.shape[1], (np.zeros(0, np.int64), None, None))
        if not len(block):
            return block, np.zeros((len(x), 0))
        s = statistics(x, WIDTHS[0])
        return block, _upper(np.maximum(s, 0) @ high.T + np.minimum(s, 0) @ low.T, x, np.maximum(np.abs(low), np.abs(high)))


def _upper(bound: np.ndarray, x: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``bound`` and what rounding may have taken from it."""
    return bound + 1e-9 * np.sqrt(np.square(x).sum(axis=1))[:, None] * np.sqrt(np.square(other).sum(axis=1)) + 0.25


def _sent(boxes: Boxes, first: bool):
    """Each query with the block of greatest bound, or with the other blocks that can reach its least score."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = words.column(batch, "size").to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                block, bound = boxes.bounds(_matrix(words.column(batch, "vector").take(pa.array(rows)), size))
                if not len(block):
                    continue
                best = bound.argmax(axis=1)
                wanted = np.zeros(bound.shape, bool)
                wanted[np.arange(len(rows)), best] = True
                if not first:
                    least = words.column(batch, "least").fill_null(-np.inf).to_numpy(zero_copy_only=False)[rows]
                    wanted = ~wanted & ~(bound < least[:, None])
                row, at = np.nonzero(wanted)
                back = batch.take(pa.array(rows[row]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[at]), *(words.column(back, name) for name in ("size", "vec_id", "print", "vector", "least"))],
                    names=["block", "size", "vec_id", "print", "vector", "least"])

    return send


class Block:
    """The vectors of a block with their statistics at every resolution."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.norm = np.sqrt(np.square(x).sum(axis=1))
        self.levels = [statistics(x, width) for width in WIDTHS]

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        x = self.x[rows]
        if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(len(q), 1) < EXACT:
            return (x @ q).astype(np.int64)
        whole = [int(v) for v in q]
        return np.array([max(LONG.min, min(LONG.max, sum(int(a) * b for a, b in zip(v, whole)))) for v in x], np.int64)

    def search(self, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the query, ids, scores) of up to k best others; those under ``least`` may be missing."""
        own = [statistics(queries, width) for width in WIDTHS]
        slack = 1e-9 * np.sqrt(np.square(queries).sum(axis=1))
        for lo in range(0, len(queries), GROUP):
            coarse = own[0][lo : lo + GROUP] @ self.levels[0].T
            for i in range(lo, min(lo + GROUP, len(queries))):
                bound = coarse[i - lo] + slack[i] * self.norm + 0.25
                rows = np.flatnonzero(self.ids != ids[i])
                floor = least[i]
                if len(rows) > k:  # the k of greatest bound give a first floor
                    seed = rows[np.argpartition(-bound[rows], k - 1)[:k]]
                    floor = max(floor, float(self.scores(seed, queries[i]).min()))
                rows = rows[~(bound[rows] < floor)]
                for level, mine in zip(self.levels[1:], own[1:]):
                    rows = rows[~(level[rows] @ mine[i] + slack[i] * self.norm[rows] + 0.25 < floor)]
                score = self.scores(rows, queries[i])
                if len(rows) > k:
                    reach = np.partition(score, len(score) - k)[len(score) - k]
                    rows, score = rows[score >= reach], score[score >= reach]
                order = np.lexsort((self.ids[rows], ~score))[:k]
                yield i, self.ids[rows][order], score[order]


def _searched(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates of a block come first, its queries after them."""
        current, held, block = None, [], None
        for batch in batches:
            sizes, number, query = (words.column(batch, name).to_numpy(zero_copy_only=False) for name in ("size", "block", "is_query"))
            edge = np.flatnonzero((np.diff(sizes) != 0) | (np.diff(number) != 0) | (query[1:] != query[:-1])) + 1
            out = []
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows]):
                if hi == lo:
                    continue
                key = (int(sizes[lo]), int(number[lo]))
                if key != current:
                    current, held, block = key, [], None
                ids = words.column(batch, "vec_id").slice(lo, hi - lo).to_numpy()
                x = _matrix(words.column(batch, "vector").slice(lo, hi - lo), key[0])
                if not query[lo]:
                    held.append((ids, x))
                    continue
                if block is None:
                    block, held = Block(*(np.concatenate(part) for part in zip(*held))), []
                least = words.column(batch, "least").slice(lo, hi - lo).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                mark = words.column(batch, "print").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                out += [(ids[i], mark[i], found, score) for i, found, score in block.search(ids, x, least, k)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.repeat([o[i] for o in out], [len(o[2]) for o in out]).astype(np.int64)) for i in (0, 1)),
                 *(pa.array(np.concatenate([np.zeros(0, np.int64), *(o[i] for o in out)])) for i in (2, 3))],
                names=["query_id", "print", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k best rows of ``vectors``, both (vec_id, vector).

    The library has no records with vectors, so this operator is general.  Components become floor(scale * x) as double,
    and the score is the integer inner product, exact; beyond the range of bigint it is the nearest bigint.  Ranks start
    at 1; ties go to the smaller vec_id.  Candidates are all rows with another vec_id than the query's and as many
    components; fewer than k give fewer rows.  A vector that is null or holds a null or non-finite component (also after scaling) takes no
    part, nor does a null vec_id.  Empty vectors score 0.  A candidate that repeats counts each time; a query that repeats
    is one, and queries that share a vec_id but not the vector are ranked apart.  Empty tables give no rows.  Further columns are ignored.

    Every vector is searched.  A block is one partition of the vectors and is held by one task, so more shuffle partitions
    make smaller blocks; queries are sent to the blocks that can matter to them.  The driver holds the ranges of the blocks'
    coarse statistics.
    """
    if k < 1:
        raise ValueError("k must be at least 1")

    def prepared(frame: DataFrame) -> DataFrame:
        given = frame.filter("vec_id IS NOT NULL").select(
            F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
        return given.mapInArrow(_prepared(scale), "vec_id long, vector array<double>, size long, word long, norm double")

    order = ("size", "word", "norm", "vec_id")
    stored = cut(prepared(vectors).repartitionByRange(*order).mapInArrow(_numbered, "block long, size long, vec_id long, vector array<double>"))
    boxes = Boxes([tuple(r) for r in stored.mapInArrow(_boxes, "size long, block long, low array<double>, high array<double>").collect()])
    asked = prepared(queries).select("size", "vec_id", F.xxhash64("vector").alias("print"), "vector").dropDuplicates(["vec_id", "print"])
    rows = "block long, size long, vec_id long, print long, vector array<double>, least double"
    candidate = stored.select("block", "size", F.lit(False).alias("is_query"), "vec_id", F.lit(0).cast("long").alias("print"), "vector",
                              F.lit(None).cast("double").alias("least"))

    def found(sent: DataFrame) -> DataFrame:
        both = candidate.unionByName(sent.withColumn("is_query", F.lit(True)))
        return both.repartition("size", "block").sortWithinPartitions("size", "block", "is_query").mapInArrow(
            _searched(k), "query_id long, print long, vec_id long, score long")

    best = Window.partitionBy("query_id", "print").orderBy(F.desc("score"), "vec_id")
    near = cut(found(asked.withColumn("least", F.lit(None).cast("double")).mapInArrow(_sent(boxes, True), rows)))
    reached = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(
        F.col("query_id").alias("vec_id"), "print", F.col("score").cast("double").alias("least"))
    far = found(asked.join(reached, ["vec_id", "print"], "left").mapInArrow(_sent(boxes, False), rows))
    return near.unionByName(far).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
