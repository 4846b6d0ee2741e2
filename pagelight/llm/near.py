"""Joining content by the Jaccard similarity of its word shingles, with fixed LSH banding.

Content with equal shingle sets forms a class.  Every tree labels a class with a sequence of
minimum hashes; classes are compared when they share the prefix of some tree.  Its length is the
same for all: the longest, up to ``LABELS``, with which pairs at the wanted similarity are found
with the target probability.  No label beyond it is computed, no prefix is matched in rounds.  What shares a prefix is brought together once, however many trees agree,
and the exact similarities decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.llm import words
from pagelight.llm.components import components
from pagelight.llm.storage import cut
from pagelight.llm.words import U64, mix

SHINGLE = 5
SIMILARITY = 0.8
TREES, LABELS = 16, 10
RECALL = 0.999  # of pairs that are just as similar as wanted
TILE_SHINGLES = 1_000_000  # bound of what is compared in one task


def prefix_length(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """The longest prefix that some tree shares with probability ``recall``."""
    length = LABELS
    while length > 1 and 1 - (1 - similarity**length) ** TREES < recall:
        length -= 1
    return length


def _minimum_hashes(row: np.ndarray, value: np.ndarray, n: int, count: int) -> np.ndarray:
    """``count`` minima over the values of each of ``n`` texts; rows are ascending."""
    rng = np.random.default_rng(4)
    factors = rng.integers(1, 1 << 63, count, dtype=np.uint64) * U64(2) + U64(1)
    shifts = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    out = np.full((n, count), 0xFFFFFFFF, np.uint32)
    if len(row):
        bounds = np.flatnonzero(np.diff(row, prepend=-1))
        at, space, small = row[bounds], np.empty_like(value), np.empty(len(value), np.uint32)
        for k in range(count):
            np.bitwise_xor(value, shifts[k], out=space)
            np.multiply(space, factors[k], out=space)
            np.right_shift(space, U64(32), out=space)
            small[:] = space
            out[at, k] = np.minimum.reduceat(small, bounds)
    return out


def signatures(block: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(doc_id, print, set1, set2, n_shingles, prefixes): a 128-bit sum over the shingle set, and a key of each tree's prefix."""
    length = prefix_length(similarity, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, sizes, keys = [], [], []
            for texts in words.slices(words.column(batch, "content")):
                row, value = words.shingles(words.split(texts), SHINGLE)
                size = np.bincount(row, minlength=texts.n)
                pair = np.zeros((texts.n, 2), U64)
                some = np.flatnonzero(size)
                if len(some):
                    bounds = np.cumsum(size) - size
                    for k in range(2):
                        pair[some, k] = np.add.reduceat(mix(value, k + 1), bounds[some])
                labels = _minimum_hashes(row, value, texts.n, TREES * length).reshape(texts.n, TREES, length)
                key = np.zeros((texts.n, TREES), U64) + np.arange(TREES, dtype=U64)
                for k in range(length):
                    key = mix(key ^ labels[:, :, k].astype(U64), k + 1)
                sums.append(pair)
                sizes.append(size)
                keys.append(key)
            sums, sizes, keys = np.concatenate(sums).view(np.int64), np.concatenate(sizes), np.concatenate(keys).view(np.int64)
            offsets = pa.array(np.arange(len(keys) + 1) * TREES, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [words.column(batch, "doc_id"), words.column(batch, "print"), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                names=["doc_id", "print", "set1", "set2", "n_shingles", "prefixes"])

    return _printed(block).mapInArrow(sign, "doc_id long, print long, set1 long, set2 long, n_shingles long, prefixes array<long>")


def _printed(block: DataFrame) -> DataFrame:
    """The texts with a hash that tells those of one doc_id apart."""
    return block.select("doc_id", "content", F.xxhash64("content").alias("print"))


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The content column replaced by the sorted hashes of its shingles, as bytes."""
    for batch in batches:
        sets = []
        for texts in words.slices(words.column(batch, "content")):
            row, value = words.shingles(words.split(texts), SHINGLE)
            bounds = np.searchsorted(row, np.arange(texts.n + 1))
            sets += [value[bounds[i] : bounds[i + 1]].tobytes() for i in range(texts.n)]
        at = batch.schema.get_field_index("content")
        yield batch.set_column(at, "content", pa.array(sets, pa.binary()))


def _compare(members: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, list]:
    """Links of each member, and pairs that span its linked groups.

    A member of ``left`` is compared with the later ones of ``right``.
    """
    n = len(members)
    size = np.array([len(m) for m in members])
    start = np.cumsum(size) - size
    _, ids = np.unique(np.concatenate(members), return_inverse=True)
    mark = np.zeros(int(ids.max()) + 1, bool)
    links, root = np.zeros(n, np.int64), np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in np.flatnonzero(left):
        own = ids[start[i] : start[i] + size[i]]
        mark[own] = True
        if i + 1 < n:
            shared = np.add.reduceat(mark[ids[start[i + 1] :]], start[i + 1 :] - start[i + 1], dtype=np.int64)
            close = shared >= similarity * (size[i] + size[i + 1 :] - shared) - 1e-9
            found = np.flatnonzero(close & right[i + 1 :]) + i + 1
            links[i] += len(found)
            links[found] += 1
            mine = find(i)
            for j in found[root[found] != mine]:
                other = find(j)
                if other != mine:
                    mine, other = min(mine, other), max(mine, other)
                    root[other] = mine
        mark[own] = False
    return links, [find(i) for i in range(n)]


def _verifier(similarity: float):
    def verify(part: pd.DataFrame) -> pd.DataFrame:
        """Links between the two sides of one tile, cluster by cluster; ``head`` is the smallest key joined to."""
        # A row that repeats stands for its class once.
        part = part.drop_duplicates(["cluster", "side", "key"]).sort_values(["cluster", "side", "key"], kind="stable")
        out = []
        for _, rows in part.groupby("cluster", sort=False):
            members = [np.frombuffer(b, U64) for b in rows["content"]]
            across = rows["tile_a"].iloc[0] != rows["tile_b"].iloc[0]
            side, ids = rows["side"].to_numpy(), rows["key"].to_numpy()
            left = side == 0
            links, root = _compare(members, left, side == 1 if across else left, similarity)
            first: dict[int, int] = {}
            for r, c in zip(root, ids):
                first[r] = min(c, first.get(r, c))
            out.append(pd.DataFrame({"key": ids, "links": links, "head": [first[r] for r in root],
                                     "tiles": rows["tiles"].to_numpy()}))
        return pd.concat(out)

    return verify


def near_duplicates(block: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, group_id, n_shingles) of every row of ``block`` (doc_id, content).

    Words are runs without white space, unchanged; a shingle is five consecutive words, and content of
    fewer words is one shingle of them all.  ``class_id`` is the smallest doc_id with the same shingle set,
    ``n_links`` the number of other classes with a Jaccard similarity of at least ``similarity``,
    ``group_id`` the smallest doc_id that is reached over links.  Null and empty content has no shingle, no
    link and is a class and group of its own.  Rows that repeat a doc_id and its content repeat its answer.
    An empty block gives no rows.  Further columns of ``block`` are ignored.

    Classes that share a prefix of some tree are clustered, so each shingle set is moved once.  A cluster of more
    shingles than a task should hold is cut in tiles and the pairs of tiles are compared in tasks of their own;
    links are counted there and never become rows.
    """
    signed = cut(signatures(block, similarity, recall))
    some = signed.filter("n_shingles > 0")
    # The prefixes of a class are those of any of its members; a doc_id may name several classes, a key names one.
    classes = cut(some.groupBy("set1", "set2").agg(
        F.min("doc_id").alias("class_id"), F.min_by("print", "doc_id").alias("print"), F.min("n_shingles").alias("n_shingles"),
        F.any_value("prefixes").alias("prefixes")).withColumn("key", F.xxhash64("set1", "set2")))
    entry = classes.filter("class_id IS NOT NULL").select("key", F.explode("prefixes").alias("prefix"))
    shared = entry.groupBy("prefix").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    clusters = components(entry.join(shared, "prefix").select(F.col("key").alias("a"), "b"))
    clustered = cut(classes.drop("prefixes").join(
        clusters.select(F.col("id").alias("key"), F.col("root").alias("cluster")), "key"))
    sizes = clustered.groupBy("cluster").agg(
        F.ceil(F.sum("n_shingles") / F.lit(TILE_SHINGLES)).cast("int").alias("tiles"), F.sum("n_shingles").alias("total"))
    shards = max(1, -(-(sizes.agg(F.sum("total")).first()[0] or 0) // TILE_SHINGLES))
    planned = clustered.join(sizes.drop("total"), "cluster").select(
        F.col("class_id").alias("doc_id"), "print", "key", "cluster", "tiles",
        F.pmod(F.xxhash64("key", F.lit(9)), F.col("tiles")).cast("int").alias("tile"))
    sets = _printed(block).join(planned, ["doc_id", "print"]).drop("doc_id", "print").mapInArrow(
        _shingle_sets, "content binary, key long, cluster long, tiles int, tile int")
    # Clusters of one tile share tasks; the tiles of larger ones meet in pairs.
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    placed = sets.select("key", "content", "cluster", "tiles", "tile", other).select(
        "key", "content", "cluster", "tiles", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"),
        F.when(F.col("tile") <= F.col("other"), 0).otherwise(1).alias("side"),
        F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("cluster"), F.lit(shards))).otherwise(F.col("cluster")).alias("task"),
    )
    verified = cut(placed.groupBy("task", "tile_a", "tile_b").applyInPandas(
        _verifier(similarity), "key long, links long, head long, tiles int"))
    counted = verified.groupBy("key").agg(F.sum("links").alias("n_links"), F.min("head").alias("head"))
    joined = components(verified.filter("tiles > 1").select(F.col("key").alias("a"), F.col("head").alias("b")))
    linked = cut(counted.join(joined.withColumnRenamed("id", "key"), "key", "left").select("key", "n_links", F.coalesce("root", "head").alias("root")).join(
        classes.select("key", "class_id"), "key"))
    group = linked.groupBy("root").agg(F.min("class_id").alias("group_id"))
    named = classes.select("set1", "set2", "key", "class_id").join(
        linked.join(group, "root").select("key", "n_links", "group_id"), "key", "left").drop("key")
    # Content without shingles finds no class.
    return signed.drop("prefixes", "print").join(named, ["set1", "set2"], "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("group_id", "class_id", "doc_id").alias("group_id"), "n_shingles")
