"""Prefix trie of audit trails, from their sorted order.

Trails are sorted, so those that begin with the same entries are neighbours, and the number of entries that
two neighbours share (LCP) says where every prefix begins and ends: a sparse table of range minima answers,
for any prefix of any trail, how far the LCP stays at its length or above.  Each prefix searches its left
and right end on its own, by powers of two, and every figure of a node is a sum over its interval.

The order is cut into blocks.  Inside a block all prefixes search at once.  A prefix that goes on in another
block leaves one piece in each; a second sparse table, over the blocks, leads every piece to the block where
the prefix begins, and the pieces are added up there.  Between two blocks there are at most as many such
prefixes as they share entries, so a prefix of all trails costs one row a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelight.llm import words
from pagelight.llm.storage import cut

BLOCK = 1 << 16  # trails and their entries in a block
CODE = 32  # characters that stand for an entry
NO_END = hashlib.sha256(b"").hexdigest()


class RangeMinimum:
    """Sparse table of an array: the minimum of every stretch of a power of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.levels, size = [values], 1
        while 2 * size <= self.n:
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-size], low[size:]))
            size *= 2

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place that is reached from ``at`` over values of ``least`` or more behind it."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            ok = np.flatnonzero(at + (1 << k) < self.n)
            ok = ok[self.levels[k][at[ok] + 1] >= least[ok]]
            at[ok] += 1 << k
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from which ``at`` is reached over values of ``least`` or more."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            ok = np.flatnonzero(at >= 1 << k)
            ok = ok[self.levels[k][at[ok] - (1 << k) + 1] >= least[ok]]
            at[ok] -= 1 << k
        return at

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The minimum from ``first`` to ``last``."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level):
            ok = np.flatnonzero(level == k)
            table = self.levels[k]
            out[ok] = np.minimum(table[first[ok]], table[last[ok] - (1 << int(k)) + 1])
        return out


def _codes(key: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entries of each key as four numbers, and where each key's entries begin."""
    sizes = pc.binary_length(key).to_numpy(zero_copy_only=False).astype(np.int64) // CODE
    data = b"".join(key.cast(pa.binary()).to_pylist())
    return np.frombuffer(data, np.uint64).reshape(-1, CODE // 8), np.concatenate([[0], np.cumsum(sizes)])


def _shared(code: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Entries that each trail but the first shares with the one before it."""
    size = np.diff(begin)
    most = np.minimum(size[:-1], size[1:])
    pair = np.repeat(np.arange(len(most)), most)
    step = np.arange(len(pair)) - np.repeat(np.cumsum(most) - most, most)
    differs = (code[begin[:-2][pair] + step] != code[begin[1:-1][pair] + step]).any(axis=1) if len(pair) else np.zeros(0, bool)
    out = most.copy()
    np.minimum.at(out, pair[differs], step[differs])
    return out


def _neighbours(block_size: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted trails with their LCP and block; the keys at the ends of a batch go along."""
        partition, done, last, current = TaskContext.get().partitionId(), 0, None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            key = words.column(batch, "key")
            code, begin = _codes(pa.concat_arrays([pa.array([last or ""]).cast(key.type), key]))
            size = np.diff(begin)[1:]
            total = np.cumsum(size + 1) + done
            block = (partition << 32) + (total - size - 1) // block_size
            ends, first = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            ends[[0, -1]] = True
            first[0] = last is None
            yield pa.RecordBatch.from_arrays(
                [words.column(batch, "entity_id"), words.column(batch, "sizes"), pa.array(_shared(code, begin), mask=first), pa.array(block),
                 pa.array(np.diff(block, prepend=current) != 0), pa.array(total), pc.if_else(pa.array(ends), key, pa.scalar(None, key.type))],
                names=["entity_id", "sizes", "lcp", "block", "head", "place", "key"])
            done, last, current = int(total[-1]), key[-1].as_py(), int(block[-1])

    return find


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries that the first trail of a partition shares with the last one before it."""
    for batch in batches:
        shared = []
        for a, b in zip(words.column(batch, "before"), words.column(batch, "first")):
            code, begin = _codes(pa.concat_arrays([pa.array([a.as_py()]).cast(b.type), pa.array([b.as_py()]).cast(b.type)]))
            shared.append(int(_shared(code, begin)[0]))
        yield pa.RecordBatch.from_arrays([words.column(batch, "block"), pa.array(shared, pa.int64())], names=["block", "lcp"])


@dataclass
class Blocks:
    """The blocks in order: LCP of the first trail, and where a prefix crosses a whole block."""

    block: np.ndarray
    first: np.ndarray
    across: RangeMinimum

    @classmethod
    def of(cls, rows: list) -> Blocks:
        """From (block, first, inner): LCP of the first trail and least LCP of the others, null if there are none."""
        rows = sorted(rows)
        first = np.array([-1 if r[1] is None else r[1] for r in rows], np.int64)
        inner = np.array([np.iinfo(np.int64).max if r[2] is None else r[2] for r in rows], np.int64)
        return cls(np.array([r[0] for r in rows], np.int64), first, RangeMinimum(np.minimum(first, inner)))

    def home(self, at: int, depth: np.ndarray) -> np.ndarray:
        """The block where a prefix begins that holds the first trail of block ``at``."""
        place = np.full(len(depth), at)
        back = np.flatnonzero(self.first[at] >= depth)
        place[back] = self.across.left(place[back] - 1, depth[back])
        return self.block[place]


def _pieces(blocks: Blocks):
    def of_block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        at = int(np.searchsorted(blocks.block, rows["block"][0].as_py()))
        ids = rows["entity_id"].combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        size = rows["sizes"].combine_chunks()
        size = size.chunk(0) if isinstance(size, pa.ChunkedArray) else size
        length = pc.list_value_length(size).to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(length)
        first = int(blocks.first[at])
        following = int(blocks.first[at + 1]) if at + 1 < len(blocks.block) else -1
        lcp = rows["lcp"].fill_null(-1).to_numpy().astype(np.int64)
        shared = lcp.copy()
        lcp[0], shared[0] = -1, first
        # A prefix belongs to the first trail of the block that has it: lengths above the LCP.
        low = lcp + 1
        count = length - low + 1
        start = np.cumsum(count) - count
        row = np.repeat(np.arange(n), count)
        depth = low[row] + np.arange(len(row)) - start[row]
        table = RangeMinimum(lcp)
        last = table.right(row, depth)
        fresh = depth > shared[row]  # else it begins in an earlier block
        above = table.left(row, depth - 1)
        parent = np.where(depth > 0, start[above] + depth - 1 - low[above], -1)
        # Sums over trails, and over the entries of each trail.
        begin = np.cumsum(length) - length
        chars = np.concatenate([[0], np.cumsum(size.flatten().to_numpy().astype(np.int64))])
        upto = lambda trail, d: chars[begin[trail] + np.maximum(d, 0)] - chars[begin[trail]]
        sums = lambda x: np.concatenate([[0], np.cumsum(x)])
        everyone = np.arange(n)
        whole = upto(everyone, length)
        total, new = sums(whole), sums(whole - upto(everyone, np.minimum(shared, length)))
        leaf = sums(np.append(lcp[1:], following) < length)
        members = last - row + 1
        own = upto(row, length[row]) - upto(row, np.maximum(shared[row], depth - 1))
        saved = total[last + 1] - total[row] - members * upto(row, depth - 1) - (new[last + 1] - new[row + 1]) - own
        children = np.bincount(parent[fresh & (depth > 0)], minlength=len(row))
        order = pc.array_sort_indices(ids).to_numpy()
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        smallest = ids.take(pa.array(order[RangeMinimum(rank).least(row, last)]))
        edge = ~fresh | ((last == n - 1) & (depth <= following))
        home = np.where(fresh, blocks.block[at], 0)
        home[~fresh] = blocks.home(at, depth[~fresh])
        # Trails that end here are the first ones of the interval.
        text = ids.cast(pa.string()).to_pylist()
        alike = np.append(np.flatnonzero((lcp != length) | (np.append(-1, length[:-1]) != length)), n)
        until = dict(zip(alike[:-1].tolist(), alike[1:].tolist()))
        digest, ends = [NO_END] * len(row), [None] * len(row)
        for c in np.flatnonzero(depth == length[row]).tolist():
            joined = ",".join(text[row[c] : until[int(row[c])]])
            if edge[c]:
                ends[c] = joined
            else:
                digest[c] = hashlib.sha256(joined.encode()).hexdigest()
        open_parent = (depth > 0) & edge[parent]
        known = (depth > 0) & ~open_parent
        return pa.RecordBatch.from_arrays(
            [pa.array(home, mask=~edge), pa.array(np.full(len(row), blocks.block[at])), smallest, pa.array(depth),
             pa.array(np.where(open_parent, home[parent], -1 - np.arange(len(row)))),
             smallest.take(pa.array(np.maximum(parent, 0), mask=~known)), pa.array(members), pa.array(children),
             pa.array(leaf[last + 1] - leaf[row]), pa.array(saved), pa.array(digest, pa.string()), pa.array(ends, pa.string())],
            names=["home", "block", "entity_id", "depth", "parent_home", "parent_entity_id", "n_entities", "n_children",
                   "n_leaves", "saved_chars", "ends_sha256", "ends"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            block = words.column(batch, "block").to_numpy()
            borders = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(borders, borders[1:]):
                if hi == lo:
                    continue
                if held and words.column(held[0], "block")[0].as_py() != block[lo]:
                    yield of_block(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield of_block(pa.Table.from_batches(held))

    return find


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the joined ends of each prefix; its pieces come one after the other."""
    node, state = None, None
    for batch in batches:
        out = []
        for home, depth, ends in zip(*(words.column(batch, name).to_pylist() for name in ("home", "depth", "ends"))):
            if node == (home, depth):
                state.update(b",")
            else:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (home, depth), hashlib.sha256()
            state.update(ends.encode())
        yield _of_nodes(out)
    if node:
        yield _of_nodes([(*node, state.hexdigest())])


def _of_nodes(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["home", "depth", "digest"])


def prefix_trie(audit: DataFrame, entity: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per distinct prefix of the audit trails of ``audit`` (entity_id, id, action, new_value).

    The trail of an entity are its entries (action, new_value) by id, nulls first; null values read as empty.
    Entries of one id go by their digest; a repeated entry is one more entry.  Entries without entity_id are ignored.
    ``entity`` (entity_id) names entities that count even without entries.  Further columns are ignored.

    A node is a prefix, from the root (depth 0) on, and its members are the entities whose trail begins with it:
    (entity_id: the smallest member, depth, parent_entity_id: that of the prefix one entry shorter, null for the root,
    n_entities: members, n_children: nodes one entry longer, n_leaves: childless nodes in its subtree, itself included,
    saved_chars: over its subtree, (n_entities - 1) times the characters of the last entry's new_value,
    ends_sha256: lowercase SHA-256 of the comma-joined ids, ascending, of the members whose trail ends here).
    An empty audit without entities gives no rows.

    Entries are known by 128-bit digests of action and value; the digests of one trail are gathered in one row (32
    bytes an entry), no other group is.  The driver holds three numbers for each ``block`` of entries.
    """
    name = F.coalesce("action", F.lit(""))
    value = F.coalesce("new_value", F.lit(""))
    entry = F.struct(
        F.col("id").alias("id"), F.md5(F.concat(F.length(name).cast("string"), F.lit(":"), name, value)).alias("code"),
        F.length(value).alias("size"))
    given = audit.filter("entity_id IS NOT NULL").select("entity_id", entry.alias("entry"))
    if entity is not None:
        given = given.unionByName(entity.filter("entity_id IS NOT NULL").select("entity_id"), allowMissingColumns=True)
    trail = given.groupBy("entity_id").agg(F.array_sort(F.collect_list("entry")).alias("entries")).select(
        "entity_id", F.array_join(F.transform("entries", lambda e: e["code"]), "").alias("key"),
        F.transform("entries", lambda e: e["size"]).alias("sizes"))
    id_type = trail.schema["entity_id"].dataType.simpleString()
    order = ("key", "entity_id")
    near = cut(trail.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _neighbours(block), f"entity_id {id_type}, sizes array<int>, lcp long, block long, head boolean, place long, key string"))
    by_partition = near.filter("key IS NOT NULL").groupBy(F.shiftright("block", 32).alias("partition")).agg(
        F.min("block").alias("block"), F.min_by("key", "place").alias("first"), F.max_by("key", "place").alias("last"))
    border = by_partition.withColumn("before", F.lag("last").over(Window.orderBy("partition"))).filter(
        "before IS NOT NULL").select("block", "before", "first").mapInArrow(_between, "block long, lcp long")
    inside = near.groupBy("block").agg(F.min(F.when(F.col("head"), F.col("lcp"))).alias("first"), F.min(F.when(~F.col("head"), F.col("lcp"))).alias("inner"))
    rows = inside.join(border, "block", "left").select("block", F.coalesce("lcp", "first"), "inner").collect()
    piece = near.drop("key", "place", "head").mapInArrow(_pieces(Blocks.of([tuple(r) for r in rows])), f"""home long, block long,
        entity_id {id_type}, depth long, parent_home long, parent_entity_id {id_type}, n_entities long, n_children long,
        n_leaves long, saved_chars long, ends_sha256 string, ends string""")
    edge = cut(piece.filter("home IS NOT NULL"))
    sums = ("n_entities", "n_children", "n_leaves", "saved_chars")
    node = edge.groupBy("home", "depth").agg(
        F.min("entity_id").alias("entity_id"), F.max("parent_home").alias("parent_home"), *[F.sum(c).alias(c) for c in sums])
    digest = edge.filter("ends IS NOT NULL").select("home", "depth", "block", "ends").repartition("home", "depth").sortWithinPartitions(
        "home", "depth", "block").mapInArrow(_digests, "home long, depth long, digest string")
    node = cut(node.join(digest, ["home", "depth"], "left"))
    both = piece.filter("home IS NULL").select("entity_id", "depth", "parent_home", "parent_entity_id", *sums, "ends_sha256").unionByName(
        node.select("entity_id", "depth", "parent_home", F.lit(None).cast(id_type).alias("parent_entity_id"), *sums,
                    F.coalesce("digest", F.lit(NO_END)).alias("ends_sha256")))
    # Parents that are known inside the block have a parent_home that is below 0 and meets nothing.
    parent = node.select(F.col("home").alias("parent_home"), (F.col("depth") + 1).alias("depth"), F.col("entity_id").alias("open_parent"))
    return both.join(parent, ["parent_home", "depth"], "left").select(
        "entity_id", "depth", F.coalesce("parent_entity_id", "open_parent").alias("parent_entity_id"), *sums, "ends_sha256")
