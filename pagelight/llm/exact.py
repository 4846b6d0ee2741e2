"""Exact duplicates by a minimal perfect hash over the digests of earlier content.

The distinct digests of historical content are dealt to shards of bounded size.  In each
shard a minimal perfect hash gives every digest its own slot, which holds the whole digest, the
document that won it and the number of copies.  A digest that arrives reads one slot and
compares all its bytes: a member repeats historical content, the nonmembers are grouped
among themselves.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelight.llm.words import U64, mix

SHARD_DIGESTS = 50_000  # mean number of historical digests in a shard
DIGEST_BYTES = 32
LOAD = 2  # bits per key at each level of the hash
LEVELS = 48
NO_ID = (1 << 63) - 1  # in place of null while groups are resolved


def digest(content: str = "content") -> Column:
    """SHA-256 of the content with every run of white space as one space; null reads as empty."""
    return F.expr(rf"unhex(sha2(regexp_replace(coalesce({content}, ''), r'[\x20\x09-\x0D]+', ' '), 256))")


class MinimalPerfectHash:
    """Slots 0 to n - 1 for n distinct keys of two 64-bit words.

    At each level the keys left fall on a bit array; a key alone on its bit stays there and
    its slot is the rank of the bit.  The others go on to the next level.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # bits, slot of each set bit
        slot, left = 0, keys
        while len(left) and len(self.levels) < LEVELS:
            place = self._place(left, len(self.levels), LOAD * len(left))
            alone = np.bincount(place, minlength=LOAD * len(left)) == 1
            self.levels.append((alone, slot - 1 + np.cumsum(alone)))
            slot += int(alone.sum())
            left = left[~alone[place]]
        #: Keys that still collide; in practice there are none.
        self.rest = {key.tobytes(): slot + i for i, key in enumerate(left)}

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys[:, 0] ^ mix(keys[:, 1], level), level + 1) % U64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; any slot, or -1, for a key that is not in the set."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, slot) in enumerate(self.levels):
            place = self._place(keys[open_], level, len(alone))
            hit = alone[place]
            out[open_[hit]] = slot[place[hit]]
            open_ = open_[~hit]
        for i in open_ if self.rest else ():
            out[i] = self.rest.get(keys[i].tobytes(), -1)
        return out


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, DIGEST_BYTES)


def _resolve(historical: pd.DataFrame, arriving: pd.DataFrame) -> pd.DataFrame:
    """One row per distinct digest of a shard: who stays and how many copies there are."""
    names = ["digest", "keep_id", "group_size", "member"]
    # A side without rows comes without columns.
    historical, arriving = historical.reindex(columns=names[:3]), arriving.reindex(columns=names[:3])
    known, new = _bytes(historical["digest"]), _bytes(arriving["digest"])
    keys = known[:, :16].copy().view(U64)
    table = MinimalPerfectHash(keys)
    slot_of = table.slots(keys)
    digests = np.empty_like(known)
    winner, count = np.empty(len(known), np.int64), np.empty(len(known), np.int64)
    digests[slot_of] = known
    winner[slot_of], count[slot_of] = historical["keep_id"], historical["group_size"]
    slot = table.slots(new[:, :16].copy().view(U64))
    member = slot >= 0
    member[member] = (digests[slot[member]] == new[member]).all(axis=1)
    hit = slot[member]
    winner[hit] = np.minimum(winner[hit], arriving["keep_id"].to_numpy(np.int64)[member])
    count[hit] += arriving["group_size"].to_numpy(np.int64)[member]
    merged = pd.DataFrame({"digest": [d.tobytes() for d in digests], "keep_id": winner, "group_size": count})
    merged["member"] = True
    alone = arriving.loc[~member, ["digest", "keep_id", "group_size"]].assign(member=False)
    return pd.concat([merged, alone])[names]


def exact_duplicates(block: DataFrame, historical: Column) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, historical_digest) of every row of ``block`` (doc_id, content).

    ``historical`` tells the rows whose digests make the perfect hash.  Content is equal when it is identical
    after every run of white space became one space; null counts as empty.  The smallest doc_id of a group
    stays, historical or not.  Rows that repeat a doc_id and its content count in ``group_size`` and share
    one answer; a null doc_id stays only in a group without another.  An empty block gives no rows; without historical rows all digests are grouped as new.
    Further columns of ``block`` are ignored.

    Copies are aggregated before they are shuffled, so a shard reads every digest once however often it occurs.
    """
    shards = max(1, -(-block.count() // SHARD_DIGESTS))

    def distinct(old: bool) -> DataFrame:
        part = block.filter(F.coalesce(historical, F.lit(False)) == old).select("doc_id", digest().alias("digest"))
        part = part.groupBy("digest").agg(
            F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        return part.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards))).groupBy("shard")

    resolved = distinct(True).cogroup(distinct(False)).applyInPandas(
        _resolve, "digest binary, keep_id long, group_size long, member boolean")
    rows = block.select("doc_id", digest().alias("digest"))
    keep = F.nullif("keep_id", F.lit(NO_ID))
    return rows.join(resolved, "digest").select(
        "doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), "digest",
        F.col("member").alias("historical_digest"))
