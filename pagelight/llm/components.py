"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.llm.storage import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in ``edges`` (a, b): ``root`` is the smallest id it is connected to.

    Every round links the neighbours of an id to the smallest of them, first the larger neighbours, then
    the smaller ones; the graph ends as stars after a number of rounds that grows with the logarithm of
    the longest path.  Rows are aggregated before they are joined, and each round is stored.
    """
    edges = cut(_down(edges.select("a", "b")))
    state = _fingerprint(edges)
    while state[0]:
        both = edges.select(F.explode(F.array(
            F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")),
        )).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _down(both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        )).alias("e")).select("e.*")
        edges = cut(_down(small))
        now = _fingerprint(edges)
        if now == state:
            break
        state = now
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("root")),
                                          F.struct(F.col("b").alias("id"), F.col("b").alias("root")))).alias("e"))
    return ends.select("e.*").distinct()


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0
