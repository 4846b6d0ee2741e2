"""Mixing sources to target weights by weighted fair queueing.

DataFrame operations only.  Every source is a queue of its documents in shuffled order,
twice over.  A copy's virtual finish time is the words its queue has served up to and
including it, divided by the source's target; at time 1 every source has served its
target.  The copies are ranked by finish time over all sources and the ranking is cut at
the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelight.llm.storage import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words
MOST = 2  # times a document, and so a source, may be used
BUCKETS = 4096  # ranges of the shuffled order and, at two levels, of the finish time


def word_count(content: str = "content") -> Column:
    """Runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; null has none."""
    return F.coalesce(F.expr(rf"regexp_count({content}, r'[^\x20\x09-\x0D]+')"), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, rank, source_size, target) of frames with source and size.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all words.  What a
    source would get beyond ``MOST`` times its size goes to the others by weight until none is above: the
    level at which the capped shares add up is the largest of the levels at which the sources of least
    cap for their weight are full.
    """
    everything = Window.partitionBy()
    by_source = everything.orderBy(F.col("source").asc_nulls_last())
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), "rank")
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = total.withColumn("rank", F.row_number().over(by_source) - 1).withColumn("cap", MOST * F.col("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight)
    full = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(everything) - full) / open_weight
    return weighed.withColumn("level", level).select(
        "source", "rank", "source_size",
        F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight")).alias("target"))


def mix(block: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = 42) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) of every row of ``block`` (doc_id, content, source).

    ``taken`` is 0, 1 or 2 times ``size``; whole documents are taken, so a source misses its target
    by less than a document or so.  A null source is a source; null and empty content has size 0 and is
    taken 0.  Repeated rows are documents of their own.  The order is a hash of doc_id, so reruns agree.
    An empty block gives no rows.  Further columns of ``block`` are ignored.
    """
    sized = cut(block.select("doc_id", "source", word_count().alias("size")))
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    goal = targets(sized, weights, share).withColumnRenamed("source", "queue")
    queued = (
        sized.join(goal, F.col("source").eqNullSafe(F.col("queue")))
        .select("doc_id", "source", "size", "rank", "source_size", "target", order.alias("order"),
                F.pmod(F.shiftright(order, 20), F.lit(BUCKETS)).alias("bucket"))
    )
    # Words before each range of a queue, then within the range: no task holds a whole source.
    ahead = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = queued.groupBy("rank", "bucket").agg(F.sum("size").alias("words")).select(
        "rank", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rank", "bucket").orderBy("order", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    served = queued.withColumn("served", F.sum("size").over(inside)).join(base, ["rank", "bucket"]).select(
        "doc_id", "source", "size", "rank", "source_size", "target", (F.col("served") + F.col("base")).alias("served"))
    served = cut(served)

    def finish(copy: int) -> Column:
        return (F.col("served") + copy * F.col("source_size")) / F.col("target")

    def fine(time: Column) -> Column:
        return F.floor(F.least(time, F.lit(2.0)) * (BUCKETS * BUCKETS))

    copies = served.filter("size > 0").select(
        "size", "rank", "served",
        F.explode(F.array(*[F.struct(F.lit(c).alias("copy"), finish(c).alias("finish")) for c in range(MOST)])).alias("c"),
    ).select("size", "rank", "served", "c.*", fine(F.col("c.finish")).alias("fine"))
    budget = goal.agg(F.sum("target").alias("budget"))

    def cut_range(rows: DataFrame, key: Column, spent: DataFrame) -> DataFrame:
        """(key, before): the first range in which the words pass the budget, and the words before it."""
        so_far = Window.partitionBy().orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = rows.groupBy(key.alias("key")).agg(F.sum("size").alias("words"))
        after = F.sum("words").over(so_far) + F.coalesce(spent.scalar(), F.lit(0))
        over = sums.select("key", "words", after.alias("after")).filter(F.col("after") > budget.scalar())
        return cut(over.agg(F.min("key").alias("key"), F.min_by(F.col("after") - F.col("words"), "key").alias("before")))

    nothing = budget.select(F.lit(0))
    wide = cut_range(copies, F.floor(F.col("fine") / BUCKETS), nothing)
    in_wide = copies.filter(F.floor(F.col("fine") / BUCKETS) == wide.select("key").scalar())
    narrow = cut_range(in_wide, F.col("fine"), wide.select("before"))
    place = F.struct("finish", "rank", "copy", "served")
    rank = Window.partitionBy().orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        in_wide.filter(F.col("fine") == narrow.select("key").scalar()).select("size", place.alias("place"))
        .select("place", (F.sum("size").over(rank) + narrow.select("before").scalar()).alias("after"))
        .filter(F.col("after") <= budget.scalar()).agg(F.max("place").alias("place"))
    )
    edge = cut(narrow.select("key", last.scalar().alias("place")))

    def taken(copy: int) -> Column:
        time = finish(copy)
        here = F.struct(time.alias("finish"), F.col("rank"), F.lit(copy).alias("copy"), F.col("served"))
        key = edge.select("key").scalar()
        # Without an edge the budget covers every copy.
        return F.when(key.isNull() | (fine(time) < key), 1).when(
            (fine(time) == key) & (here <= edge.select("place").scalar()), 1).otherwise(0)

    times = sum((taken(c) for c in range(MOST)), F.lit(0))
    return served.select(
        "doc_id", "size", "source", "source_size", "target",
        F.when(F.col("size") > 0, F.col("size") * times).otherwise(F.lit(0)).cast("long").alias("taken"))
