"""Ordered operators that survive a key holding a large share of all rows.

A plain ``Window.partitionBy(doc)`` sends a whole document to one task.  The
helpers here cut every key into segments of bounded length, scan each segment
on its own and carry a one-row summary from segment to segment, so the largest
task is one segment and the per-key sequential part sees one row per segment.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT_ROWS = 50_000
SEGMENT = "__segment"


@dataclass(frozen=True)
class Scan:
    """One running value: ``kind`` over ``expr``, optionally excluding the row."""

    kind: str  # sum | min | max | last | next
    expr: Column
    exclusive: bool = False
    wrapped: bool = False  # the value travels in a struct so that null counts as a value


def running_sum(expr, exclusive=False):
    return Scan("sum", expr, exclusive)


def running_min(expr, exclusive=False):
    return Scan("min", expr, exclusive)


def running_max(expr, exclusive=False):
    return Scan("max", expr, exclusive)


def last_value(expr, exclusive=False):
    """Latest non-null value at or before the row."""
    return Scan("last", expr, exclusive)


def previous(expr):
    """Value of the row before, null included; null on the first row."""
    return Scan("last", F.struct(expr.alias("v")), True, True)


def following(expr):
    """Value of the row after, null included; null on the last row."""
    return Scan("next", F.struct(expr.alias("v")), True, True)


def next_value(expr, exclusive=True):
    """Nearest later non-null value."""
    return Scan("next", expr, exclusive)


def row_position():
    """1-based position of the row in its key."""
    return Scan("sum", F.lit(1).cast("bigint"))


def segment_of(order_col: Column, rows: int | None = None) -> Column:
    """Segment number of a dense integer position."""
    return F.floor(order_col / F.lit(rows or SEGMENT_ROWS))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    scans: dict[str, Scan],
    segment: Sequence[Column] | None = None,
) -> DataFrame:
    """Add one column per scan, ordered by ``order`` within ``keys``.

    ``segment`` must be non-decreasing along ``order``; by default it is the
    first order column divided into ranges of ``SEGMENT_ROWS``.

    Rows are shuffled once, by key and segment.  The summary branch reads that same
    exchange, so a chain of scans costs one shuffle each and nothing is computed twice.
    """
    keys, order = list(keys), list(order)
    segment = list(segment) if segment is not None else [segment_of(F.col(order[0]))]
    seg = [f"s{i}" for i in range(len(segment))]
    inp = {name: f"__in_{name}" for name in scans}
    home = F.struct(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[c.alias(n) for c, n in zip(segment, seg)]
    )
    base = df.select("*", home.alias(SEGMENT), *[s.expr.alias(inp[n]) for n, s in scans.items()]).repartition(SEGMENT)
    position = F.struct(*order)

    def summary(name: str, scan: Scan) -> Column:
        value = F.col(inp[name])
        if scan.kind in ("last", "next"):
            pick = F.max_by if scan.kind == "last" else F.min_by
            return pick(value, F.when(value.isNotNull(), position)).alias(name)
        return getattr(F, scan.kind)(value).alias(name)

    # Reading every column keeps column pruning from splitting the shared exchange in two.
    whole = F.max(F.xxhash64(*[_hashable(f) for f in base.schema])).alias("__whole")
    per_segment = base.groupBy(SEGMENT).agg(*[summary(n, s) for n, s in scans.items()], whole).filter(
        "__whole IS NOT NULL"
    )
    by_key = Window.partitionBy(*[f"{SEGMENT}.k{i}" for i in range(len(keys))])
    earlier = by_key.orderBy(*[f"{SEGMENT}.{s}" for s in seg]).rowsBetween(Window.unboundedPreceding, -1)
    later = by_key.orderBy(*[F.col(f"{SEGMENT}.{s}").desc() for s in seg]).rowsBetween(Window.unboundedPreceding, -1)
    carried = {n: f"__carry_{n}" for n in scans}

    def carry(name: str, scan: Scan) -> Column:
        value = F.col(name)
        if scan.kind in ("last", "next"):
            return F.last(value, ignorenulls=True).over(earlier if scan.kind == "last" else later)
        return getattr(F, scan.kind)(value).over(earlier)

    # Only keys longer than one segment leave rows here: usually none, and then AQE drops the join.
    carries = per_segment.select(SEGMENT, *[carry(n, s).alias(carried[n]) for n, s in scans.items()])
    carries = carries.filter(reduce(or_, [F.col(c).isNotNull() for c in carried.values()]))
    joined = base.join(carries, SEGMENT, "left")
    inside = Window.partitionBy(SEGMENT).orderBy(*order)

    def local(scan: Scan, name: str) -> Column:
        value = F.col(inp[name])
        if scan.kind == "next":
            start = 1 if scan.exclusive else Window.currentRow
            return F.first(value, ignorenulls=True).over(inside.rowsBetween(start, Window.unboundedFollowing))
        w = inside.rowsBetween(Window.unboundedPreceding, -1 if scan.exclusive else Window.currentRow)
        if scan.kind == "last":
            return F.last(value, ignorenulls=True).over(w)
        return getattr(F, scan.kind)(value).over(w)

    def merged(name: str, scan: Scan) -> Column:
        here, before = F.col(f"__here_{name}"), F.col(carried[name])
        if scan.kind == "sum":
            out = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        elif scan.kind == "min":
            out = F.least(here, before)
        elif scan.kind == "max":
            out = F.greatest(here, before)
        else:
            out = F.coalesce(here, before)
        return (out["v"] if scan.wrapped else out).alias(name)

    scanned = joined.select(
        *df.columns, *carried.values(), *[local(s, n).alias(f"__here_{n}") for n, s in scans.items()]
    )
    return scanned.select(*df.columns, *[merged(n, s) for n, s in scans.items()])


def _hashable(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    return F.map_entries(col) if isinstance(field.dataType, T.MapType) else col


def neighbours(
    df: DataFrame, keys: Sequence[str], position: str, picks: dict[str, tuple[int, Column]]
) -> DataFrame:
    """Values a fixed number of rows away; ``position`` must be dense.

    ``picks`` maps a new column to (offset, value): -1 is the row before, 1 the row after.
    One shuffle by key and segment, no join.
    """
    before = max([-o for o, _ in picks.values()] + [0])
    after = max([o for o, _ in picks.values()] + [0])
    spread = with_halo(df, keys, position, before, after)
    w = Window.partitionBy(*keys, SEGMENT).orderBy(position)
    looked = spread.select(
        "*", *[(F.lag(v, -o) if o < 0 else F.lead(v, o)).over(w).alias(n) for n, (o, v) in picks.items()]
    )
    return looked.filter("__core").drop(SEGMENT, "__core")


def with_halo(
    df: DataFrame, keys: Sequence[str], position: str, before: int, after: int, rows: int | None = None
) -> DataFrame:
    """Repeat the rows next to a segment border in the neighbouring segment.

    ``position`` must be dense (0, 1, 2, ...) within ``keys``.  The result has
    ``__segment`` and ``__core``; windows of at most ``before``/``after`` rows
    partitioned by keys and ``__segment`` are then exact on the core rows.
    """
    rows = rows or SEGMENT_ROWS
    pos = F.col(position)
    home = F.floor(pos / rows)
    offset = pos % rows
    copies = F.array_compact(
        F.array(
            home,
            F.when(offset < after, home - 1),
            F.when(offset >= rows - before, home + 1),
        )
    )
    return df.select("*", F.explode(copies).alias(SEGMENT)).withColumn(
        "__core", F.col(SEGMENT) == F.floor(pos / rows)
    )


def renumber(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, segment=None) -> DataFrame:
    """Dense 0-based position after rows were filtered out."""
    out = running(df, keys, order, {name: row_position()}, segment)
    return out.withColumn(name, F.col(name) - 1)
