"""Figures and images of a page matched by the area they share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOUNDS = ("x0", "y0", "x1", "y1")
PAGE = ["doc_id", "page"]


def _boxes(figures: DataFrame, images: DataFrame) -> DataFrame:
    """Both sides with the grid of their page and its first image.

    A cell is as wide as an average box and a page has no more cells than boxes, so a box lies in few cells
    unless it overlaps much of the page.
    """
    columns = [*PAGE, "ord", *BOUNDS]
    both = images.select(*columns, F.lit(True).alias("is_image")).unionByName(figures.select(*columns, F.lit(False).alias("is_image")))
    real = " AND ".join(f"coalesce(abs({c}) < double('Infinity'), false)" for c in BOUNDS)
    both = both.withColumn("real", F.expr(f"{real} AND x1 > x0 AND y1 > y0"))
    grid = both.groupBy(*[F.col(c).alias(f"__{c}") for c in PAGE]).agg(
        F.min(F.when(F.col("is_image"), F.col("ord"))).alias("first_image"),
        F.expr("""greatest(avg(x1 - x0) FILTER (WHERE real), avg(y1 - y0) FILTER (WHERE real),
            (max(x1) FILTER (WHERE real) - min(x0) FILTER (WHERE real)) / sqrt(count_if(real)),
            (max(y1) FILTER (WHERE real) - min(y0) FILTER (WHERE real)) / sqrt(count_if(real))) AS cell"""))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in PAGE]
    return both.join(grid, same).drop(*[f"__{c}" for c in PAGE])


def _overlaps(boxes: DataFrame) -> DataFrame:
    """(doc_id, page, figure_ord, image_ord, area) of the pairs that share an area, by an equality join on the cells.

    A pair meets in every cell both lie in and counts in the one that holds the corner where both begin.
    """
    cells = """explode(flatten(transform(sequence(floor(x0 / cell), floor(x1 / cell)),
        cx -> transform(sequence(floor(y0 / cell), floor(y1 / cell)), cy -> named_struct('cx', cx, 'cy', cy))))) AS at"""
    placed = boxes.filter("real").select("*", F.expr(cells)).select(*PAGE, "at.cx", "at.cy", "cell", "ord", *BOUNDS, "is_image")
    figure, image = placed.filter("NOT is_image").alias("f"), placed.filter("is_image").alias("i")
    met = figure.join(image, [F.col(f"f.{c}").eqNullSafe(F.col(f"i.{c}")) for c in (*PAGE, "cx", "cy")])
    return met.filter("floor(greatest(f.x0, i.x0) / f.cell) = f.cx AND floor(greatest(f.y0, i.y0) / f.cell) = f.cy").selectExpr(
        "f.doc_id", "f.page", "f.ord AS figure_ord", "i.ord AS image_ord",
        "(least(f.x1, i.x1) - greatest(f.x0, i.x0)) AS w", "(least(f.y1, i.y1) - greatest(f.y0, i.y0)) AS h",
    ).filter("w > 0 AND h > 0").selectExpr(*PAGE, "figure_ord", "image_ord", "w * h AS area")


def _with_overlaps(figures: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Every figure with the rows of ``overlaps``; a figure without any has one row without image."""
    found = overlaps.withColumnsRenamed({c: f"__{c}" for c in (*PAGE, "figure_ord")})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in PAGE] + [F.col("ord") == F.col("__figure_ord")]
    return figures.join(found, same, "left")


def best_overlap(figures: DataFrame, images: DataFrame) -> DataFrame:
    """Image of largest shared area per figure, the first one on ties; the first image of the page where none is shared.

    ``ord`` tells the boxes of a page and side apart.  Without four finite bounds a box shares nothing.
    """
    boxes = _boxes(figures, images)
    best = _overlaps(boxes).groupBy(*PAGE, "figure_ord").agg(
        F.expr("max_by(struct(image_ord, area), struct(area, -image_ord)) AS b"))
    return _with_overlaps(boxes.filter("NOT is_image AND first_image IS NOT NULL"), best).select(
        *PAGE, F.col("ord").alias("figure_ord"), F.coalesce("b.image_ord", "first_image").alias("image_ord"),
        F.coalesce("b.area", F.lit(0.0)).alias("area"))


def assign_images(figures: DataFrame, images: DataFrame) -> DataFrame:
    """Figures in order take the image of largest shared area that is still free, or else the first free one.

    Pairs that share an area come from an equality join on grid cells.  What each figure can take is then read in order, page
    by page: every pair is looked at once, and the first free image only moves on, so a page costs its boxes and the
    pairs that overlap.  A task remembers which images of one page are free.
    """
    boxes = _boxes(figures, images)
    asked = _with_overlaps(boxes.filter("NOT is_image"), _overlaps(boxes)).select(
        *PAGE, F.lit(1).alias("side"), "ord", F.coalesce("area", F.lit(0.0)).alias("area"), "image_ord")
    offered = boxes.filter("is_image").select(*PAGE, F.lit(0).alias("side"), "ord", F.lit(0.0).alias("area"), F.lit(None).cast("bigint").alias("image_ord"))
    ordered = offered.unionByName(asked).repartition(*PAGE).sortWithinPartitions(*PAGE, "side", "ord", F.desc("area"), "image_ord")
    return ordered.mapInArrow(_take, "doc_id bigint, page int, figure_ord bigint, image_ord bigint, area double")


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    page, figure, offered, free, first = None, None, [], {}, 0
    waiting = None  # the figure that has found no free image of its own yet

    def settle() -> list[tuple]:
        """The first free image for the figure that found none."""
        nonlocal first, waiting
        while first < len(offered) and not free[offered[first]]:
            first += 1
        out = []
        if waiting is not None and first < len(offered):
            free[offered[first]] -= 1
            out = [(*page, waiting, offered[first], 0.0)]
        waiting = None
        return out

    for batch in batches:
        out = []
        for doc, number, side, place, area, image in zip(*(column.to_pylist() for column in batch.columns)):
            if (doc, number) != page:
                out += settle()
                page, figure, offered, free, first = (doc, number), None, [], {}, 0
            if side == 0:
                offered.append(place)
                free[place] = free.get(place, 0) + 1
                continue
            if place != figure:
                out += settle()
                figure = waiting = place
            if waiting is not None and image is not None and free[image]:
                free[image] -= 1
                out.append((doc, number, figure, image, area))
                waiting = None
        yield _matches(out)
    yield _matches(settle())


def _matches(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["doc_id", "page", "figure_ord", "image_ord", "area"])
