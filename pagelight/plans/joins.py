"""Matching figures with images, and contents of embedded images."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelight.operators import matching as M
from pagelight.plans.registry import query
from pagelight.sources import seeded

_BOX = "CAST(l_partkey % 400 AS DOUBLE) AS x0, CAST(l_suppkey % 400 AS DOUBLE) AS y0, CAST(l_partkey % 400 + 20 + l_quantity * 3 AS DOUBLE) AS x1, CAST(l_suppkey % 400 + 20 + l_quantity * 2 AS DOUBLE) AS y1"


def _sides(spark, sf_dir):
    items = seeded.read_table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS doc_id", "0 AS page", "CAST(l_linenumber * 1000000000000L + l_partkey * 1000000L + l_suppkey * 100L + l_quantity AS BIGINT) AS ord", "l_linenumber", *_BOX.split(", "))
    return (items.filter("l_linenumber % 2 = 0").drop("l_linenumber"), items.filter("l_linenumber % 2 = 1").drop("l_linenumber"))


@query("figure_image_best_overlap", f"""WITH it AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + l_quantity AS BIGINT) AS ord, l_linenumber, {_BOX} FROM lineitem),
pr AS (SELECT f.doc_id, f.ord AS fig, i.ord AS img, greatest(0, least(f.x1, i.x1) - greatest(f.x0, i.x0)) * greatest(0, least(f.y1, i.y1) - greatest(f.y0, i.y0)) AS area
 FROM it f JOIN it i ON f.doc_id = i.doc_id AND f.l_linenumber % 2 = 0 AND i.l_linenumber % 2 = 1)
SELECT doc_id, fig AS figure_ord, img AS image_ord, area FROM pr QUALIFY row_number() OVER (PARTITION BY doc_id, fig ORDER BY area DESC, img) = 1""")
def figure_image_best_overlap(spark, sf_dir):
    figures, images = _sides(spark, sf_dir)
    return M.best_overlap(figures.distinct(), images.distinct()).select("doc_id", "figure_ord", "image_ord", "area")


@query("figure_image_assignment", f"""WITH RECURSIVE it AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + l_quantity AS BIGINT) AS ord, l_linenumber, {_BOX} FROM lineitem),
fg AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM it WHERE l_linenumber % 2 = 0),
pr AS (SELECT f.doc_id, f.n, f.ord AS fig, list({{'img': i.ord, 'area': greatest(0, least(f.x1, i.x1) - greatest(f.x0, i.x0)) * greatest(0, least(f.y1, i.y1) - greatest(f.y0, i.y0))}} ORDER BY i.ord) AS cs
 FROM fg f LEFT JOIN it i ON f.doc_id = i.doc_id AND i.l_linenumber % 2 = 1 GROUP BY ALL),
walk AS (SELECT doc_id, CAST(0 AS BIGINT) AS n, NULL::BIGINT AS fig, NULL::BIGINT AS img, NULL::DOUBLE AS area, CAST([] AS BIGINT[]) AS used FROM fg WHERE n = 1 UNION ALL
 SELECT doc_id, n, fig, b.img, b.area, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.img) END FROM (SELECT doc_id, n, fig, used,
  list_sort(free, 'DESC', 'NULLS LAST')[1].c AS b FROM (SELECT p.doc_id, p.n, p.fig, w.used, list_transform(list_filter(p.cs, lambda c: c.img IS NOT NULL AND NOT list_contains(w.used, c.img)),
   lambda c: {{'a': c.area, 'o': -c.img, 'c': c}}) AS free FROM walk w JOIN pr p ON p.doc_id = w.doc_id AND p.n = w.n + 1)))
SELECT doc_id, 0 AS page, fig AS figure_ord, img AS image_ord, area FROM walk WHERE img IS NOT NULL""")
def figure_image_assignment(spark, sf_dir):
    """Each image used once, figures served in order; the comparison walks the figures one by one."""
    figures, images = _sides(spark, sf_dir)
    return M.assign_images(figures.distinct(), images.distinct())
