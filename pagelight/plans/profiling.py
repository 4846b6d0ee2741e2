"""Page and document profiles."""

from __future__ import annotations

from pagelight.operators import profiling as P
from pagelight.plans.registry import query
from pagelight.sources import seeded

#: Scanned pages are empty; some lines make a page of their first word or words and one of the rest.
_FIRST = "split_part(line, ' ', 1)"
_SECOND = "concat(split_part(line, ' ', 1), ' ', split_part(line, ' ', 2), ' ', split_part(line, ' ', 3), ' ', split_part(line, ' ', 4))"
_TEXT = f"""CASE WHEN doc_id % 4 = 1 AND h % 13 <> 0 THEN '' WHEN h % 7 = 0 THEN '  '
 WHEN h % 7 = 1 THEN CASE i WHEN 1 THEN {_FIRST} ELSE substr(line, length({_FIRST}) + 2) END
 WHEN h % 7 = 2 THEN CASE i WHEN 1 THEN {_SECOND} ELSE substr(line, length({_SECOND}) + 2) END ELSE line END"""

_PAGES = f"""WITH {seeded.SQL_LINES}, pg AS (SELECT doc_id, CAST(2 * seq + i - 1 AS INT) AS page_num, {_TEXT} AS text
 FROM (SELECT *, unnest(range(1, 3)) AS i FROM lines) WHERE i = 1 OR h % 7 IN (1, 2))"""


def _pages(spark, sf_dir):
    parts = seeded.lines(spark, sf_dir).selectExpr("*", "explode(CASE WHEN h % 7 IN (1, 2) THEN array(1, 2) ELSE array(1) END) AS i")
    return parts.selectExpr("doc_id", "2 * seq + i - 1 AS page_num", f"{_TEXT} AS text")


_PROFILE = _PAGES + """, pf AS (SELECT doc_id, page_num, length(trim(text)) AS char_count, length(trim(text)) >= 20 AS has_text, round_even(least(1.0, length(trim(text)) / 2000.0), 3) AS text_coverage,
 round_even(1.0 - least(1.0, length(trim(text)) / 2000.0), 3) AS image_coverage, CASE WHEN length(trim(text)) >= 20 THEN 'adobe' ELSE 'ocr' END AS route FROM pg)"""


@query("page_profile", _PROFILE + "SELECT doc_id, page_num, char_count, has_text, route, CAST(round(text_coverage * 100, 0) AS INT) AS coverage_pct FROM pf")
def page_profile(spark, sf_dir):
    return P.page_profile(_pages(spark, sf_dir)).selectExpr(
        "doc_id", "page_num", "char_count", "has_text", "route", "CAST(round(text_coverage * 100, 0) AS INT) AS coverage_pct")


@query("document_route", _PROFILE + """SELECT doc_id, count(*) AS pages, count(*) FILTER (route = 'ocr') AS ocr_pages, CASE WHEN count(*) FILTER (route = 'ocr') = 0 THEN 'all_adobe'
 WHEN count(*) FILTER (route = 'ocr') = count(*) THEN 'all_ocr' ELSE 'mixed' END AS overall_route FROM pf GROUP BY doc_id""")
def document_route(spark, sf_dir):
    return P.document_route(P.page_profile(_pages(spark, sf_dir)))


@query("scanned_guard", _PAGES + """, ct AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (length(trim(text)) >= 50) AS text_pages FROM pg GROUP BY 1)
SELECT d.doc_id, coalesce(pages, 0) AS pages, coalesce(text_pages, 0) AS text_pages, CASE WHEN pages IS NULL THEN 'no_pages' WHEN text_pages / pages < 0.1 THEN 'scanned' ELSE 'ok' END AS verdict
 FROM documents d LEFT JOIN ct USING (doc_id)""")
def scanned_guard(spark, sf_dir):
    return P.scanned_guard(seeded.read_table(spark, sf_dir, "documents"), _pages(spark, sf_dir))
