"""Page and document profiles: which pages carry text and how a document is routed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.functions.text import q_strip

MIN_CHARS, FULL_PAGE, MIN_TEXT_PAGE, SCANNED_SHARE = 20, 2000.0, 50, 0.1


def page_profile(page: DataFrame) -> DataFrame:
    chars = f"length({q_strip('coalesce(text, chr(32))')})"
    sized = page.selectExpr("doc_id", "page_num", f"{chars} AS char_count")
    return sized.selectExpr(
        "doc_id", "page_num", "char_count", f"char_count >= {MIN_CHARS} AS has_text",
        f"bround(least(1.0D, char_count / {FULL_PAGE}), 3) AS text_coverage",
        f"bround(1.0D - least(1.0D, char_count / {FULL_PAGE}), 3) AS image_coverage",
        f"CASE WHEN char_count >= {MIN_CHARS} THEN 'adobe' ELSE 'ocr' END AS route")


def document_route(profile: DataFrame) -> DataFrame:
    return profile.groupBy("doc_id").agg(
        F.expr("count(*) AS pages"), F.expr("count_if(route = 'ocr') AS ocr_pages")
    ).selectExpr(
        "doc_id", "pages", "ocr_pages",
        "CASE WHEN ocr_pages = 0 THEN 'all_adobe' WHEN ocr_pages = pages THEN 'all_ocr' ELSE 'mixed' END AS overall_route")


def scanned_guard(doc: DataFrame, page: DataFrame) -> DataFrame:
    """Documents refused as scans; a document without pages is an error, not a scan."""
    chars = f"length({q_strip('coalesce(text, chr(32))')})"
    counts = page.groupBy("doc_id").agg(
        F.expr("count(*) AS pages"), F.expr(f"count_if({chars} >= {MIN_TEXT_PAGE}) AS text_pages"))
    return doc.select("doc_id").join(counts, "doc_id", "left").selectExpr(
        "doc_id", "coalesce(pages, 0) AS pages", "coalesce(text_pages, 0) AS text_pages",
        f"CASE WHEN coalesce(pages, 0) = 0 THEN 'no_pages' WHEN text_pages / pages < {SCANNED_SHARE} THEN 'scanned' ELSE 'ok' END AS verdict")
