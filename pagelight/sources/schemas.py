"""Column contracts of the corpus tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

BLOCK_TYPES = ("heading", "paragraph", "table", "image", "list", "form_field")
BLOCK_SOURCES = ("adobe", "ocr", "manual_override", "pypdf_fallback")
REMEDIATION_STATUSES = ("raw", "ai_drafted", "human_reviewed", "approved", "flagged")

DOC = "doc_id bigint, filename string, page_count int, language string, metadata map<string,string>"
PAGE = "doc_id bigint, page_num int, width double, height double, has_text boolean, text string"
BLOCK = (
    "doc_id bigint, seq int, page_num int, block_id string, block_type string, content string, "
    "x1 double, y1 double, x2 double, y2 double, confidence double, source string, status string, "
    "level int, alt string, src string, image_id string, caption string, headers array<string>, "
    "rows array<array<string>>, items array<string>, ordered boolean, name string, label string, tooltip string"
)
ELEMENT = (
    "doc_id bigint, chunk int, seq int, Path string, Text string, Page int, TextSize double, "
    "Font struct<weight:double,alt_family_name:string,family_name:string,name:string,italic:boolean>, Bounds array<double>, "
    "filePaths array<string>, attributes map<string,string>"
)


@dataclass(frozen=True)
class Corpus:
    """A collection of documents: one row per document, page and block.

    ``block.seq`` is the 0-based dense position of a block in its document.
    """

    doc: DataFrame
    page: DataFrame
    block: DataFrame
