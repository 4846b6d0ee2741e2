"""Duplicate removal, identifiers and chunk handling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.functions import scan, text
from pagelight.functions.text import q_strip

_CELLS = r"""concat_ws(' ', content, CASE WHEN size(headers) > 0 THEN array_join(headers, ' | ') END,
 array_join(transform(coalesce(rows, array()), r -> array_join(r, ' | ')), ' '))"""
TABLE_HASH = rf"sha2(trim(regexp_replace(lower({_CELLS}), r'\s+', ' ')), 256)"


def duplicate_tables(block: DataFrame) -> DataFrame:
    """Tables that repeat an earlier one on their page.

    The copies only meet as (page, hash) minima, which combine before the shuffle,
    so a table copied everywhere does not gather its copies in one task.
    """
    hashed = block.filter("block_type = 'table'").selectExpr("doc_id", "page_num", "seq", f"{TABLE_HASH} AS hash")
    first = hashed.groupBy("doc_id", "page_num", "hash").agg(F.expr("min(seq) AS first_seq"), F.expr("count(*) AS n"))
    return hashed.join(first.filter("n > 1"), ["doc_id", "page_num", "hash"]).filter("seq > first_seq").select(
        "doc_id", "seq", "first_seq")


def drop_duplicate_tables(block: DataFrame) -> DataFrame:
    return block.join(duplicate_tables(block).select("doc_id", "seq"), ["doc_id", "seq"], "left_anti")


def running_artifacts(block: DataFrame, page: DataFrame) -> DataFrame:
    """Short texts found three times or more in the same 5 % band of the page height."""
    norm = rf"regexp_replace(upper({q_strip('content')}), r'\s+', ' ')"
    short = block.filter("block_type IN ('paragraph', 'heading') AND NOT (y1 = 0 AND y2 = 0)").selectExpr(
        "doc_id", "page_num", "seq", "y1", f"{norm} AS norm").filter("norm <> '' AND length(norm) <= 40")
    sized = short.join(page.select("doc_id", "page_num", "height"), ["doc_id", "page_num"], "left").selectExpr(
        "doc_id", "seq", "norm", "bround(y1 / coalesce(nullif(height, 0), 792.0) / 0.05, 0) AS band")
    often = sized.groupBy("doc_id", "norm", "band").agg(F.expr("count(*) AS n")).filter("n >= 3")
    return sized.join(often, ["doc_id", "norm", "band"]).select("doc_id", "seq", "norm", "n")


def chunk_plan(doc: DataFrame, max_pages: int = 250, overlap: int = 2) -> DataFrame:
    """Page ranges for documents longer than ``max_pages``; neighbours share ``overlap`` pages."""
    safe = min(overlap, max(0, max_pages // 10))
    stride = max(1, max_pages - safe)
    starts = doc.filter(F.col("page_count") > max_pages).selectExpr(
        "doc_id", "page_count", f"posexplode(sequence(0, page_count - 1, {stride})) AS (chunk, start_page)")
    return starts.selectExpr(
        "doc_id", "chunk", "start_page",
        f"least(start_page + {max_pages}, page_count) AS split_page", "page_count",
        f"CASE WHEN start_page = 0 THEN 0 ELSE {safe} END AS overlap_start",
        f"CASE WHEN start_page + {stride} >= page_count THEN 0 ELSE {safe} END AS overlap_end",
    )


def shift_boundaries(plan: DataFrame, page_bytes: DataFrame, shift: int = 2) -> DataFrame:
    """Move a split forward to the first of the next pages with real content.

    Splits fall on few page numbers, at most ``shift`` per chunk of the longest document, so pages with other numbers leave
    before anything is shuffled.  The rest meets the candidates in an equality join, without a range join.  Neither side is
    ever broadcast: the size of exploded pages is estimated from the documents they come from.
    """
    inner = plan.filter("split_page < page_count")
    candidates = inner.selectExpr(
        "doc_id", "chunk", f"explode(sequence(split_page, least(split_page + {shift - 1}, page_count - 1))) AS page_num")
    numbers = candidates.select("page_num").distinct()
    near = page_bytes.filter("n_bytes > 500").join(F.broadcast(numbers), "page_num", "left_semi")
    solid = candidates.hint("merge").join(near.select("doc_id", "page_num"), ["doc_id", "page_num"]).groupBy("doc_id", "chunk").agg(
        F.expr("min(page_num) AS solid_page"))
    return plan.hint("merge").join(solid, ["doc_id", "chunk"], "left").selectExpr(
        "doc_id", "chunk", "start_page",
        "least(coalesce(solid_page, split_page) + overlap_end, page_count) AS end_page")


def merge_chunks(element: DataFrame, chunk: DataFrame) -> DataFrame:
    """Elements of all chunks on document pages; an overlap keeps the copy of the earlier chunk."""
    placed = element.join(chunk, ["doc_id", "chunk"]).selectExpr(
        "doc_id", "chunk", "seq", "Page + start_page AS page", "Path", "Text",
        "transform(filePaths, p -> concat('chunk', chunk, '/', p)) AS filePaths",
        f"sha2(concat_ws(chr(0), Page + start_page, {q_strip("coalesce(Text, '')")}, coalesce(Path, '')), 256) AS key",
    )
    return placed.groupBy("doc_id", "key").agg(
        F.expr("min(struct(chunk, seq, page, Path, Text, filePaths)) AS kept")).select("doc_id", "kept.*")


def distinct_descriptions(violation: DataFrame) -> DataFrame:
    """First of each description with its category and the running number within the category."""
    first = violation.groupBy("doc_id", "description").agg(F.expr("min(struct(seq, severity)) AS f")).selectExpr(
        "doc_id", "description", "f.seq", "f.severity", "lower(description) AS d")
    known = first.selectExpr(
        "*",
        """CASE WHEN contains(d, 'caption') THEN 'table_caption'
         WHEN contains(d, 'scope') OR contains(d, '<th') THEN 'table_headers'
         WHEN contains(d, 'skip') OR contains(d, 'navigation') THEN 'skip_navigation'
         WHEN contains(d, 'landmark') OR contains(d, '<main') THEN 'landmark'
         WHEN contains(d, 'heading') THEN 'heading_hierarchy' WHEN contains(d, 'lang') THEN 'language'
         WHEN contains(d, 'title') THEN 'document_title'
         WHEN contains(d, 'alt') AND contains(d, 'placeholder') THEN 'placeholder_alt_text'
         WHEN contains(d, 'alt') THEN 'alt_text' WHEN contains(d, 'src') THEN 'missing_image_src'
         ELSE 'structural' END AS category""",
    ).filter("NOT (category = 'alt_text' AND contains(d, 'missing'))")
    numbered = scan.running(known, ["doc_id", "category"], ["seq"], {"i": scan.row_position()})
    return numbered.selectExpr(
        "doc_id", "concat('str_', category, '_', i - 1) AS proposal_id", "category", "description", "severity",
        "category NOT IN ('placeholder_alt_text', 'alt_text') AS auto_fixable")


def append_members(member: DataFrame, addition: DataFrame) -> DataFrame:
    """Rows (rule_id, doc_id) of ``member`` and, once each, those of ``addition`` that it lacks.

    Members are rows, so a rule may have any number of documents: what is new is told by rule and document and appended.
    """
    key = ["rule_id", "doc_id"]
    known = member.select(*key).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    new = addition.select(*key).distinct().join(known.withColumnsRenamed({c: f"__{c}" for c in key}), same, "left_anti")
    return member.select(*key).unionByName(new)


def append_unique(rule: DataFrame, addition: DataFrame) -> DataFrame:
    """(rule_id, docs array) with new documents added once: ``append_members`` for rules that keep their documents in an array.

    Rules without an addition keep their array as it is but for order and repeats; a rule's documents are one value here.
    """
    member = rule.select("rule_id", F.explode("docs").alias("doc_id"))
    mine = addition.join(rule.select("rule_id").distinct(), "rule_id", "left_semi")
    docs = append_members(member, mine).distinct().groupBy("rule_id").agg(F.array_sort(F.collect_list("doc_id")).alias("docs"))
    return rule.select("rule_id").join(docs, "rule_id", "left").select("rule_id", F.coalesce("docs", F.array().cast(docs.schema["docs"].dataType)).alias("docs"))


def image_ids(block: DataFrame) -> DataFrame:
    """Page-wise numbers for embedded images; the document is part of the key."""
    embedded = block.filter("block_type = 'image' AND startswith(coalesce(src, ''), 'data:')")
    numbered = scan.running(
        embedded.select("doc_id", "page_num", "seq"), ["doc_id", "page_num"], ["seq"], {"i": scan.row_position()})
    return numbered.selectExpr("doc_id", "seq", "concat('img_p', page_num, '_i', i - 1) AS image_id")
