"""Deterministic repairs; every repair returns fix rows beside the changed table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.functions import scan
from pagelight.functions.text import q, q_blank, q_first, q_like, q_strip
from pagelight.operators import ordered
from pagelight.sources.schemas import Corpus

SAMPLE = 500
# Letters that mark a language.
GERMAN_GATE, GERMAN = "[ßÄÖü]", "[äöüßÄÖÜ]"
FRENCH_GATE, FRENCH = "[çÇœæ]", "[àâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸ]"
SPANISH_GATE = "[ñÑ¿¡]"
HIRAGANA, KATAKANA, HANGUL, HAN = "[぀-ゟ]", "[゠-ヿ]", "[가-힯]", "[一-鿿㐀-䶿]"
FILENAME_TITLE = r"(?U)^[\w\-]+\.\w{2,4}$"
NUMERIC = r"^\s*[\d,.\-/:%$€£¥]+\s*$"


def language_of(x: str, limit: int = SAMPLE) -> str:
    """SQL struct (lang, detected) for the first ``limit`` characters of a text."""
    s = f"substr({x}, 1, {limit})"
    n = {k: f"regexp_count({s}, {q(p)})" for k, p in
         (("hira", HIRAGANA), ("kata", KATAKANA), ("hangul", HANGUL), ("han", HAN))}

    def kinds(p: str) -> str:
        return f"size(array_distinct(regexp_extract_all({s}, {q(p)}, 0)))"

    return f"""CASE WHEN {n['han']} + {n['hira']} + {n['kata']} + {n['hangul']} >= 3 THEN named_struct('lang', CASE
  WHEN {n['hangul']} > greatest({n['hira']}, {n['kata']}, {n['han']}) THEN 'ko'
  WHEN {n['hira']} > 0 OR {n['kata']} > 0 THEN 'ja' ELSE 'zh' END, 'detected', true)
 WHEN {s} rlike {q(GERMAN_GATE)} AND {kinds(GERMAN)} >= 2 THEN named_struct('lang', 'de', 'detected', true)
 WHEN {s} rlike {q(FRENCH_GATE)} AND {kinds(FRENCH)} >= 2 THEN named_struct('lang', 'fr', 'detected', true)
 WHEN {s} rlike {q(SPANISH_GATE)} THEN named_struct('lang', 'es', 'detected', true)
 ELSE named_struct('lang', 'en', 'detected', false) END"""


def text_sample(block: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """The opening text of each document, long enough for language detection.

    Only blocks that start within the first ``limit`` characters are gathered, so the
    text of one document never meets in one group; no block is moved with more of its text than that.
    """
    filled = block.filter("content <> ''").selectExpr("doc_id", "seq", f"substr(content, 1, {limit}) AS piece", "length(content) + 1 AS n")
    placed = scan.running(filled, ["doc_id"], ["seq"], {"before": scan.running_sum(F.col("n"), True)})
    return placed.filter(F.col("before") < limit).groupBy("doc_id").agg(
        F.expr("concat(array_join(transform(array_sort(collect_list(struct(seq, piece))), x -> x.piece), ' '), ' ') AS sample"))


SAMPLE_TEXT = "coalesce(sample, '')"


def fix_language(doc: DataFrame, block: DataFrame, limit: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """Fill a blank document language from metadata, else from the first ``limit`` characters of the text, else English."""
    meta = q_first("metadata['pdf_lang']", "metadata['lang']", "metadata['language']")
    missing = doc.filter(q_blank("language")).selectExpr("doc_id", "language", f"nullif({q_strip(meta)}, '') AS from_meta")
    # Only documents that nothing else names a language for are read.
    unnamed = missing.filter("from_meta IS NULL").select("doc_id")
    sample = text_sample(block.select("doc_id", "seq", "content").join(unnamed, "doc_id", "left_semi"), limit)
    found = missing.join(sample, "doc_id", "left").selectExpr(
        "doc_id", "language", "from_meta", f"{language_of(SAMPLE_TEXT, limit)} AS guess")
    fix = found.selectExpr(
        "doc_id", "'3.1.1' AS criterion", "'language_tag' AS fix", "'' AS element_id",
        "coalesce(nullif(language, ''), '(none)') AS before", "coalesce(from_meta, guess.lang) AS after",
        "CASE WHEN from_meta IS NOT NULL THEN 'pdf_metadata' WHEN guess.detected THEN 'content_heuristic' ELSE 'fallback_en' END AS reason")
    fixed = doc.join(fix.select("doc_id", F.col("after").alias("__new")), "doc_id", "left").withColumn(
        "language", F.coalesce("__new", "language")).drop("__new")
    return fixed, fix


def fix_title(doc: DataFrame, block: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace a missing or file-like title by the first heading, else by the file stem in title case."""
    titled = "coalesce(metadata['title'], '')"
    bad = f"({titled} = '' OR {q_like(q_strip(titled), FILENAME_TITLE)})"
    heading = block.filter(f"block_type = 'heading' AND NOT {q_blank('content')}").groupBy("doc_id").agg(
        F.expr(f"{q_strip('min_by(content, seq)')} AS heading"))
    stem = r"regexp_replace(regexp_replace(filename, r'^.*/', ''), r'(?<=.)\.[^.]*$', '')"
    spaced = f"replace(replace({stem}, '_', ' '), '-', ' ')"
    # Letters after any non-letter start upper case, the others are lowered.
    cased = f"array_join(transform(regexp_extract_all({spaced}, r'\\p{{L}}+|[^\\p{{L}}]+', 0), w -> concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), '')"
    new = doc.filter(bad).join(heading, "doc_id", "left").selectExpr(
        "doc_id", f"{titled} AS old", f"coalesce(heading, {cased}) AS new").filter("new <> '' AND new <> old")
    fix = new.selectExpr(
        "doc_id", "'2.4.2' AS criterion", "'document_title' AS fix", "'' AS element_id",
        "coalesce(nullif(old, ''), '(none)') AS before", "new AS after", "'' AS reason")
    fixed = doc.join(new.select("doc_id", "new"), "doc_id", "left").withColumn(
        "metadata",
        F.expr("CASE WHEN new IS NULL THEN metadata ELSE map_concat(map_filter(metadata, (k, v) -> k <> 'title'), map('title', new)) END"),
    ).drop("new")
    return fixed, fix


def _header_score() -> str:
    first = "rows[0]"
    cells = f"transform({first}, c -> trim(c))"
    mean = "aggregate({r}, 0, (a, c) -> a + length(c)) / greatest(size({r}), 1)"
    means = f"transform(filter(slice(rows, 2, 5), r -> size(r) > 0), r -> {mean.format(r='r')})"
    data = f"aggregate({means}, 0.0D, (a, m) -> a + m) / size({means})"
    lead = mean.format(r=first)
    unique = f"size(array_distinct({cells}))"
    return f"""CASE WHEN NOT exists({cells}, c -> NOT {q_like('c', NUMERIC)}) THEN 0.0D ELSE (
  CASE WHEN {unique} = size({first}) THEN 1.0D WHEN {unique} >= size({first}) * 0.8D THEN 0.5D ELSE 0.0D END
  + CASE WHEN size({means}) = 0 THEN 0.5D WHEN {data} > 0 AND {lead} <= {data} THEN 1.0D
    WHEN {data} > 0 AND {lead} <= {data} * 1.5D THEN 0.5D ELSE 0.0D END) / 2.0D END"""


HEADER_SCORE = _header_score()


def header_scores(block: DataFrame) -> DataFrame:
    """Likelihood that the first row of a headerless table is its header."""
    bare = block.filter("block_type = 'table' AND coalesce(size(headers), 0) = 0 AND size(rows) > 0 AND size(rows[0]) > 0")
    return bare.selectExpr("doc_id", "seq", "block_id", "page_num", "rows", f"{HEADER_SCORE} AS confidence")


def promote_headers(block: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First rows that look like headers become headers; the others are only reported."""
    scored = header_scores(block)
    fix = scored.selectExpr(
        "doc_id", "'1.3.1' AS criterion",
        "CASE WHEN confidence >= 0.6 THEN 'table_headers_promoted' ELSE 'table_headers_skipped_low_confidence' END AS fix",
        "block_id AS element_id", "CAST(NULL AS STRING) AS before",
        "CASE WHEN confidence >= 0.6 THEN CAST(size(rows[0]) AS STRING) END AS after",
        "CAST(bround(confidence, 2) AS STRING) AS reason")
    yes = scored.filter("confidence >= 0.6").select("doc_id", "seq", F.lit(True).alias("__up"))
    joined = block.join(yes, ["doc_id", "seq"], "left")
    fixed = joined.withColumns({
        "headers": F.expr("CASE WHEN __up THEN rows[0] ELSE headers END"),
        "rows": F.expr("CASE WHEN __up THEN slice(rows, 2, greatest(size(rows) - 1, 1)) ELSE rows END"),
        "status": F.expr("CASE WHEN __up THEN 'ai_drafted' ELSE status END"),
    }).drop("__up")
    return fixed.withColumn("rows", F.expr("filter(rows, r -> r IS NOT NULL)")), fix


def renumber_headings(block: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Start at level 1, then never jump by more than one; one fix row per change and reason."""
    heads = block.filter("block_type = 'heading'").selectExpr(
        "doc_id", "seq", "block_id", "page_num", "coalesce(level, 1) AS old")
    firsts = heads.groupBy("doc_id").agg(F.expr("min_by(old, seq) AS first_level"))
    shifted = heads.join(firsts, "doc_id").selectExpr(
        "doc_id", "seq", "block_id", "page_num", "old", "first_level > 1 AS moved",
        "CASE WHEN first_level > 1 THEN greatest(1, old - (first_level - 1)) ELSE old END AS shifted")
    clamped = _clamp_above_zero(shifted)
    start = clamped.filter("moved").selectExpr(
        "doc_id", "'2.4.6' AS criterion", "'heading_level_adjusted' AS fix", "block_id AS element_id",
        "concat('h', old) AS before", "concat('h', shifted) AS after", "'start_level_normalised' AS reason")
    skip = clamped.filter("shifted <> level").selectExpr(
        "doc_id", "'2.4.6' AS criterion", "'heading_level_adjusted' AS fix", "block_id AS element_id",
        "concat('h', shifted) AS before", "concat('h', level) AS after", "'skipped_level_fixed' AS reason")
    fixed = block.join(clamped.select("doc_id", "seq", F.col("level").alias("__level")), ["doc_id", "seq"], "left").withColumn(
        "level", F.expr("coalesce(__level, level)")).drop("__level")
    return fixed, start.unionByName(skip)


def _clamp_above_zero(heading: DataFrame) -> DataFrame:
    """Clamp to the previous level plus one, except after a level of zero or less, which does not bind.

    A heading after such a level starts anew, so the running minimum restarts there.
    """
    parts = scan.running(
        heading, ["doc_id"], ["seq"],
        {"__p": scan.row_position(),
         "__part": scan.running_sum(F.expr("CASE WHEN shifted <= 0 THEN 1 ELSE 0 END"), exclusive=True)})
    # The smallest pair (latest part first) is the minimum since the last restart.
    low = scan.running(parts, ["doc_id"], ["seq"], {"__low": scan.running_min(F.expr("struct(-__part AS part, shifted - __p AS v)"))})
    return low.withColumn("level", F.expr("CAST(__p + __low.v AS INT)")).drop("__part", "__p", "__low")


def fix_reading_order(block: DataFrame) -> tuple[DataFrame, DataFrame]:
    order, pages = ordered.reading_order(block)
    fix = pages.selectExpr(
        "doc_id", "'1.3.2' AS criterion", "'reading_order_corrected' AS fix", "concat('page-', page_num) AS element_id",
        "CAST(NULL AS STRING) AS before", "CAST(blocks_reordered AS STRING) AS after", "'' AS reason")
    return order, fix


def in_order(block: DataFrame, order: DataFrame) -> DataFrame:
    """``block`` with the positions of the repaired order: a page keeps its positions, its blocks change seats."""
    page = ["doc_id", "page_num"]
    seat = order.select(*page, F.col("old_pos").alias("pos"), F.col("seq").alias("__seat"))
    moved = order.select(*page, F.col("new_pos").alias("pos"), "seq").join(seat, [*page, "pos"]).select("doc_id", "seq", "__seat")
    columns = [F.coalesce("__seat", "seq").alias("seq") if c == "seq" else F.col(c) for c in block.columns]
    return block.join(moved, ["doc_id", "seq"], "left").select(*columns)


FIX = ("doc_id", "criterion", "fix", "element_id", "before", "after", "reason")


def apply_all(corpus: Corpus) -> tuple[Corpus, DataFrame]:
    """Language, title, headers, headings, reading order, in this order; returns the fixes."""
    doc, language = fix_language(corpus.doc, corpus.block)
    doc, title = fix_title(doc, corpus.block)
    block, headers = promote_headers(corpus.block)
    block, headings = renumber_headings(block)
    # Positions and boxes are those of the given blocks whatever was repaired before.
    order, moves = fix_reading_order(corpus.block)
    fixes = reduce(DataFrame.unionByName, [d.select(*FIX) for d in (language, title, headers, headings, moves)])
    return Corpus(doc, corpus.page, in_order(block, order)), fixes
