"""The 50 audit rules.

Rules that look at single blocks are predicates evaluated together in one pass
over the block table; rules over pages and documents read counters from one
aggregation chain block -> (document, page) -> document.  Only four rules need
ordered or grouped work of their own.  ``audit_findings`` builds just the
branches its criteria need.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelight.functions import scan, text
from pagelight.sources import dimensions
from pagelight.sources.schemas import BLOCK_TYPES, Corpus

SEVERITY = {r[0]: r[5] for r in dimensions.RULES}
REMEDIATION = {r[0]: r[6] for r in dimensions.RULES}
CRITERIA = [r[0] for r in dimensions.RULES]
MAX_IDS = 25  # image ids named in a sentence

FINDING = (
    "doc_id", "rule_id", "criterion", "status", "severity", "element_id", "page", "issue", "n",
    "auto_fixable", "remediation_type", "evidence",
)


@dataclass(frozen=True)
class BlockIssue:
    """A predicate over one block, as SQL text."""

    criterion: str
    issue: str
    when: str
    auto_fixable: bool
    remediation: str | None = None
    element: str = "block_id"
    page: str = "page_num"
    evidence: str = "''"


class sql(str):
    """Marks text as an SQL expression instead of a literal."""


IMAGE, TABLE, LIST = "block_type = 'image'", "block_type = 'table'", "block_type = 'list'"
HEADING, FIELD = "block_type = 'heading'", "block_type = 'form_field'"

# Decorative first, then missing or placeholder text, then overlong text.
IMAGE_KIND = f"""CASE WHEN {IMAGE} THEN CASE
 WHEN (abs(x2 - x1) > 0 AND abs(x2 - x1) < 5) OR (abs(y2 - y1) > 0 AND abs(y2 - y1) < 5)
  OR {text.q_like("concat(coalesce(alt, ''), ' ', content)", text.DECORATIVE_WORDS)} THEN 'decorative'
 WHEN {text.q_blank("alt")} OR {text.q_like(text.q_strip("alt"), text.PLACEHOLDER_ALT)} THEN 'missing'
 WHEN length(alt) > 150 THEN 'long_alt' END END"""
CHART_IMAGE = f"({IMAGE} AND {text.q_like(text.q_first('alt', 'content'), text.CHART_WORDS)})"
_SAMPLE = f"regexp_extract(content, {text.q(text.FOREIGN_SCRIPT)}, 0)"
# Script of the first foreign passage of a block.
SCRIPT = f"""CASE WHEN {text.q_foreign("content")} THEN CASE
 WHEN {_SAMPLE} rlike '[一-鿿]' THEN 'CJK (Chinese/Japanese/Korean)' WHEN {_SAMPLE} rlike '[Ѐ-ӿ]' THEN 'Cyrillic'
 WHEN {_SAMPLE} rlike '[؀-ۿ]' THEN 'Arabic' WHEN {_SAMPLE} rlike '[ऀ-ॿ]' THEN 'Devanagari'
 ELSE 'accented Latin' END END"""
HAS_URL = text.q_url("content")


def _block_issues() -> list[BlockIssue]:
    blank, empty, first, like = text.q_blank, text.q_empty, text.q_first, text.q_like
    bare = empty("headers")
    widest = "coalesce(array_max(transform(rows, r -> size(r))), 0)"
    generic = like("content", text.GENERIC_LINK)
    only_url = like(text.q_strip("content"), r"(?i)^https?://\S+$")
    blank_items = f"exists(items, x -> {blank('x')})"
    words = f"size(filter(split(coalesce(alt, ''), {text.q(text.WHITESPACE + '+')}), w -> w <> ''))"
    types = ", ".join(text.q(t) for t in BLOCK_TYPES)
    return [
        BlockIssue("1.3.1", "table_caption_missing", f"{TABLE} AND {blank('caption')}", True, "auto_fix"),
        BlockIssue("1.3.1", "layout_table", f"{TABLE} AND {bare} AND {widest} <= 1", False),
        BlockIssue("1.3.1", "table_headers_missing", f"{TABLE} AND {bare} AND {widest} > 1", True),
        BlockIssue("1.3.1", "table_row_width",
                   f"{TABLE} AND NOT {bare} AND exists(rows, r -> size(r) <> size(headers))", False),
        BlockIssue("1.3.1", "list_empty", f"{LIST} AND {empty('items')}", True),
        BlockIssue("1.3.1", "list_blank_items", f"{LIST} AND NOT {empty('items')} AND {blank_items}", False),
        BlockIssue("1.3.1", "heading_level_invalid", f"{HEADING} AND NOT coalesce(level BETWEEN 1 AND 6, false)", True),
        BlockIssue("1.3.3", "sensory_reference", like("content", text.SENSORY), False, "manual_review",
                   evidence="substr(content, 1, 120)"),
        BlockIssue("1.3.5", "field_name_missing", f"{FIELD} AND {blank(first('name', 'content'))}", False,
                   "manual_review"),
        BlockIssue("1.4.5", "long_image_text", f"{IMAGE} AND {words} > 50", False, "manual_review",
                   element="coalesce(image_id, block_id)"),
        BlockIssue("2.4.4", "generic_link_text", f"{HAS_URL} AND {generic}", False, "ai_draft",
                   evidence="substr(content, 1, 120)"),
        BlockIssue("2.4.4", "bare_url", f"{HAS_URL} AND NOT {generic} AND {only_url}", False, "ai_draft",
                   evidence=f"substr({text.q_strip('content')}, 1, 100)"),
        BlockIssue("2.4.6", "heading_empty", f"{HEADING} AND {blank('content')}", False),
        BlockIssue("2.4.6", "field_label_missing", f"{FIELD} AND {blank(first('label', 'content'))}", False),
        BlockIssue("3.3.2", "field_instructions_missing",
                   f"{FIELD} AND {blank(first('tooltip', 'label', 'content'))}", True),
        BlockIssue("4.1.1", "block_type_invalid", f"NOT coalesce(block_type IN ({types}), false)", True),
        BlockIssue("4.1.1", "block_type_empty", "coalesce(block_type, '') = ''", True),
        BlockIssue("4.1.1", "page_negative", "page_num < 0", True, page="0"),
        BlockIssue("4.1.2", "field_accessible_name_missing",
                   f"{FIELD} AND {blank(first('name', 'tooltip', 'label', 'content'))}", True, "auto_fix"),
    ]


BLOCK_ISSUES = _block_issues()


def _finding(criterion, status, issue=None, severity=None, element="", page=0, n=1, auto=False, remediation=None,
             evidence="") -> str:
    """A finding as an SQL struct; plain values become literals, ``sql`` values stay expressions."""

    def lit(v):
        return v if isinstance(v, sql) else text.q(v)

    severity = SEVERITY[criterion] if severity is None else severity
    remediation = REMEDIATION[criterion] if remediation is None else remediation
    return (
        f"named_struct('criterion', {text.q(criterion)}, 'status', {lit(status)}, 'severity', {lit(severity)}, "
        f"'element_id', {lit(element)}, 'page', CAST({lit(page)} AS INT), 'issue', CAST({lit(issue)} AS STRING), "
        f"'n', CAST({lit(n)} AS BIGINT), 'auto_fixable', {lit(auto)}, 'remediation_type', {lit(remediation)}, "
        f"'evidence', CAST({lit(evidence)} AS STRING))"
    )


def _explode(df: DataFrame, structs: list[str]) -> DataFrame:
    """One finding row per non-null struct.

    The outer generator keeps the optimizer from copying the whole list into an extra
    not-empty filter; documents without findings drop out afterwards.
    """
    rows = df.selectExpr("doc_id", f"inline_outer(array_compact(array({', '.join(structs)})))")
    return rows.filter("criterion IS NOT NULL").withColumn(
        "rule_id", F.expr("concat('wcag_', replace(criterion, '.', '_'))")).select(*FINDING)


# --- block pass -------------------------------------------------------------


def block_findings(block: DataFrame, criteria: Iterable[str]) -> DataFrame | None:
    """All row-level findings in one narrow pass over the blocks."""
    mine = [i for i in BLOCK_ISSUES if i.criterion in criteria]
    if not mine:
        return None
    return _explode(block, [
        f"CASE WHEN {i.when} THEN " + _finding(
            i.criterion, "fail", i.issue, element=sql(i.element), page=sql(i.page), auto=i.auto_fixable,
            remediation=i.remediation, evidence=sql(i.evidence)) + " END"
        for i in mine
    ])


# --- page and document counters ---------------------------------------------


def _row_counters() -> dict[str, str]:
    """What is counted per page, as a test of one block."""
    issues: dict[str, list[str]] = {}
    for i in BLOCK_ISSUES:
        issues.setdefault("bad_" + i.criterion.replace(".", "_"), []).append(i.when)
    return {
        **{f"n_{t}": f"block_type = '{t}'" for t in BLOCK_TYPES},
        "n_link": HAS_URL,
        "n_chart": CHART_IMAGE,
        "bad_1_1_1": f"({IMAGE_KIND}) IS NOT NULL",
        "bad_3_1_2": text.q_foreign("content"),
        **{k: "(" + ") OR (".join(ws) + ")" for k, ws in issues.items()},
    }


COLUMN = "bround(x1 / 50.0, 0)"


def page_counters(block: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Counters per (document, page); the map side combines them before the shuffle."""
    counters = {"n_block": "count(*)", "n_column": f"size(collect_set({COLUMN}))",
                **{k: f"count_if({when})" for k, when in _row_counters().items()}}
    wanted = set(counters if names is None else names) | {"n_block"}
    return block.groupBy("doc_id", "page_num").agg(*[F.expr(f"{e} AS {n}") for n, e in counters.items() if n in wanted])


BACK = "{0}.page_num < {1}.page_num OR ({0}.page_num = {1}.page_num AND {0}.y1 < {1}.y1 - 20)"
ORDERED = ("order_breaks", "n_skip", "n_duplicate")


def block_facts(block: DataFrame, counters: Iterable[str]) -> DataFrame:
    """One row per document with the counters and all of ``ORDERED``, from one read and one shuffle of the blocks.

    Narrow rows, with the tests of a block as bits, are dealt out by document and segment.  A segment compares each block with the
    one before, each heading with the last one, and counts repeated ids; sums per page leave it.  Its first
    block, first heading and last block go along, and a document compares those of neighbouring segments
    at the end.  Only ids of documents with several segments are counted once more.
    """
    tests = {k: v for k, v in _row_counters().items() if k in counters}
    bits = " | ".join(f"CASE WHEN {t} THEN {1 << k}L ELSE 0L END" for k, t in enumerate(tests.values())) or "0L"
    rows = block.selectExpr(
        "doc_id", "seq", "page_num", "y1", "block_id", f"{COLUMN} AS column", f"CASE WHEN {HEADING} THEN level END AS level",
        f"{bits} AS bits").withColumn("segment", scan.segment_of(F.col("seq"))).repartition("doc_id", "segment")
    part = Window.partitionBy("doc_id", "segment")
    order, same_id = part.orderBy("seq"), Window.partitionBy("doc_id", "segment", "block_id").orderBy("seq")
    here = F.struct("page_num", "y1")
    earlier = F.last("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    seen = rows.select(
        "*", here.alias("here"), F.lag(here).over(order).alias("before"), F.lead("seq").over(order).isNull().alias("is_last"),
        earlier.alias("last_level"), F.row_number().over(same_id).alias("use"))
    border = """array_compact(array(
        CASE WHEN before IS NULL THEN struct(seq, 0 AS kind, here, CAST(NULL AS INT) AS level) END,
        CASE WHEN level IS NOT NULL AND last_level IS NULL THEN struct(seq, 1 AS kind, here, CAST(level AS INT) AS level) END,
        CASE WHEN is_last THEN struct(seq, 2 AS kind, here, CAST(coalesce(level, last_level) AS INT) AS level) END))"""
    sums = {
        "order_breaks": f"count_if({BACK.format('here', 'before')})", "n_skip": "count_if(level > last_level + 1)", "n_duplicate": "count_if(use = 2)",
        "n_block": "count(*)", **{name: f"count_if(shiftright(bits, {k}) & 1 = 1)" for k, name in enumerate(tests)}}
    within = seen.groupBy("doc_id", "segment", "page_num").agg(
        *[F.expr(f"{e} AS {n}") for n, e in sums.items()], F.expr("collect_set(column) AS columns"),
        F.expr(f"flatten(collect_list({border})) AS borders"))
    page = within.groupBy("doc_id", "page_num").agg(
        *[F.sum(n).alias(n) for n in sums], F.expr("size(array_distinct(flatten(collect_list(columns)))) AS n_column"),
        F.expr("flatten(collect_list(borders)) AS borders"))
    named = sorted({*counters, "n_block"})
    per_doc = page.groupBy("doc_id").agg(
        *[F.expr(f"{_PER_PAGE[c][1] if c in _PER_PAGE else f'sum({c})'} AS {c}") for c in named],
        *[F.sum(n).alias(n) for n in ORDERED], F.expr("array_sort(flatten(collect_list(borders))) AS borders"))
    between = f"""aggregate(borders, struct(CAST(NULL AS {per_doc.schema['borders'].dataType.elementType['here'].dataType.simpleString()}) AS here,
        CAST(NULL AS INT) AS level, 0L AS breaks, 0L AS skips), (s, b) -> struct(
         CASE WHEN b.kind = 2 THEN b.here ELSE s.here END AS here, CASE WHEN b.kind = 2 THEN coalesce(b.level, s.level) ELSE s.level END AS level,
         s.breaks + CASE WHEN b.kind = 0 AND ({BACK.format('b.here', 's.here')}) THEN 1L ELSE 0L END AS breaks,
         s.skips + CASE WHEN b.kind = 1 AND b.level > s.level + 1 THEN 1L ELSE 0L END AS skips))"""
    # Reading every column keeps column pruning from splitting the shared exchange in two.
    whole = F.max(F.xxhash64(*rows.columns)).alias("whole")
    ids = rows.withColumn("full", F.count(F.lit(1)).over(part) >= scan.SEGMENT_ROWS).filter("full OR segment > 0").groupBy(
        "doc_id", "segment", "block_id").agg(F.count(F.lit(1)).alias("uses"), whole).filter("whole IS NOT NULL")
    apart = ids.groupBy("doc_id", "block_id").agg(F.expr("CAST(sum(uses) > 1 AS INT) - count_if(uses > 1) AS more")).groupBy(
        F.col("doc_id").alias("id")).agg(F.sum("more").alias("more_duplicates"))
    # A null-safe join: another would filter null ids below one of the two uses of the exchange, which then differ.
    out = per_doc.withColumn("between", F.expr(between)).join(apart, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return out.select(
        "doc_id", *named, (F.col("order_breaks") + F.col("between.breaks")).alias("order_breaks"),
        (F.col("n_skip") + F.col("between.skips")).alias("n_skip"),
        (F.col("n_duplicate") + F.coalesce("more_duplicates", F.lit(0))).alias("n_duplicate"))


FEATURES = ("has_forms", "has_media", "has_javascript", "is_document_set", "has_images", "has_tables",
            "has_headings", "has_links")
_KINDS = {"has_forms": "n_form_field", "has_images": "n_image", "has_tables": "n_table", "has_headings": "n_heading",
          "has_links": "n_link"}
_PER_PAGE = {"bad_1_3_2": ("n_column", "count_if(n_column >= 3)"), "bad_1_4_1": ("n_chart", "count_if(n_chart > 0)")}


def doc_facts(corpus: Corpus, names: Iterable[str], flags: DataFrame | None = None) -> DataFrame:
    """One row per document with the named facts; tables no fact needs are not read.

    ``flags`` (doc_id, has_media, has_javascript, is_document_set) switches on the
    features that extraction cannot see; they are false without it.
    """
    names = set(names)
    counters = {n for n in names if n.startswith(("n_", "bad_"))} - {"n_page", "n_scanned", "n_text_page", "n_skip",
                                                                     "n_duplicate"}
    counters |= {_KINDS[n] for n in names if n in _KINDS}
    facts = corpus.doc
    zero = []
    together = len(names & set(ORDERED)) > 1
    if together:
        # Null-safe for the same reason as inside of block_facts.
        found = block_facts(corpus.block, counters).select(F.col("doc_id").alias("__doc"), *sorted(counters), *ORDERED)
        facts = facts.join(found, F.col("doc_id").eqNullSafe(F.col("__doc")), "left").drop("__doc")
        zero += [*sorted(counters), *ORDERED]
    elif counters:
        base = {_PER_PAGE[c][0] if c in _PER_PAGE else c for c in counters}
        per_doc = page_counters(corpus.block, base).groupBy("doc_id").agg(
            *[F.expr(f"{_PER_PAGE[c][1] if c in _PER_PAGE else f'sum({c})'} AS {c}") for c in sorted(counters)]
        )
        facts = facts.join(per_doc, "doc_id", "left")
        zero += sorted(counters)
    if names & {"n_page", "n_scanned", "n_text_page", "first_scanned", "first_text", "pages"}:
        pages = corpus.page.groupBy("doc_id").agg(
            F.expr("count(*) AS n_page"), F.expr("count_if(NOT has_text) AS n_scanned"),
            F.expr("count_if(has_text) AS n_text_page"),
            F.expr("min(CASE WHEN NOT has_text THEN page_num END) AS first_scanned"),
            F.expr("min(CASE WHEN has_text THEN page_num END) AS first_text"),
        )
        facts = facts.join(pages, "doc_id", "left")
        zero += ["n_page", "n_scanned", "n_text_page"]
    own = {
        "order_breaks": order_breaks,
        "n_skip": lambda b: heading_skips(b).groupBy("doc_id").agg(F.expr("count(*) AS n_skip")),
        "n_duplicate": lambda b: duplicate_ids(b).groupBy("doc_id").agg(F.expr("count(*) AS n_duplicate")),
    }
    for name, build in own.items():
        if name in names and not together:
            facts = facts.join(build(corpus.block), "doc_id", "left")
            zero.append(name)
    given = ("has_media", "has_javascript", "is_document_set")
    if flags is None:
        facts = facts.selectExpr("*", *[f"false AS {n}" for n in given])
    elif names & set(given):
        facts = facts.join(flags, "doc_id", "left").fillna(False, list(given))
    facts = facts.fillna(0, zero) if zero else facts
    derived = [f"{_KINDS[n]} > 0 AS {n}" for n in _KINDS if n in names]
    if "pages" in names:
        derived.append("CAST(coalesce(nullif(page_count, 0), n_page) AS BIGINT) AS pages")
    return facts.selectExpr("*", *derived)


def doc_features(corpus: Corpus, flags: DataFrame | None = None) -> DataFrame:
    return doc_facts(corpus, [*FEATURES, "pages"], flags).select("doc_id", *FEATURES, "pages")


def order_breaks(block: DataFrame) -> DataFrame:
    """Times the page number falls or the text jumps up by more than 20 within a page."""
    seen = scan.neighbours(
        block.select("doc_id", "seq", "page_num", "y1"), ["doc_id"], "seq", {"before": (-1, F.struct("page_num", "y1"))}
    )
    seen = seen.withColumn("here", F.struct("page_num", "y1"))
    return seen.groupBy("doc_id").agg(F.expr(f"count_if({BACK.format('here', 'before')}) AS order_breaks"))


def sequential_order(block: DataFrame) -> DataFrame:
    return order_breaks(block).select("doc_id", (F.col("order_breaks") == 0).alias("sequential"))


# --- rules with grouped or ordered work of their own ------------------------


def flagged_images(block: DataFrame) -> DataFrame:
    """1.1.1: every image with a finding, one row each; the sentence of a finding names ``MAX_IDS`` of them only."""
    return block.selectExpr("doc_id", "page_num", "seq", "block_id", f"{IMAGE_KIND} AS kind").filter("kind IS NOT NULL")


def image_page_findings(block: DataFrame) -> DataFrame:
    """1.1.1: one finding per page and kind, naming the first ``MAX_IDS`` images; ``flagged_images`` has them all."""
    flagged = flagged_images(block)
    numbered = scan.running(flagged, ["doc_id", "page_num", "kind"], ["seq"], {"pos": scan.row_position()})
    grouped = numbered.groupBy("doc_id", "page_num", "kind").agg(
        F.expr("count(*) AS n"),
        F.expr(f"array_sort(collect_list(CASE WHEN pos <= {MAX_IDS} THEN struct(seq, block_id) END)) AS ids"),
    )
    return _explode(grouped, [
        _finding(
            "1.1.1", "fail", sql("kind"), sql("CASE WHEN kind = 'long_alt' THEN 'moderate' ELSE 'critical' END"),
            sql("concat('page_', page_num, '_', CASE WHEN kind = 'missing' THEN 'images' ELSE kind END)"),
            sql("page_num"), sql("n"), False,
            sql("CASE WHEN kind = 'missing' THEN 'ai_draft' ELSE 'manual_review' END"),
            sql(f"concat('image_ids: ', array_join(transform(ids, s -> s.block_id), ', '), "
                f"CASE WHEN n > {MAX_IDS} THEN concat(' (+', n - {MAX_IDS}, ' more)') ELSE '' END)"),
        )
    ])


def page_findings(block: DataFrame, criteria: Iterable[str]) -> DataFrame | None:
    """1.3.2 column clusters and 1.4.1 chart images, one finding per page."""
    page, rows = sql("page_num"), {}
    rows["1.3.2"] = ("n_column", "n_column >= 3", _finding(
        "1.3.2", "fail", "columns", "moderate", sql("concat('page_', page_num)"), page, sql("n_column"), False,
        "manual_review"))
    rows["1.4.1"] = ("n_chart", "n_chart > 0", _finding(
        "1.4.1", "fail", "charts", None, sql("concat('page_', page_num, '_charts')"), page, sql("n_chart"), False,
        "manual_review"))
    mine = [v for k, v in rows.items() if k in criteria]
    if not mine:
        return None
    counters = page_counters(block, [m[0] for m in mine])
    return _explode(counters, [f"CASE WHEN {when} THEN {row} END" for _, when, row in mine])


def heading_skips(block: DataFrame) -> DataFrame:
    """Headings whose level exceeds the previous heading's level by more than one."""
    levels = block.filter(f"{HEADING} AND level IS NOT NULL").select("doc_id", "seq", "block_id", "page_num", "level")
    seen = scan.running(levels, ["doc_id"], ["seq"], {"prev_level": scan.previous(F.col("level"))})
    return seen.filter("level > prev_level + 1")


def skip_findings(block: DataFrame) -> DataFrame:
    return _explode(heading_skips(block), [
        _finding("2.4.6", "fail", "level_skipped", None, sql("block_id"), sql("page_num"), auto=True,
                 evidence=sql("concat('H', prev_level, ' → H', level)"))
    ])


def script_findings(block: DataFrame) -> DataFrame:
    """3.1.2: one finding per script, at its first page."""
    # As a generated row the script is told once a block; a filter on it would tell it again below.
    seen = block.selectExpr("doc_id", "page_num", f"inline_outer(array(named_struct('seq', seq, 'block_id', block_id, 'script', {SCRIPT})))").filter(
        "script IS NOT NULL")
    per_page = seen.groupBy("doc_id", "script", "page_num").agg(F.expr("min(struct(seq, block_id)) AS first"))
    grouped = per_page.groupBy("doc_id", "script").agg(
        F.expr("min(page_num) AS page_num"), F.expr("count(*) AS n"), F.expr("min(first) AS first")
    )
    return _explode(grouped, [
        _finding("3.1.2", "fail", sql("script"), None, sql("first.block_id"), sql("page_num"), sql("n"), False,
                 "manual_review")
    ])


def duplicate_ids(block: DataFrame) -> DataFrame:
    """Identifiers used more than once in a document, with the first position of each."""
    return block.groupBy("doc_id", "block_id").agg(F.count("*").alias("uses"), F.min("seq").alias("first_seq")).filter(
        "uses > 1"
    )


def duplicate_id_findings(block: DataFrame) -> DataFrame:
    grouped = duplicate_ids(block).groupBy("doc_id").agg(
        F.expr("count(*) AS n"), F.expr("min_by(block_id, first_seq) AS block_id")
    )
    return _explode(grouped, [
        _finding("4.1.1", "fail", "duplicate_ids", None, sql("block_id"), 0, sql("n"), True)
    ])


# --- document rules ---------------------------------------------------------

MEDIA = ("1.2.1", "1.2.2", "1.2.3", "1.2.5", "1.4.2", "2.2.2", "2.3.1")
SCRIPTED = ("1.4.13", "2.1.4", "2.2.1", "2.5.1", "2.5.2", "4.1.3")
FORMS = ("2.5.3", "3.2.2", "3.3.1")
DOC_SET = ("3.2.3", "3.2.4")
NEVER = ("1.2.4", "2.4.7", "2.5.4", "3.3.3", "3.3.4")

_STEM = r"CASE WHEN contains(filename, '.') THEN regexp_replace(filename, r'(?s)\.[^.]*$', '') ELSE filename END"
_T = text.q_strip(f"coalesce(nullif(metadata['title'], ''), nullif(metadata['dc:title'], ''), {_STEM})")
# Why the title of a document does not describe it, or null.  Fixed values: shapes of titles that are not titles.
TITLE_PROBLEM = rf"""CASE WHEN coalesce({_T}, '') = '' THEN 'missing'
 WHEN {_T} rlike r'(?i)^.*\.(pdf|doc|docx|xls|xlsx|ppt|pptx|txt|rtf|odt)$' THEN 'filename'
 WHEN contains({_T}, '/') OR contains({_T}, {text.q(chr(92))}) THEN 'path'
 WHEN {_T} rlike r'(?i)^(untitled|document|doc\d*|page\d*|file\d*|new document|microsoft word)$' THEN 'generic'
 WHEN {_T} rlike r'(?i)^[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}$' THEN 'uuid'
 WHEN {_T} rlike r'(?i)^[0-9a-f]{{32,}}$' THEN 'hash'
 WHEN {_T} rlike r'^[a-z0-9][-_a-z0-9]*[a-z0-9]$' AND (contains({_T}, '-') OR contains({_T}, '_'))
  THEN 'filename_stem' END"""

_RAW = text.q_strip("coalesce(metadata['language'], '')")
_DECLARED = text.q_strip("coalesce(language, '')")
_TAG = f"coalesce(nullif({_RAW}, ''), {_DECLARED})"
LANGUAGE_PROBLEM = f"""CASE WHEN {text.q_first("metadata['language']", "metadata['lang']")} = ''
  AND coalesce(language, '') = 'en' AND {_RAW} = '' THEN 'unverified_default'
 WHEN {_TAG} = '' THEN 'missing' WHEN NOT {text.q_like(_TAG, text.BCP47)} THEN 'invalid_tag' END"""

# Forced rotation; a zero Rotate counts as unset and rotate is read instead.
ROTATION = "coalesce(CASE WHEN metadata['Rotate'] NOT IN ('', '0') THEN metadata['Rotate'] END, metadata['rotate'])"


def _document_rules() -> dict[str, tuple[set[str], list[str]]]:
    """Criterion -> (facts it reads, structs over the facts row); null structs are dropped."""
    fail, na, ok = "fail", "not_applicable", "pass"
    out: dict[str, tuple[set[str], list[str]]] = {}

    def names(*conditions):
        known = {*FEATURES, "pages", "order_breaks", "first_scanned", "first_text"}
        words = set(re.findall(r"\w+", " ".join(str(c) for c in conditions)))
        return {w for w in words if w in known or w.startswith(("n_", "bad_"))}

    def verdict(c, bad, issue, na_when=None, **kw):
        row = _finding(c, fail, issue, **kw)
        when = f"WHEN {na_when} THEN {_finding(c, na)} " if na_when else ""
        out[c] = (names(bad, na_when, row), [f"CASE {when}WHEN {bad} THEN {row} ELSE {_finding(c, ok)} END"])

    def gated(criteria, feature):
        for c in criteria:
            row = _finding(c, fail, "needs_review", None, "document", 0, remediation="manual_review")
            out[c] = (names(feature), [f"CASE WHEN {feature} THEN {row} ELSE {_finding(c, na)} END"])

    def clean(c, bad, na_when=None):
        """Row-level findings exist elsewhere; here only the pass or not-applicable row."""
        when = f"WHEN {na_when} THEN {_finding(c, na)} " if na_when else ""
        out[c] = (names(bad, na_when), [f"CASE {when}WHEN NOT ({bad}) THEN {_finding(c, ok)} END"])

    gated(MEDIA, "has_media")
    gated(SCRIPTED, "has_javascript")
    gated(FORMS, "has_forms")
    gated(DOC_SET, "is_document_set")
    gated(("3.2.1",), "has_forms OR has_javascript")
    for c in NEVER:
        out[c] = (set(), [_finding(c, na)])
    for c in ("1.1.1", "1.3.1", "1.3.2", "1.3.3", "1.4.1", "2.4.4", "3.1.2"):
        clean(c, f"bad_{c.replace('.', '_')} > 0")
    clean("1.3.5", "bad_1_3_5 > 0", "NOT has_forms")
    clean("3.3.2", "bad_3_3_2 > 0", "NOT has_forms")
    clean("4.1.2", "bad_4_1_2 > 0", "NOT has_forms AND NOT has_links")
    clean("2.4.6", "bad_2_4_6 > 0 OR n_skip > 0")
    clean("4.1.1", "bad_4_1_1 > 0 OR n_duplicate > 0")
    verdict("1.3.4", f"({ROTATION}) IS NOT NULL", "rotation", element="document", remediation="manual_review",
            evidence=sql(ROTATION))
    pages = dict(page=sql("first_scanned"), n=sql("n_scanned"), remediation="manual_review")
    scanned = dict(issue="scanned_pages", severity="serious", element="scanned_pages", **pages)
    texts = dict(issue="text_pages", severity="moderate", element="text_pages", page=sql("first_text"),
                 n=sql("n_text_page"), remediation="manual_review")
    out["1.4.3"] = (
        {"n_scanned"},
        [f"CASE WHEN n_scanned > 0 THEN {_finding('1.4.3', fail, **scanned)} END",
         f"CASE WHEN n_text_page > 0 THEN {_finding('1.4.3', na, **texts)} END",
         f"CASE WHEN n_page = 0 THEN {_finding('1.4.3', ok)} END"],
    )
    verdict("1.4.4", "n_scanned > 0", "scanned_pages", element=sql("concat('page_', first_scanned)"), **pages)
    out["1.4.5"] = (
        {"n_scanned", "bad_1_4_5"},
        [f"CASE WHEN n_scanned > 0 THEN {_finding('1.4.5', fail, **scanned)} END",
         f"CASE WHEN n_scanned = 0 AND bad_1_4_5 = 0 THEN {_finding('1.4.5', ok)} END"],
    )
    for c in ("1.4.10", "1.4.12"):
        verdict(c, "n_heading + n_list + n_table + n_paragraph = 0", "no_structure", element="document", auto=True,
                remediation="auto_fix")
    verdict("1.4.11", "n_form_field + n_chart > 0", "needs_contrast_review", element="document",
            n=sql("n_form_field + n_chart"), remediation="manual_review")
    idle = "NOT has_forms AND NOT has_links AND NOT has_javascript"
    verdict("2.1.1", "true", "needs_keyboard_test", idle, element="document", n=sql("n_form_field + n_link"),
            remediation="manual_review")
    verdict("2.1.2", "has_javascript", "scripted", "NOT has_javascript AND NOT has_forms", element="document",
            remediation="manual_review")
    verdict("2.4.1", "n_heading = 0 AND (pages > 1 OR n_block > 10)", "no_headings", element="document", auto=True)
    verdict("2.4.2", f"({TITLE_PROBLEM}) IS NOT NULL", sql(TITLE_PROBLEM), element="document", auto=True,
            evidence=sql(_T))
    verdict("2.4.3", "order_breaks > 0", "order_breaks", idle, element="document", severity="serious",
            n=sql("order_breaks"), remediation="manual_review")
    verdict("2.4.5", "n_heading = 0", "no_headings", element="document", auto=True)
    verdict("3.1.1", f"({LANGUAGE_PROBLEM}) IS NOT NULL", sql(LANGUAGE_PROBLEM), element="document", auto=True)
    return out


DOCUMENT_RULES = _document_rules()


def document_findings(corpus: Corpus, criteria: Iterable[str], flags: DataFrame | None = None) -> DataFrame:
    chosen = [DOCUMENT_RULES[c] for c in CRITERIA if c in set(criteria)]
    facts = doc_facts(corpus, set().union(*[names for names, _ in chosen]), flags)
    return _explode(facts, [row for _, rows in chosen for row in rows])


def audit_documents(corpus: Corpus, flags: DataFrame | None = None) -> DataFrame:
    """Outcome counts and coverage per document, straight from the facts row.

    The facts count every failure, so a rule without a document row has failed in its
    rows; neither the findings nor a second grouping are needed.
    """
    names = set().union(*[n for n, _ in DOCUMENT_RULES.values()])
    statuses = []
    for c in CRITERIA:
        found = f"array_compact(array({', '.join(f'({row}).status' for row in DOCUMENT_RULES[c][1])}))"
        statuses.append(found)
    facts = doc_facts(corpus, names, flags).selectExpr("doc_id", f"array({', '.join(statuses)}) AS found")
    each = """transform(found, s -> CASE WHEN size(s) = 0 OR array_contains(s, 'fail') THEN 'fail'
     WHEN array_contains(s, 'not_applicable') THEN 'not_applicable' ELSE 'pass' END)"""
    counted = facts.selectExpr("doc_id", f"{each} AS s").selectExpr(
        "doc_id", "CAST(size(s) AS BIGINT) AS rules_checked",
        *[f"CAST(size(filter(s, x -> x = '{v}')) AS BIGINT) AS {n}" for v, n in (
            ("pass", "rules_passed"), ("fail", "rules_failed"), ("not_applicable", "rules_not_applicable"))],
        "0L AS rules_errored")
    return counted.withColumn("coverage_pct", F.expr(
        "bround((rules_passed + rules_failed) * 100.0D / greatest(rules_checked - rules_not_applicable, 1), 1)"))


Check = Callable[[Corpus], DataFrame]
_EXTRA_CHECKS: dict[str, Check] = {}


def register_check(rule: str, check: Check) -> None:
    """Add a check of your own: a function from the corpus to a finding table.

    A check that fails while its plan is built becomes one error finding per document.
    """
    _EXTRA_CHECKS[rule] = check


def _run_extra(corpus: Corpus, rule: str, check: Check) -> DataFrame:
    try:
        return check(corpus).select(*FINDING)
    except Exception as problem:
        return corpus.doc.select(
            "doc_id", F.lit(rule).alias("rule_id"), F.lit(rule).alias("criterion"), F.lit("error").alias("status"),
            F.lit("critical").alias("severity"), F.lit("").alias("element_id"), F.lit(0).alias("page"),
            F.lit("check_failed").alias("issue"), F.lit(1).cast("bigint").alias("n"),
            F.lit(False).alias("auto_fixable"), F.lit("manual_review").alias("remediation_type"),
            F.lit(str(problem)).alias("evidence"),
        )


def audit_findings(
    corpus: Corpus, criteria: Iterable[str] | None = None, flags: DataFrame | None = None
) -> DataFrame:
    """Findings of the chosen rules; every rule yields at least one row per document."""
    chosen = set(criteria or CRITERIA)
    parts = [document_findings(corpus, chosen, flags)]
    block = corpus.block
    for part in (block_findings(block, chosen), page_findings(block, chosen)):
        if part is not None:
            parts.append(part)
    own = {"1.1.1": image_page_findings, "2.4.6": skip_findings, "3.1.2": script_findings, "4.1.1": duplicate_id_findings}
    parts += [fn(block) for c, fn in own.items() if c in chosen]
    if criteria is None:
        parts += [_run_extra(corpus, r, fn) for r, fn in _EXTRA_CHECKS.items()]
    return reduce(DataFrame.unionByName, parts)
