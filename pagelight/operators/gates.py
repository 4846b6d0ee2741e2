"""Validation gates, the ledger and the publication verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelight.functions import scan
from pagelight.functions.text import q, q_blank, q_like
from pagelight.operators.html_checks import _plain
from pagelight.sources.html import all_of
from pagelight.sources.schemas import BLOCK_TYPES, Corpus

CHECK = ("doc_id", "gate_id", "check_name", "status", "severity", "priority", "next_action", "n")
PASS = ("pass", "minor", "P2", "proceed")
HARD = ("hard_fail", "critical", "P0", "block")
SOFT = ("soft_fail", "serious", "P1", "flag_hitl")
SOFT_MODERATE = ("soft_fail", "moderate", "P1", "flag_hitl")


def _check(gate: str, name: str, verdict: tuple, n: str = "0") -> str:
    status, severity, priority, action = (q(v) for v in verdict)
    return (f"named_struct('gate_id', {q(gate)}, 'check_name', {q(name)}, 'status', {status}, 'severity', {severity}, "
            f"'priority', {priority}, 'next_action', {action}, 'n', CAST({n} AS BIGINT))")


def _either(gate, name, bad, verdict, n="0", when="true") -> str:
    return (f"CASE WHEN NOT ({when}) THEN NULL WHEN {bad} THEN {_check(gate, name, verdict, n)} "
            f"ELSE {_check(gate, name, PASS)} END")


def _only(gate, name, bad, verdict, n="0") -> str:
    return f"CASE WHEN {bad} THEN {_check(gate, name, verdict, n)} END"


def _emit(df: DataFrame, checks: list[str]) -> DataFrame:
    rows = df.selectExpr("doc_id", f"inline_outer(array_compact(array({', '.join(checks)})))")
    return rows.filter("check_name IS NOT NULL").select(*CHECK)


BOX = "NOT (x1 = 0 AND x2 = 0) AND x2 > x1"
#: What decides most pages: the least right edge and middle, the greatest left edge and middle.
EXTREMES = {"least_right": "min(CASE WHEN {box} THEN x2 END)", "least_middle": "min(CASE WHEN {box} THEN (x1 + x2) / 2 END)",
            "most_left": "max(CASE WHEN {box} THEN x1 END)", "most_middle": "max(CASE WHEN {box} THEN (x1 + x2) / 2 END)"}
APART = "coalesce(least_right <= most_left, false)"
UNDECIDED = f"NOT {APART} AND least_middle <= most_left AND least_right <= most_middle"


def _column_scan(box: DataFrame) -> DataFrame:
    """Pages (doc_id, page_num) of the boxes (doc_id, page_num, x1, x2) that hold a qualifying pair, by a sorted running minimum.

    Sorting both kinds of points by the first coordinate and keeping the smallest right
    edge seen so far finds such a pair without comparing all pairs.
    """
    events = box.selectExpr(
        "doc_id", "page_num",
        "inline(array(named_struct('at', (x1 + x2) / 2, 'kind', 0, 'value', x2), "
        "named_struct('at', x1, 'kind', 1, 'value', (x1 + x2) / 2)))",
    )
    # Equal coordinates merge before the shuffle: smallest right edge, largest middle.
    points = events.groupBy("doc_id", "page_num", "at", "kind").agg(
        F.expr("CASE WHEN kind = 0 THEN min(value) ELSE max(value) END AS value"))
    seen = scan.running(
        points, ["doc_id", "page_num"], ["at", "kind"],
        {"least_right": scan.running_min(F.expr("CASE WHEN kind = 0 THEN value END"))},
        segment=[F.floor(F.col("at") / 100)],
    )
    return seen.filter("kind = 1 AND least_right <= value").select("doc_id", "page_num").distinct()


def multi_column_pages(block: DataFrame) -> DataFrame:
    """Pages where some pair of blocks overlaps by at most half of the narrower one.

    For a pair with a left of b the condition is mid(a) <= left(b) and right(a) <= mid(b).  Boxes that lie apart
    settle a page by its extremes, and so does a page whose extremes allow no pair.  Only pages where every box
    crosses a common line and some are far enough aside are scanned.
    """
    box = block.filter(BOX).select("doc_id", "page_num", "x1", "x2")
    page = box.groupBy("doc_id", "page_num").agg(*[F.expr(f"{e.format(box='true')} AS {n}") for n, e in EXTREMES.items()])
    open_page = page.filter(UNDECIDED).select("doc_id", "page_num")
    return page.filter(APART).select("doc_id", "page_num").union(_column_scan(_semi(box, open_page)))


def _semi(box: DataFrame, page: DataFrame) -> DataFrame:
    """The boxes of some pages; null page numbers are a page too."""
    return box.alias("b").join(
        page.alias("p"), F.col("b.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("b.page_num").eqNullSafe(F.col("p.page_num")), "left_semi")


_G1 = (
    _either("G1", "has_pages", "n_page = 0", HARD),
    _either("G1", "non_empty_pages", "n_empty > 0", SOFT, "n_empty", "n_page > 0"),
    _either("G1", "has_text_content", "n_text = 0", HARD, "n_block", "n_block > 0"),
    _only("G1", "text_coverage", "n_page > 0 AND n_text_page / n_page < 0.1", SOFT, "n_text_page"),
    _either("G1", "multi_column_bbox", "n_column_page > 0", SOFT_MODERATE, "n_column_page"),
)
_PAGE_ORDER = _either("G2", "page_order", "n_back > 0", SOFT, "n_back")
_G2 = (
    _either("G2", "unique_block_ids", "n_repeat > 0", HARD, "n_repeat"),
    _either("G2", "valid_block_types", "n_type > 0", HARD, "n_type"),
    _only("G2", "non_empty_ids", "n_blank > 0", HARD, "n_blank"),
)
_TYPES = ", ".join(q(t) for t in BLOCK_TYPES)
_BAD_TYPE = f"NOT coalesce(block_type IN ({_TYPES}), false)"


def g1(corpus: Corpus, columns: bool = True) -> DataFrame:
    """Pages and text of a document; without ``columns`` the search for several columns is left out."""
    per_page = corpus.block.groupBy("doc_id", "page_num").agg(
        F.expr("count(*) AS n_block"), F.expr(f"count_if(NOT {q_blank('content')}) AS n_text"))
    joined = corpus.page.select("doc_id", "page_num").join(per_page, ["doc_id", "page_num"], "left").fillna(
        0, ["n_block", "n_text"])
    pages = joined.groupBy("doc_id").agg(
        F.expr("count(*) AS n_page"), F.expr("count_if(n_block = 0) AS n_empty"), F.expr("sum(n_block) AS n_block"),
        F.expr("sum(n_text) AS n_text"), F.expr("count_if(n_text > 0) AS n_text_page"))
    facts = corpus.doc.select("doc_id").join(pages, "doc_id", "left")
    if columns:
        aside = multi_column_pages(corpus.block).groupBy("doc_id").agg(F.expr("count(*) AS n_column_page"))
        facts = facts.join(aside, "doc_id", "left")
    return _emit(facts.fillna(0), [*_G1] if columns else [*_G1[:-1]])


def g2(corpus: Corpus) -> DataFrame:
    """Identifiers, types and page order."""
    ids = corpus.block.groupBy("doc_id", F.expr("coalesce(block_id, '') AS block_id")).agg(
        F.expr("count(*) AS uses"), F.expr(f"count_if({_BAD_TYPE}) AS bad_type"))
    per_doc = ids.groupBy("doc_id").agg(
        F.expr("sum(uses - 1) AS n_repeat"), F.expr("sum(bad_type) AS n_type"),
        F.expr("sum(CASE WHEN block_id = '' THEN uses ELSE 0 END) AS n_blank"))
    pages = scan.running(
        corpus.page.select("doc_id", "page_num", F.col("page_num").alias("pos")), ["doc_id"], ["pos"],
        {"before": scan.previous(F.col("page_num"))},
    ).groupBy("doc_id").agg(F.expr("count_if(page_num < before) AS n_back"))
    facts = corpus.doc.select("doc_id").join(per_doc, "doc_id", "left").join(pages, "doc_id", "left").fillna(0)
    return _emit(facts, [_G2[0], _PAGE_ORDER, *_G2[1:]])


def structure_facts(corpus: Corpus) -> DataFrame:
    """One wide row per document with all that the gates ask about its pages and blocks, from one read of the blocks.

    Narrow rows are dealt out by document and segment, as in the audit; pages and repeated ids are counted inside of
    a segment and summed per page, then per document.  Ids of documents with several segments are compared once
    more, and boxes of pages that their extremes leave undecided are scanned; both read the same exchange.
    A document without pages or blocks has zeros.
    """
    rows = corpus.block.selectExpr(
        "doc_id", "page_num", "coalesce(block_id, '') AS block_id", f"NOT {q_blank('content')} AS filled", f"{_BAD_TYPE} AS bad_type",
        f"CASE WHEN {BOX} THEN x1 END AS x1", f"CASE WHEN {BOX} THEN x2 END AS x2", "seq",
    ).withColumn("segment", scan.segment_of(F.col("seq"))).drop("seq").repartition("doc_id", "segment")
    # Reading every column keeps column pruning from splitting the shared exchange in two.
    whole = F.xxhash64(*rows.columns).isNotNull()
    same_id = Window.partitionBy("doc_id", "segment", "block_id").orderBy("page_num")
    sums = {
        "n_page": "0L", "n_block": "count(page_num)", "n_text": "count_if(filled AND page_num IS NOT NULL)", "n_repeat": "count_if(use > 1)",
        "n_type": "count_if(bad_type)", "n_blank": "count_if(block_id = '')"}
    extremes = {n: e.format(box="true") for n, e in EXTREMES.items()}
    within = rows.withColumn("use", F.row_number().over(same_id)).groupBy("doc_id", "segment", "page_num").agg(
        *[F.expr(f"{e} AS {n}") for n, e in {**sums, **extremes}.items()]).drop("segment")
    listed = corpus.page.selectExpr("doc_id", "page_num", "1L AS n_page")
    page = within.unionByName(listed, allowMissingColumns=True).groupBy("doc_id", "page_num").agg(
        *[F.expr(f"coalesce(sum({n}), 0L) AS {n}") for n in sums], *[F.expr(f"{e[:3]}({n}) AS {n}") for n, e in extremes.items()])
    scanned = _column_scan(_semi(rows.filter(whole & F.expr("x1 IS NOT NULL")).select("doc_id", "page_num", "x1", "x2"),
                                 page.filter(UNDECIDED).select("doc_id", "page_num")))
    ids = rows.withColumn("full", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "segment")) >= scan.SEGMENT_ROWS).filter(
        whole & F.expr("full OR segment > 0")).select("doc_id", "segment", "block_id").distinct()
    again = ids.groupBy("doc_id", "block_id").agg(F.expr("count(*) - 1 AS n_repeat")).filter("n_repeat > 0")
    parts = page.selectExpr(
        "doc_id", "n_page", "CASE WHEN n_block = 0 THEN n_page ELSE 0L END AS n_empty", "n_page * n_block AS n_block", "n_page * n_text AS n_text",
        "CASE WHEN n_text > 0 THEN n_page ELSE 0L END AS n_text_page", f"CAST({APART} AS BIGINT) AS n_column_page", "n_repeat", "n_type", "n_blank",
    ).unionByName(scanned.selectExpr("doc_id", "1L AS n_column_page"), allowMissingColumns=True).unionByName(
        again.select("doc_id", "n_repeat"), allowMissingColumns=True)
    facts = parts.groupBy("doc_id").agg(*[F.sum(n).alias(n) for n in parts.columns if n != "doc_id"])
    return corpus.doc.select("doc_id").join(facts, "doc_id", "left").fillna(0)


def structure_checks(corpus: Corpus) -> DataFrame:
    """The checks of the first two gates but the page order, unpivoted from ``structure_facts``."""
    return _emit(structure_facts(corpus), [*_G1, *_G2])


def page_order_checks(page: DataFrame) -> DataFrame:
    """Page numbers must not fall along the list position ``pos``."""
    seen = scan.running(page, ["doc_id"], ["pos"], {"before": scan.previous(F.col("page_num"))})
    return _emit(seen.groupBy("doc_id").agg(F.expr("count_if(page_num < before) AS n_back")),
                 [_PAGE_ORDER])


SHORT_LIMIT, SHORT_RUN = 60, 5


def g3_structural(html: DataFrame) -> DataFrame:
    """Structural checks of an HTML page, narrow."""
    imgs = all_of("html", r"(?i)<img[^>]*>")
    paras = all_of("html", r"(?is)<p[^>]*>(.*?)</p>", 1)
    short = f"transform({paras}, x -> length(trim({_plain('x')})) < {SHORT_LIMIT})"
    facts = html.selectExpr(
        "doc_id", r"html rlike r'(?i)<html[^>]*\blang=\x22([^\x22]+)\x22' AS has_lang",
        rf"size(filter({imgs}, x -> NOT x rlike r'(?i)<img[^>]*\balt=')) AS no_alt",
        rf"size(filter({imgs}, x -> NOT x rlike r'(?i)<img[^>]*\bsrc=')) AS no_src",
        r"regexp_count(html, r'(?i)<img[^>]*\bsrc\s*=\s*(?:\x22\x22|\x27\x27)\s*[^>]*>') AS empty_src",
        f"{all_of('html', r'(?is)<table\b[^>]*>.*?</table>')} AS tables",
        f"transform({all_of('html', r'(?i)<h([0-9])\b', 1)}, x -> CAST(x AS INT)) AS levels",
        f"size({paras}) AS n_para", "contains(lower(html), '<main') AS has_main",
        f"aggregate({short}, named_struct('run', 0, 'best', 0), (a, s) -> named_struct("
        "'run', CASE WHEN s THEN a.run + 1 ELSE 0 END, "
        "'best', greatest(a.best, CASE WHEN s THEN a.run + 1 ELSE 0 END)), a -> a.best) AS longest_short",
    ).selectExpr(
        "*", r"size(filter(tables, t -> NOT t rlike r'(?i)<th[^>]*\bscope=[\x22\x27](?:col|row)[\x22\x27]')) AS no_scope",
        "size(filter(sequence(2, greatest(size(levels), 2)), i -> i <= size(levels) AND "
        "element_at(levels, i) > element_at(levels, i - 1) + 1)) AS n_skip",
    )
    header_fail = ("hard_fail", "serious", "P1", "flag_hitl")
    return _emit(facts, [
        _either("G3", "html_lang", "NOT has_lang", HARD),
        _only("G3", "img_alt", "no_alt > 0", HARD, "no_alt"),
        _only("G3", "img_src", "no_src + empty_src > 0", HARD, "no_src + empty_src"),
        _either("G3", "table_headers", "no_scope > 0", header_fail, "no_scope", "size(tables) > 0"),
        _only("G3", "content_no_headings", "size(levels) = 0 AND n_para > 5", HARD, "n_para"),
        _only("G3", "heading_hierarchy", "n_skip > 0", SOFT_MODERATE, "n_skip"),
        _either("G3", "main_landmark", "NOT has_main", SOFT_MODERATE),
        _only("G3", "multi_column_reading_order", f"longest_short >= {SHORT_RUN}", SOFT_MODERATE, "longest_short"),
    ])


def severity_checks(report: DataFrame, gate: str, prefix: str, clean: str) -> DataFrame:
    """Violations (doc_id, violations array<struct<id, impact>>) -> one check each, or a clean row."""
    hard = "v.impact IN ('critical', 'serious')"
    rows = report.selectExpr("doc_id", "explode_outer(violations) AS v").selectExpr(
        "doc_id", f"{q(gate)} AS gate_id",
        f"CASE WHEN v IS NULL THEN {q(clean)} ELSE concat({q(prefix)}, coalesce(v.id, 'unknown')) END AS check_name",
        f"CASE WHEN v IS NULL THEN 'pass' WHEN {hard} THEN 'hard_fail' ELSE 'soft_fail' END AS status",
        "CASE WHEN v.impact IN ('critical', 'serious', 'moderate') THEN v.impact ELSE 'minor' END AS severity",
        f"CASE WHEN v IS NULL THEN 'P2' WHEN {hard} THEN 'P0' ELSE 'P1' END AS priority",
        f"CASE WHEN v IS NULL THEN 'proceed' WHEN {hard} THEN 'block' ELSE 'flag_hitl' END AS next_action",
        "CAST(1 AS BIGINT) AS n",
    )
    return rows.select(*CHECK)


def draft_downgrade(check: DataFrame) -> DataFrame:
    """In drafts a hard browser-rule failure only flags; structural failures keep blocking."""
    soft = "status = 'hard_fail' AND startswith(check_name, 'axe_')"
    return check.selectExpr(
        "doc_id", "gate_id", "check_name", f"CASE WHEN {soft} THEN 'soft_fail' ELSE status END AS status", "severity",
        f"CASE WHEN {soft} THEN 'P1' ELSE priority END AS priority",
        f"CASE WHEN {soft} THEN 'flag_hitl' ELSE next_action END AS next_action", "n")


def g4_catalog(facts: DataFrame) -> DataFrame:
    """Catalog facts (pages, n_bytes, struct_tree, mark_info, marked, lang, validator) -> checks.

    Without any validator the tag structure is unknown and the document blocks.
    """
    return _emit(facts, [
        _either("G4", "pdf_has_pages", "pages = 0", HARD),
        _only("G4", "pdf_size", "n_bytes < 100", HARD, "n_bytes"),
        _either("G4", "pdf_struct_tree_root", "NOT struct_tree", HARD, when="validator"),
        _either("G4", "pdf_mark_info", "NOT (mark_info AND coalesce(marked, false))", SOFT, when="validator"),
        _either("G4", "pdf_lang", "lang IS NULL", HARD, when="validator"),
        _only("G4", "pdf_no_validator", "NOT validator", HARD),
    ])


UNAVAILABLE = ("adobe_checker_unavailable", "adobe_checker_import_error", "adobe_checker_error")


def checker_gate(issues: DataFrame) -> DataFrame:
    """(doc_id, available, violations) -> checks; a document without a checker gets one soft failure."""
    there = severity_checks(issues.filter("available").select("doc_id", "violations"), "G4", "adobe_", "adobe_checker_pass")
    return there.unionByName(_emit(issues.filter("NOT available"), [_check("G4", UNAVAILABLE[0], SOFT)]))


def with_fallback(checker: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add the catalog checks where the checker was unavailable."""
    missing = checker.filter(F.col("check_name").isin(*UNAVAILABLE)).select("doc_id").distinct()
    return checker.unionByName(catalog.join(missing, "doc_id", "left_semi"))


PDFUA = "G4-VeraPDF"


def clause_gate(validation: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """PDF/UA compliance, one check per failed clause and the change against a baseline run."""
    fail = ("soft_fail", "serious", "P1", "flag_hitl")
    facts = validation
    checks = [
        _only(PDFUA, "verapdf_available", "NOT available", SOFT_MODERATE),
        _either(PDFUA, "pdfua1_compliance", "NOT compliant", fail, "error_count", "available"),
    ]
    if baseline is not None:
        facts = facts.join(baseline.selectExpr("doc_id", "error_count AS before"), "doc_id", "left")
        checks.append(_either(PDFUA, "verapdf_delta", "error_count > before", fail, "before - error_count",
                              "available AND before IS NOT NULL"))
    clauses = validation.filter("available").select("doc_id", F.explode("clauses").alias("clause")).selectExpr(
        "doc_id", f"{q(PDFUA)} AS gate_id", "concat('clause_', clause) AS check_name", "'soft_fail' AS status",
        "'serious' AS severity", "'P1' AS priority", "'flag_hitl' AS next_action", "CAST(1 AS BIGINT) AS n")
    return _emit(facts, checks).unionByName(clauses)


def validation_delta(baseline: DataFrame, endline: DataFrame) -> DataFrame:
    """Error counts before and after; not worse counts as improved."""
    return baseline.selectExpr("doc_id", "error_count AS before").join(
        endline.selectExpr("doc_id", "error_count AS after"), "doc_id"
    ).selectExpr("doc_id", "before", "after", "before - after AS delta", "after <= before AS improved")


def gate_rollup(check: DataFrame) -> DataFrame:
    """A gate passes without hard failures; the PDF/UA gate only when everything passes."""
    return check.groupBy("doc_id", "gate_id").agg(
        F.expr(f"CASE WHEN gate_id = {q(PDFUA)} THEN bool_and(status = 'pass') ELSE bool_and(status <> 'hard_fail') END AS passed"))


_COUNTS = {
    "total_checks": "count(*)", "passed": "count_if(status = 'pass')", "soft_fails": "count_if(status = 'soft_fail')",
    "hard_fails": "count_if(status = 'hard_fail')",
    **{f"{p.lower()}_count": f"count_if(priority = '{p}' AND status <> 'pass')" for p in ("P0", "P1", "P2")}}
_VERDICT = {
    "decision": "CASE WHEN p0_count > 0 THEN 'block' WHEN p1_count > 0 THEN 'flag_hitl' ELSE 'proceed' END",
    "overall": "CASE WHEN hard_fails > 0 THEN 'fail' ELSE 'pass' END"}


def ledger_summary(check: DataFrame) -> DataFrame:
    counted = check.groupBy("doc_id").agg(*[F.expr(f"{e} AS {n}") for n, e in _COUNTS.items()])
    return counted.selectExpr("*", *[f"{e} AS {n}" for n, e in _VERDICT.items()])


def publishable(check: DataFrame) -> DataFrame:
    """No open P0 or P1; an unreachable PDF/UA validator is forgiven when the checker passed."""
    exempt = f"gate_id = {q(PDFUA)} AND check_name IN ('verapdf_available', 'verapdf_validation')"
    passed = "gate_id = 'G4' AND check_name = 'adobe_checker_pass' AND status = 'pass'"
    open_p1 = "priority = 'P1' AND status <> 'pass'"
    # One set of the open checks, and the sentences' names from it.
    names = "array_join(array_sort(array_distinct(transform(filter(open, x -> {}), x -> x.check_name))), ', ')"
    per_doc = check.groupBy("doc_id").agg(
        F.expr(f"bool_or({passed}) AS checked"), F.expr("count_if(priority = 'P0' AND status <> 'pass') AS p0"),
        F.expr(f"count_if({open_p1}) AS p1_all"), F.expr(f"count_if({open_p1} AND {exempt}) AS p1_exempt"),
        F.expr("collect_set(CASE WHEN priority IN ('P0', 'P1') AND status <> 'pass' THEN "
               f"struct(priority, {exempt} AS exempt, check_name) END) AS open"),
    ).selectExpr(
        "*", "CASE WHEN checked THEN p1_all - p1_exempt ELSE p1_all END AS p1", names.format("x.priority = 'P0'") + " AS p0_names",
        names.format("x.priority = 'P1'") + " AS p1_all_names", names.format("x.priority = 'P1' AND NOT x.exempt") + " AS p1_names")
    return per_doc.selectExpr(
        "doc_id", "p0 = 0 AND p1 = 0 AS publishable",
        """CASE WHEN p0 > 0 THEN concat('Document blocked by ', p0, ' P0 issue(s): ', p0_names)
         WHEN p1 > 0 THEN concat('Document has ', p1, ' P1 issue(s) requiring HITL sign-off: ',
          CASE WHEN checked THEN p1_names ELSE p1_all_names END)
         ELSE 'No P0 or P1 issues — document is publishable' END AS reason""",
    )


def ledger(check: DataFrame, doc: DataFrame) -> DataFrame:
    """One nested record per document: gates with their checks, and the summary.

    The checks are read once and dealt out by document; both aggregations, by gate and by document, then find their rows in
    place, and the counts of the summary travel beside the lists.
    """
    gates = check.select(*CHECK).repartition("doc_id").groupBy("doc_id", "gate_id").agg(
        F.expr("array_sort(collect_list(struct(check_name, status, severity, priority, next_action, n))) AS checks"),
        F.expr("bool_and(status <> 'hard_fail') AS passed"), *[F.expr(f"{e} AS __{n}") for n, e in _COUNTS.items()])
    nested = gates.groupBy("doc_id").agg(
        F.expr("array_sort(collect_list(struct(gate_id, passed, checks))) AS gates"),
        *[F.expr(f"sum(__{n}) AS {n}") for n in _COUNTS])
    summary = ", ".join([*_COUNTS, *[f"{e} AS {n}" for n, e in _VERDICT.items()]])
    return doc.select("doc_id", "filename").join(nested.selectExpr("doc_id", "gates", f"struct({summary}) AS summary"), "doc_id")
