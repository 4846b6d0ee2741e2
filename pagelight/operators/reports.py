"""Aggregation, ranking and reporting over findings, gaps and validator votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelight.functions import scan, text
from pagelight.operators import checks
from pagelight.sources import dimensions
from pagelight.sources.schemas import Corpus

# Sentences of the failing issues; {n}, {page} and {evidence} are columns.
# The element type of a proposal is read from the sentence.
SENTENCES = {
    "missing": "Page {page}: {n} image(s) missing descriptive alt text (F30/F65).",
    "decorative": "Page {page}: {n} image(s) appear decorative (PDF4/F38). Mark as Artifact if purely decorative.",
    "long_alt": "Page {page}: {n} image(s) have alt text >150 chars — consider short alt + long description.",
    "table_caption_missing": "Table is missing a caption — tables must have a summary or caption to describe their purpose.",
    "layout_table": "Single-column table with no headers detected — possible layout table (F46).",
    "table_headers_missing": "Table lacks header row — relationships between data and headers cannot be programmatically determined (F91).",
    "table_row_width": "Table row width differs from the header row — header/data association is inconsistent (F90).",
    "list_empty": "List block has no items — list structure cannot be programmatically determined (PDF21).",
    "list_blank_items": "List has empty item(s) — list items must have content (PDF21).",
    "heading_level_invalid": "Heading has invalid level (must be 1-6).",
    "columns": "Page {page} has {n} distinct x-position clusters — possible multi-column layout that may affect reading order.",
    "sensory_reference": "Text contains sensory-only reference: '{evidence}...'",
    "rotation": "PDF metadata contains a /Rotate entry (value: {evidence}) which may force a specific orientation.",
    "field_name_missing": "Form field lacks a descriptive name attribute for input purpose identification.",
    "charts": "Page {page}: {n} chart/graph image(s) detected — verify color is not the sole means of conveying information.",
    "scanned_pages": "{n} scanned page(s) with no extractable text.",
    "long_image_text": "Image alt text is very long — may indicate an image of text.",
    "no_structure": "Document has no structure tags (no headings, paragraphs, lists, or tables).",
    "needs_contrast_review": "{n} element(s) require non-text contrast verification (3:1 minimum).",
    "needs_keyboard_test": "{n} interactive element(s) require keyboard accessibility testing. Verify all are reachable and operable via keyboard.",
    "no_headings": "Document lacks headings for navigation.",
    "order_breaks": "Tag tree reading order appears non-sequential — blocks are not consistently ordered by page and vertical position.",
    "generic_link_text": "Generic link text detected: '{evidence}'",
    "bare_url": "Bare URL without descriptive text: '{evidence}'. Link purpose is not clear from the URL alone.",
    "heading_empty": "Empty heading detected — headings must have descriptive text.",
    "level_skipped": "Heading level skipped: {evidence}.",
    "field_label_missing": "Form field has no label — purpose cannot be determined.",
    "field_instructions_missing": "Form field has no label or instructions — users cannot determine what input is required.",
    "duplicate_ids": "{n} duplicate block IDs detected. Structure element IDs must be unique.",
    "block_type_invalid": "Invalid block_type.",
    "field_accessible_name_missing": "Form field has no accessible name (F68) — assistive technology cannot identify its purpose.",
}
SEVERITY_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'serious' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END"


def sentence() -> str:
    """SQL text of the sentence of a failing finding."""
    whens = []
    for issue, template in SENTENCES.items():
        parts = text.q(template)
        for name in ("n", "page", "evidence"):
            parts = f"replace({parts}, '{{{name}}}', CAST({name} AS STRING))" if "{" + name + "}" in template else parts
        whens.append(f"WHEN {text.q(issue)} THEN {parts}")
    title = "concat('Title does not identify document contents (F25). Title \\'', evidence, '\\'')"
    other = (
        f"CASE WHEN criterion = '2.4.2' THEN {title} WHEN criterion = '3.1.1' THEN 'Document language tag is missing or "
        "not valid.' WHEN criterion = '3.1.2' THEN concat(issue, ' characters detected on ', n, ' page(s).') "
        "ELSE 'Cannot verify automatically. Manual review required.' END"
    )
    return f"CASE issue {' '.join(whens)} ELSE {other} END"


def rule_status(findings: DataFrame) -> DataFrame:
    """Status per (document, rule): fail > error > not applicable > pass."""
    return findings.groupBy("doc_id", "criterion").agg(
        F.expr("""CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'error') THEN 'error'
         WHEN bool_or(status = 'not_applicable') THEN 'not_applicable' ELSE 'pass' END AS status""")
    )


def audit_result(findings: DataFrame) -> DataFrame:
    """Per document: rules checked and their outcomes, coverage of the applicable ones."""
    counted = rule_status(findings).groupBy("doc_id").agg(
        F.expr("count(*) AS rules_checked"), F.expr("count_if(status = 'pass') AS rules_passed"),
        F.expr("count_if(status = 'fail') AS rules_failed"),
        F.expr("count_if(status = 'not_applicable') AS rules_not_applicable"),
        F.expr("count_if(status = 'error') AS rules_errored"),
    )
    return counted.withColumn(
        "coverage_pct",
        F.expr("""bround((rules_passed + rules_failed) * 100.0D
         / greatest(rules_checked - rules_not_applicable, 1), 1)"""),
    )


def severity_summary(findings: DataFrame) -> DataFrame:
    """Per document: failing findings by severity, fixable or for review; zeros without any."""
    fails = "status = 'fail'"
    return findings.groupBy("doc_id").agg(
        F.expr(f"count_if({fails}) AS total_issues"),
        *[F.expr(f"count_if({fails} AND severity = '{s}') AS {n}") for s, n in (
            ("critical", "critical"), ("serious", "serious"), ("moderate", "moderate"), ("minor", "warning"))],
        F.expr(f"count_if({fails} AND auto_fixable) AS auto_fixable"),
        F.expr(f"count_if({fails} AND NOT auto_fixable) AS needs_review"),
    )


def rule_breakdown(doc: DataFrame, findings: DataFrame) -> DataFrame:
    """Every rule for every document; a rule is not applicable only if all its findings are."""
    rules = F.array(*[F.lit(c) for c in checks.CRITERIA])
    grid = doc.select("doc_id", F.explode(rules).alias("criterion"))
    seen = findings.groupBy("doc_id", "criterion").agg(
        F.expr("count(*) AS n_all"), F.expr("count_if(status = 'fail') AS n_fail"),
        F.expr("count_if(status = 'error') AS n_error"), F.expr("count_if(status = 'not_applicable') AS n_na"),
        F.expr(f"max_by(severity, {SEVERITY_RANK}) FILTER (WHERE status = 'fail') AS severity_max"),
    )
    return grid.join(seen, ["doc_id", "criterion"], "left").selectExpr(
        "doc_id", "criterion",
        """CASE WHEN n_fail > 0 THEN 'fail' WHEN n_error > 0 THEN 'error' WHEN n_na = n_all THEN 'not_applicable'
         WHEN n_all > 0 THEN 'pass' ELSE 'not_applicable' END AS status""",
        "coalesce(n_fail, 0) AS finding_count", "severity_max",
    )


def proposals(findings: DataFrame) -> DataFrame:
    """Failing findings as review proposals."""
    told = findings.filter("status = 'fail'").withColumn("description", F.expr(sentence()))
    said = "lower(description)"
    return told.selectExpr(
        "doc_id", "coalesce(nullif(element_id, ''), concat('wcag_', replace(criterion, '.', '_'))) AS proposal_id",
        "criterion",
        f"""CASE WHEN criterion = '1.1.1' THEN 'image' WHEN contains({said}, 'table') THEN 'table'
         WHEN contains({said}, 'heading') THEN 'heading' WHEN contains({said}, 'link') THEN 'link'
         ELSE 'document' END AS element_type""",
        "nullif(trim(regexp_extract(evidence, r'image_ids:\\s*(.+?)(?:\\s*\\||\\s*$)', 1)), '') AS image_id",
        "description", "severity", "page", "auto_fixable", "remediation_type AS action_type", "issue",
    )


PRIORITY = f"""({SEVERITY_RANK}) * 2 + CASE WHEN auto_fixable THEN 0 ELSE 2 END
 + CASE action_type WHEN 'manual_review' THEN 3 WHEN 'ai_draft' THEN 1 ELSE 0 END"""


def ranked(proposal: DataFrame, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """Review rank within a document: priority first, then the given order (rule, page, ...).

    With ``keep`` only those columns and the order stay beside the rank.  Name them where others would be dropped afterwards:
    the two uses of the scan's exchange then have the same columns and share it, and the findings are computed once.
    """
    scored = proposal.withColumn("priority", F.expr(PRIORITY))
    if keep is not None:
        scored = scored.select(*dict.fromkeys(["doc_id", *keep, *order, "priority"]))
    ranked_rows = scan.running(
        scored.withColumn("__down", -F.col("priority")), ["doc_id"], ["__down", *order],
        {"review_rank": scan.row_position()}, segment=[F.col("__down"), F.col(order[0]), F.floor(F.col(order[1]) / 1000)],
    )
    return ranked_rows.drop("__down")


def internal_results(findings: DataFrame) -> DataFrame:
    """First status per (document, rule), overridden by any failure."""
    return findings.groupBy("doc_id", "criterion").agg(
        F.expr("CASE WHEN bool_or(status = 'fail') THEN 'fail' ELSE min_by(status, seq) END AS status")
    )


def join_votes(internal: DataFrame, pdfua: DataFrame, matterhorn: DataFrame) -> DataFrame:
    """Full outer join of three result tables; a missing result is a skip."""
    key = ["doc_id", "rule_id"]
    sides = [
        d.select(*key, F.col("result").alias(n))
        for n, d in (("internal", internal), ("pdfua", pdfua), ("matterhorn", matterhorn))
    ]
    out = sides[0].join(sides[1], key, "full_outer").join(sides[2], key, "full_outer")
    return out.fillna("skip", ["internal", "pdfua", "matterhorn"])


def vote_confidence(votes: DataFrame) -> DataFrame:
    three = "filter(array(internal, pdfua, matterhorn), v -> v IN ('pass', 'fail'))"
    counted = votes.selectExpr(
        "*", f"size({three}) AS votes", f"size(filter({three}, v -> v = 'pass')) AS passes"
    )
    return counted.selectExpr(
        "doc_id", "rule_id", "internal", "pdfua", "matterhorn",
        """CASE WHEN votes < 2 THEN 'low' WHEN passes IN (0, votes) THEN 'high' WHEN passes * 2 <> votes THEN 'medium'
         ELSE 'low' END AS confidence""",
        "votes = 0 OR (votes > 1 AND passes NOT IN (0, votes) AND passes * 2 = votes) AS needs_review",
    )


def all_rule_ids(*tables: DataFrame) -> DataFrame:
    """Union of the keys of several result tables."""
    out = tables[0].select("doc_id", "rule_id")
    for t in tables[1:]:
        out = out.union(t.select("doc_id", "rule_id"))
    return out.distinct()


def confidence_histogram(confidence: DataFrame) -> DataFrame:
    return confidence.groupBy("doc_id").agg(
        *[F.expr(f"count_if(confidence = '{c}') AS {c}") for c in ("high", "medium", "low")],
        F.expr("count_if(needs_review) AS needs_review"),
    )


def applicable_rules(features: DataFrame, rule: DataFrame) -> DataFrame:
    """Rules that apply to each document, by the keyword of the rule's condition.

    The condition decides which feature switches a rule on, so the decision is made
    once per rule and the documents meet it through an exploded array of 50 entries.
    """
    cond = F.lower("condition")

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | cond.contains(w)
        return out

    # "form" only decides when the document has forms; otherwise the later keywords do.
    rest = (
        F.when(has("media", "audio", "video"), "has_media")
        .when(has("javascript", "interactive"), "has_javascript")
        .when(has("document set"), "is_document_set")
        .when(has("hover", "focus"), "has_javascript")
        .when(has("animated", "flash", "moving"), "has_media")
        .when(has("shortcut", "time", "pointer", "gesture", "motion"), "has_javascript")
        .when(has("legal", "financial"), "has_forms")
        .when(has("status"), "has_javascript")
        .when(has("label", "validation", "error"), "has_forms")
        .otherwise("always")
    )
    conditional = F.col("applicability") == "conditional"
    switches = rule.select(
        "ord", "rule_id", "criterion", "level", "principle", "automation", "applicability", "remediation",
        F.when(F.col("applicability") == "always", "always").when(conditional, rest).otherwise("never").alias("switch"),
        (conditional & has("form")).alias("by_form"),
    )
    doc = features.withColumn(
        "on",
        F.expr("""array_compact(array('always', CASE WHEN has_forms THEN 'has_forms' END,
         CASE WHEN has_media THEN 'has_media' END, CASE WHEN has_javascript THEN 'has_javascript' END,
         CASE WHEN is_document_set THEN 'is_document_set' END))"""),
    )
    keyed = doc.select("doc_id", "has_forms", F.explode("on").alias("switch"))
    direct = keyed.join(switches, "switch")
    forms = doc.filter("has_forms").select("doc_id", F.lit(True).alias("by_form")).join(
        switches.filter("by_form").drop("switch"), "by_form"
    )
    columns = ["doc_id", "ord", "rule_id", "criterion", "level", "principle", "automation", "applicability",
               "remediation"]
    by_switch = direct.filter("NOT (has_forms AND by_form)").select(*columns)
    return by_switch.unionByName(forms.select(*columns))


def coverage_summary(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by level, automation, applicability and remediation, zero-filled."""
    facets = {
        "level": ["A", "AA"], "automation": ["automated", "semi_automated", "manual"],
        "applicability": ["always", "conditional", "never"], "remediation": ["auto_fix", "ai_draft", "manual_review"],
    }
    counts = rules.groupBy(*keys).agg(
        *[F.expr(f"count_if({f} = '{v}') AS {f}__{v}") for f, vs in facets.items() for v in vs]
    )
    rows = [f"named_struct('facet', '{f}', 'value', '{v}', 'n', {f}__{v})" for f, vs in facets.items() for v in vs]
    return counts.selectExpr(*keys, f"inline(array({', '.join(rows)}))")


def coverage_matrix(rules: DataFrame, xref: DataFrame) -> DataFrame:
    """One row per (document, criterion) with its techniques in order."""
    tech = xref.groupBy("criterion").agg(
        F.expr("array_sort(collect_list(CASE WHEN kind = 'technique' THEN struct(ord, technique_id) END)) AS t"),
        F.expr("array_sort(collect_list(CASE WHEN kind = 'failure' THEN struct(ord, technique_id) END)) AS f"),
    )
    return rules.join(tech, "criterion", "left").selectExpr(
        "doc_id", "criterion", "level", "coalesce(array_join(transform(t, x -> x.technique_id), ','), '') AS techniques",
        "coalesce(array_join(transform(f, x -> x.technique_id), ','), '') AS failures",
    )


# Content types, their criteria and the number of automated, assisted and human actions.
CONTENT_TYPES = [
    ("Images & Figures", ["1.1.1", "1.4.5", "1.4.11"], 3, 2, 3),
    ("Headings & Structure", ["1.3.1", "1.3.2", "2.4.1", "2.4.2", "2.4.6"], 3, 1, 2),
    ("Links & Navigation", ["2.4.4", "2.4.5", "4.1.2"], 2, 1, 2),
    ("Color & Contrast", ["1.4.1", "1.4.3", "1.4.11"], 1, 0, 3),
    ("Forms & Interactive", ["1.3.1", "1.3.5", "2.1.1", "3.3.1", "3.3.2", "3.3.3", "3.3.4", "4.1.2"], 3, 1, 3),
    ("Language & Text", ["3.1.1", "3.1.2", "1.4.4", "1.4.12"], 3, 1, 1),
    ("Multimedia", ["1.2.1", "1.2.2", "1.2.3", "1.2.4", "1.2.5", "1.4.2", "2.3.1"], 1, 0, 3),
]


def content_type_matrix(findings: DataFrame, types: DataFrame) -> DataFrame:
    """Action counts per content type with the failures its criteria collected."""
    fails = findings.filter("status = 'fail'").groupBy("criterion").agg(F.expr("count(*) AS n"))
    hit = types.select("content_type", F.explode("criteria").alias("criterion")).join(fails, "criterion", "left")
    totals = hit.groupBy("content_type").agg(F.expr("coalesce(sum(n), 0) AS failing"))
    return types.join(totals, "content_type").selectExpr(
        "content_type", "size(criteria) AS n_criteria", "automated", "assisted", "human", "failing"
    )


def structure_proposals(corpus: Corpus) -> DataFrame:
    """Five gap rules on the block tree: image text, headings, table headers, language, columns."""
    block = corpus.block
    cols = ["doc_id", "proposal_id", "category", "criterion", "element_id", "severity", "page", "auto_fixable"]
    images = block.filter(
        f"block_type = 'image' AND (coalesce(alt, '') = '' OR {text.q_like('alt', GENERIC_ALT)})"
    ).select("doc_id", "page_num", "seq", "image_id")
    unnamed = scan.running(
        images.filter("coalesce(image_id, '') = ''"), ["doc_id", "page_num"], ["seq"], {"i": scan.row_position()}
    ).selectExpr("doc_id", "page_num", "concat('img_p', page_num, '_i', i - 1) AS image_id")
    named = images.filter("coalesce(image_id, '') <> ''").select("doc_id", "page_num", "image_id")
    alt = named.unionByName(unnamed).selectExpr(
        "doc_id", "image_id AS proposal_id", "'alt_text' AS category", "'1.1.1' AS criterion", "image_id AS element_id",
        "'critical' AS severity", "page_num AS page", "true AS auto_fixable",
    )
    facts = checks.doc_facts(corpus, ["n_heading"])
    bare = facts.filter("n_heading = 0 AND page_count > 1").selectExpr(
        "doc_id", "'str_heading_hierarchy_0' AS proposal_id", "'heading_hierarchy' AS category", "'2.4.6' AS criterion",
        "'document-level' AS element_id", "'serious' AS severity", "1 AS page", "true AS auto_fixable",
    )
    levels = block.filter("block_type = 'heading'").selectExpr(
        "doc_id", "seq", "block_id", "page_num", "coalesce(level, 1) AS level")
    seen = scan.running(levels, ["doc_id"], ["seq"], {"prev_level": scan.previous(F.col("level"))})
    jumps = scan.running(
        seen.filter("prev_level > 0 AND level > prev_level + 1"), ["doc_id"], ["seq"], {"i": scan.row_position()}
    ).selectExpr(
        "doc_id", "concat('hdg_p', page_num, '_i', i - 1) AS proposal_id", "'heading_hierarchy' AS category",
        "'2.4.6' AS criterion", "block_id AS element_id", "'serious' AS severity", "page_num AS page",
        "true AS auto_fixable",
    )
    tables = scan.running(
        block.filter(f"block_type = 'table' AND {text.q_empty('headers')}").select(
            "doc_id", "page_num", "seq", "block_id", "rows"),
        ["doc_id", "page_num"], ["seq"], {"i": scan.row_position()},
    ).selectExpr(
        "doc_id", "concat('tbl_p', page_num, '_i', i - 1) AS proposal_id", "'table_structure' AS category",
        "'1.3.1' AS criterion", "block_id AS element_id",
        "CASE WHEN coalesce(size(rows), 0) > 20 THEN 'critical' ELSE 'serious' END AS severity", "page_num AS page",
        "coalesce(size(rows), 0) <= 20 AS auto_fixable",
    )
    language = corpus.doc.selectExpr(
        "doc_id", "'str_language_0' AS proposal_id", "'language' AS category", "'3.1.1' AS criterion",
        "'document-lang' AS element_id", "'moderate' AS severity", "1 AS page", "true AS auto_fixable",
    )
    columns = block.groupBy("doc_id", "page_num").agg(
        F.expr("count(*) AS n"), F.expr("size(collect_set(CASE WHEN x1 > 0 THEN bround(x1, -1) END)) AS n_x")
    ).filter("n >= 2 AND n_x >= 3")
    order = scan.running(columns, ["doc_id"], ["page_num"], {"i": scan.row_position()}).selectExpr(
        "doc_id", "concat('str_reading_order_', i - 1) AS proposal_id", "'reading_order' AS category",
        "'1.3.2' AS criterion", "concat('page-', page_num) AS element_id", "'moderate' AS severity", "page_num AS page",
        "true AS auto_fixable",
    )
    out = alt.select(*cols)
    for part in (bare, jumps, tables, language, order):
        out = out.unionByName(part.select(*cols))
    return out


# Fixed value: the placeholder written for figures without text.
GENERIC_ALT = r"^\[Figure on page .+ — alt text requires review\]$"


def corpus_statistics(score: DataFrame) -> DataFrame:
    """Run statistics over (filename, status, score, elapsed_s)."""
    return score.agg(
        F.expr("count(*) AS total"), F.expr("count_if(status = 'ok') AS ok"),
        F.expr("count_if(status = 'validation_error') AS validation_errors"),
        F.expr("count_if(status NOT IN ('ok', 'validation_error')) AS errors"),
        F.expr("coalesce(bround(count_if(status = 'ok') / nullif(count(*), 0), 4), 0.0D) AS pass_rate"),
        F.expr("coalesce(bround(count_if(score >= 0.9) / nullif(count(*), 0), 4), 0.0D) AS green_rate"),
        F.expr("bround(avg(score), 4) AS avg_score"),
        F.expr("coalesce(bround(avg(nullif(elapsed_s, 0.0D)), 3), 0.0D) AS avg_elapsed_s"),
    )


COLOUR = "CASE WHEN score IS NULL THEN 'UNKNOWN' WHEN score >= 0.9 THEN 'GREEN' WHEN score >= 0.7 THEN 'YELLOW' ELSE 'RED' END"


def colour_counts(score: DataFrame) -> DataFrame:
    """Counts of all four colours, zeros included."""
    counts = score.selectExpr(f"{COLOUR} AS colour").agg(
        *[F.expr(f"count_if(colour = '{c}') AS {c}") for c in ("GREEN", "YELLOW", "RED", "UNKNOWN")]
    )
    return counts.selectExpr("stack(4, 'GREEN', GREEN, 'YELLOW', YELLOW, 'RED', RED, 'UNKNOWN', UNKNOWN) AS (colour, n)")


def top_gaps(gap: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent gap kinds; ties by first appearance."""
    return (
        gap.groupBy("check_id").agg(F.expr("count(*) AS n"), F.expr("min(struct(doc_id, ord)) AS first_seen"))
        .orderBy(F.col("n").desc(), "first_seen").limit(k).select("check_id", "n")
    )


def regression_verdict(current: DataFrame, golden: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Average score and number of red documents against the golden run."""

    def totals(d: DataFrame, p: str) -> DataFrame:
        return d.agg(F.expr(f"avg(score) AS {p}_avg"), F.expr(f"count_if(score < 0.7) AS {p}_red"))

    both = totals(current, "cur").join(totals(golden, "gold"))
    return both.selectExpr(
        "bround(cur_avg, 4) AS cur_avg", "bround(gold_avg, 4) AS gold_avg", "cur_red", "gold_red",
        f"cur_avg >= gold_avg - {tolerance} AS score_ok", "cur_red <= gold_red AS red_ok",
    )


def facet_search(rows: DataFrame, facets: dict[str, str], term: str, columns: list[str]) -> DataFrame:
    """Equality facets and a case-insensitive search over several columns."""
    for name, value in facets.items():
        rows = rows.filter(F.col(name) == value)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(term.lower()), F.lit(False))
    return rows.filter(hit)


def review_needed(corpus: Corpus, gate_fails: DataFrame | None = None, low: float = 0.7) -> DataFrame:
    """Blocks and gate checks a person has to look at, by category."""
    heads = "block_type = 'heading' AND (level IS NULL OR NOT level BETWEEN 1 AND 6)"
    rules = [
        ("low_confidence_ocr", "serious", f"source = 'ocr' AND confidence < {low}"),
        ("complex_table", "serious", "block_type = 'table' AND exists(rows, r -> size(r) <> size(rows[0]))"),
        ("missing_alt_text", "critical", f"block_type = 'image' AND {text.q_blank('alt')}"),
        ("ambiguous_heading", "moderate", heads),
        ("form_field", "moderate", "block_type = 'form_field'"),
    ]
    rows = [f"CASE WHEN {w} THEN named_struct('category', '{c}', 'severity', '{s}') END" for c, s, w in rules]
    out = corpus.block.selectExpr("doc_id", "block_id", f"inline(array_compact(array({', '.join(rows)})))")
    if gate_fails is not None:
        browser = "startswith(check_name, 'axe_')"
        out = out.unionByName(gate_fails.filter("status = 'soft_fail'").selectExpr(
            "doc_id", "check_name AS block_id",
            f"CASE WHEN {browser} THEN 'browser_violation' ELSE 'gate_soft_fail' END AS category", "severity"))
    return out


def review_counts(items: DataFrame) -> DataFrame:
    """Counts by category and by severity in one pass."""
    return items.groupingSets([["category"], ["severity"]], "category", "severity").agg(F.expr("count(*) AS n"))
