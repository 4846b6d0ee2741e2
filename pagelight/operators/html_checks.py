"""HTML quality checks as one narrow projection: a page is read once and never shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.functions.text import q, q_blank, q_like, q_strip
from pagelight.sources.html import all_of, attr, has_attr, visible

# Word lists of the checks.
TABLE_HINTS = r"(?i)(\$\d|\bfee\b|\bschedule\b|\brate\b|\btariff\b|\bassessment\b|\bcharge\b)"
FOOTNOTE_WORDS = r"(?i)(\[[\w\d]+\]|pursuant|equation|parcel|per unit|see note|footnote|endnote|ibid)"
EQUATION = r"(?i)Equation\s*\["
N_CHECKS = 10

_TAGS = r"(?s)<[^>]+>"


def _inner(tag: str) -> str:
    return all_of("v", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)


def _plain(x: str) -> str:
    return f"regexp_replace({x}, {q(_TAGS)}, '')"


def parts(html: DataFrame) -> DataFrame:
    """The fragments every check reads, taken once from each page."""
    seen = html.selectExpr("doc_id", "html", f"{visible()} AS v")
    cols = {
        "html_tag": "regexp_extract(v, r'(?i)<html\\b[^>]*>', 0)",
        "txt": _plain("v"),
        "tables": all_of("v", r"(?is)<table\b[^>]*>.*?</table>"),
        "imgs": all_of("v", r"(?is)<img\b[^>]*>"),
        "levels": f"transform({all_of('v', r'(?i)<h([1-6])\b', 1)}, x -> CAST(x AS INT))",
        "has_main": q_like("v", r"(?i)<main\b"),
        "n_empty": " + ".join(
            f"size(filter({_inner(t)}, x -> {q_blank(_plain('x'))} AND NOT {q_like('x', '(?i)<(img|input)')}))"
            for t in ("p", "td", "th")),
        "n_equation": " + ".join(
            f"size(filter({_inner(t)}, x -> {q_like(_plain('x'), EQUATION)}))"
            for t in ("p", "td", "th", "li", "span", "div", "caption")),
    }
    return seen.selectExpr("doc_id", "html", "v", *[f"{e} AS {n}" for n, e in cols.items()])


def _table_facts() -> str:
    """Per table: head and body presence, header cells, row widths, footnote rows."""
    width = (r"aggregate(regexp_extract_all({row}, r'(?is)<t[dh]\b[^>]*>', 0), 0, (a, c) -> a + greatest(1, "
             f"coalesce(try_cast({attr('c', 'colspan')} AS INT), 1)))")
    head = r"regexp_extract(t, r'(?is)<thead\b[^>]*>.*?</thead>', 0)"
    body = r"regexp_extract(t, r'(?is)<tbody\b[^>]*>.*?</tbody>', 0)"
    rows = "regexp_extract_all({x}, r'(?is)<tr\\b[^>]*>.*?</tr>', 0)"
    ths = rf"regexp_extract_all({head}, r'(?is)<th\b[^>]*>', 0)"
    body_rows, head_rows = rows.format(x=body), rows.format(x=head)
    cell = r"regexp_extract_all(r, r'(?is)<td\b[^>]*>(.*?)</td>', 1)"
    note = (f"size({cell}) = 1 AND ({_plain(f'{cell}[0]')} rlike r'^\\s*\\[' OR "
            f"{q_like(_plain(f'{cell}[0]'), FOOTNOTE_WORDS)})")
    return f"""transform(tables, (t, i) -> named_struct('no', i + 1, 'has_thead', t rlike r'(?i)<thead\\b',
     'has_tbody', t rlike r'(?i)<tbody\\b', 'n_th', size({ths}),
     'n_col_scope', size(filter({ths}, h -> lower(coalesce({attr('h', 'scope')}, '')) = 'col')),
     'head_width', CASE WHEN size({head_rows}) > 0 THEN {width.format(row=f'{head_rows}[0]')} END,
     'widths', transform({body_rows}, r -> {width.format(row='r')}),
     'n_notes', size(filter({body_rows}, r -> {note}))))"""


def _gap(check, severity, colour, when, issue="NULL", n="1", table="NULL") -> str:
    return (f"CASE WHEN {when} THEN named_struct('check_id', '{check}', 'severity', '{severity}', 'classification', "
            f"'{colour}', 'issue', CAST({issue} AS STRING), 'table_no', CAST({table} AS INT), 'n', CAST({n} AS INT)) END")


def _gaps(only: str | None = None) -> str:
    skips = ("size(filter(sequence(2, greatest(size(levels), 2)), i -> i <= size(levels) AND "
             "element_at(levels, i) > element_at(levels, i - 1) + 1))")
    lang = attr("html_tag", "lang")
    hints = all_of("txt", TABLE_HINTS)
    no_alt = f"size(filter(imgs, x -> NOT {has_attr('x', 'alt')}))"
    headers = "CASE WHEN NOT t.has_thead THEN 'missing_thead' WHEN t.n_th = 0 THEN 'empty_thead' WHEN t.n_col_scope = 0 THEN 'missing_scope_col' END"
    structure = """CASE WHEN NOT t.has_tbody THEN CASE WHEN t.n_th > 0 THEN NULL ELSE 'missing_tbody' END
     WHEN size(t.widths) = 0 THEN 'empty_tbody' WHEN size(array_distinct(t.widths)) > 1 THEN 'inconsistent_col_counts'
     WHEN t.head_width > 0 AND t.widths[0] <> t.head_width THEN 'header_body_col_mismatch' END"""
    page = [
        _gap("LANG_ATTRIBUTE", "minor", "GREEN", f"html_tag = '' OR {q_blank(lang)}"),
        _gap("TABLE_EXISTS", "critical", "RED", f"size({hints}) > 0 AND size(tables) = 0",
             f"array_join(slice(array_distinct(transform({hints}, x -> lower(x))), 1, 5), ',')", f"size({hints})"),
    ]
    per_table = [
        ("TABLE_HEADERS", "serious", headers, "1"), ("TABLE_STRUCTURE", "moderate", structure, "1"),
        ("FOOTNOTE_LEAK", "moderate", "CASE WHEN t.n_notes > 0 THEN 'footnote_rows' END", "t.n_notes"),
    ]
    tables = [
        f"transform(facts, t -> {_gap(c, s, 'GREEN', f'({e}) IS NOT NULL', e, n, 't.no')})" for c, s, e, n in per_table
    ]
    last = [
        _gap("HEADING_HIERARCHY", "moderate", "YELLOW", f"{skips} > 0", n=skips),
        _gap("NO_EMPTY_ELEMENTS", "minor", "GREEN", "n_empty > 0", n="n_empty"),
        _gap("SEMANTIC_STRUCTURE", "moderate", "YELLOW", "NOT has_main OR (size(levels) = 0 AND size(tables) = 0)",
             "concat_ws('+', CASE WHEN NOT has_main THEN 'no_main' END, CASE WHEN size(levels) = 0 AND size(tables) = 0 "
             "THEN 'no_structure' END)"),
        _gap("IMAGE_ALT_TEXT", "serious", "GREEN", f"{no_alt} > 0", n=no_alt),
        _gap("EQUATION_FILTER", "minor", "GREEN", "n_equation > 0", n="n_equation"),
    ]
    if only is not None:
        page, tables, last = ([x for x in xs if f"'{only}'" in x] for xs in (page, tables, last))
    lists = ([f"array({', '.join(page)})"] if page else []) + tables + ([f"array({', '.join(last)})"] if last else [])
    return f"array_compact(concat({', '.join(lists)}))"


def with_gaps(html: DataFrame, only: str | None = None) -> DataFrame:
    """(doc_id, gaps array), narrow."""
    return parts(html).withColumn("facts", F.expr(_table_facts())).selectExpr("doc_id", f"{_gaps(only)} AS gaps")


def html_gaps(html: DataFrame, only: str | None = None) -> DataFrame:
    """One row per gap, of all ten checks or of one."""
    fields = "check_id severity classification issue table_no n".split()
    numbered = "named_struct('ord', i, " + ", ".join(f"'{f}', g.{f}" for f in fields) + ")"
    # An outer generator over ready structs: the list is built once per page, not once per field.
    rows = with_gaps(html, only).selectExpr("doc_id", f"inline_outer(transform(gaps, (g, i) -> {numbered}))")
    return rows.filter("check_id IS NOT NULL")


def html_scores(html: DataFrame) -> DataFrame:
    """Share of the ten checks without a gap, in percent."""
    failed = "size(array_distinct(transform(gaps, g -> g.check_id)))"
    return with_gaps(html).selectExpr(
        "doc_id", f"{failed} AS failed", f"{N_CHECKS} - {failed} AS passed",
        f"bround(({N_CHECKS} - {failed}) * 100.0D / {N_CHECKS}, 2) AS score")


CRITERION_OF = {
    "LANG_ATTRIBUTE": "3.1.1", "TABLE_EXISTS": "1.3.1", "TABLE_HEADERS": "1.3.1", "TABLE_STRUCTURE": "1.3.1",
    "FOOTNOTE_LEAK": "1.3.1", "HEADING_HIERARCHY": "2.4.6", "NO_EMPTY_ELEMENTS": "4.1.1", "SEMANTIC_STRUCTURE": "1.3.1",
    "IMAGE_ALT_TEXT": "1.1.1", "EQUATION_FILTER": "1.3.1",
}


def normalize_gaps(gap: DataFrame) -> DataFrame:
    """Gaps of different producers in one form: check id as criterion, defaults for what is missing."""
    return gap.selectExpr(
        "doc_id", "coalesce(check_id, criterion, 'unknown') AS criterion", "coalesce(severity, 'unknown') AS severity",
        "coalesce(classification, CASE WHEN severity IN ('critical', 'serious') THEN 'RED' ELSE 'YELLOW' END) AS classification",
        "CASE WHEN score > 1 THEN score / 100.0D ELSE score END AS score",
    )


# Wording that marks a placeholder.
PLACEHOLDERS = (
    r"\[Figure on page \d+ — alt text requires review\]", r"\[This figure contains complex visual information that requires",
    r"alt text requires review", r"requires human review", r"Review and replace this placeholder",
)


def builder_validation(html: DataFrame) -> DataFrame:
    """Score and publication decision of a built page.

    Critical labels block always, serious labels block publication but not drafts;
    fewer than five checks score zero.
    """
    alt, src = attr("x", "alt"), attr("x", "src")
    hits = " + ".join(f"regexp_count(found, {q(p)})" for p in PLACEHOLDERS)
    header_cell = r"(?is)<th\b[^>]*>"
    facts = parts(html).selectExpr(
        "doc_id", "size(imgs) AS n_img", "size(tables) AS n_table", "levels", "has_main",
        f"html_tag <> '' AND NOT {q_blank(attr('html_tag', 'lang'))} AS has_lang",
        f"NOT {q_blank('regexp_extract(v, ' + q('(?is)<title[^>]*>(.*?)</title>') + ', 1)')} AS has_title",
        f"size(filter(imgs, x -> {q_blank(alt)})) AS no_alt", f"size(filter(imgs, x -> {q_blank(src)})) AS no_src",
        f"size(filter(tables, t -> NOT exists({all_of('t', header_cell)}, "
        f"h -> coalesce({attr('h', 'scope')}, '') IN ('col', 'row')))) AS no_scope",
        r"size(filter(tables, t -> NOT t rlike r'(?i)<caption\b')) AS no_caption",
        "size(filter(sequence(2, greatest(size(levels), 2)), i -> i <= size(levels) AND "
        "element_at(levels, i) > element_at(levels, i - 1) + 1)) AS n_skip",
        r"v rlike r'(?is)<a\b[^>]*\bhref=[\x22\x27]#main-content[\x22\x27]' AS has_skip",
        f"concat(txt, array_join(transform(imgs, x -> coalesce({alt}, '')), '\\n')) AS found",
    ).selectExpr("*", f"{hits} AS n_placeholder")
    scored = facts.selectExpr(
        "*",
        "6 + n_img + CASE WHEN n_img > 0 THEN 1 ELSE 0 END + 2 * n_table AS total",
        """CAST(has_lang AS INT) + CAST(has_title AS INT) + n_img - no_alt
         + CASE WHEN n_img > 0 AND no_src = 0 THEN 1 ELSE 0 END + n_table - no_scope
         + CASE WHEN n_skip = 0 THEN 1 ELSE 0 END + CAST(has_skip AS INT) + CAST(has_main AS INT)
         + CASE WHEN n_placeholder = 0 THEN 1 ELSE 0 END + n_table - no_caption AS passed""",
        """(NOT has_lang) OR (NOT has_title) OR (no_src > 0 AND no_src > greatest(1.0D, n_img * 0.1D)) AS critical""",
        "(n_img > 0 AND no_alt > n_img / 2) OR no_scope > 0 OR NOT has_skip AS serious",
    )
    return scored.selectExpr(
        "doc_id", "total", "passed", "CASE WHEN total < 5 THEN 0.0D ELSE bround(passed / total, 4) END AS score",
        "critical OR serious AS blocked_publish", "critical AS blocked_draft",
    )
