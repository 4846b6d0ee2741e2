"""HTML tokens and quality checks over the page table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelight.operators import html_checks as H, reports
from pagelight.plans.registry import query
from pagelight.sources import html as X
from pagelight.sources import seeded

SQL_V = f"WITH {seeded.SQL_HTML}, " + r"""vis AS (SELECT doc_id, html, regexp_replace(html,
 '(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', '', 'g') AS v FROM html)"""


def _html(spark, sf_dir):
    return seeded.html_pages(spark, sf_dir)


_TOKEN = r""", tk0 AS (SELECT doc_id, regexp_extract_all(v, '(?s)<[^>]+>|[^<]+') AS ts FROM vis),
tk1 AS (SELECT doc_id, CAST(p AS INT) - 1 AS pos, ts[p] AS raw FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS p FROM tk0)),
tk AS (SELECT *, CASE WHEN starts_with(raw, '</') THEN 'close' WHEN starts_with(raw, '<!') THEN 'decl' WHEN starts_with(raw, '<')
 THEN 'open' ELSE 'text' END AS kind, lower(regexp_extract(raw, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM tk1),
dp AS (SELECT *, sum(CASE WHEN tag <> 'p' THEN 0 WHEN kind = 'open' THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END) OVER w AS in_p,
 sum(CASE WHEN tag <> 'table' THEN 0 WHEN kind = 'open' THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END) OVER w AS in_table,
 sum(CASE WHEN tag <> 'nav' THEN 0 WHEN kind = 'open' THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END) OVER w AS in_nav,
 count(*) FILTER (kind = 'open' AND tag = 'table') OVER w AS nth_table, count(*) FILTER (kind = 'open' AND tag = 'tr') OVER w AS nth_tr
 FROM tk WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""


@query("html_token_scan", SQL_V + _TOKEN + "SELECT doc_id, pos, kind, tag, in_p, in_table, in_nav FROM dp")
def html_token_scan(spark, sf_dir):
    return X.tokens(_html(spark, sf_dir)).select("doc_id", "pos", "kind", "tag", "in_p", "in_table", "in_nav")


@query("html_table_statistics", SQL_V + _TOKEN + """, tr AS (SELECT doc_id, nth_table, nth_tr, count(*) FILTER (tag IN ('td', 'th')) AS c,
  count(*) FILTER (tag = 'th') AS h, count(*) FILTER (tag = 'tr') AS r FROM dp WHERE in_table > 0 AND kind = 'open' GROUP BY ALL)
SELECT doc_id, nth_table, CAST(sum(r) AS BIGINT) AS n_rows, max(c) AS n_columns, CAST(sum(h) AS BIGINT) AS n_headers FROM tr GROUP BY ALL""")
def html_table_statistics(spark, sf_dir):
    return X.table_statistics(X.tokens(_html(spark, sf_dir)))


def _inner(tag):
    return rf"regexp_extract_all(v, '(?is)<{tag}\b[^>]*>(.*?)</{tag}>', 1)"


_PLAIN = "regexp_replace({}, '(?s)<[^>]+>', '', 'g')"
_W = r"""list_sum(list_transform(regexp_extract_all({r}, '(?is)<t[dh]\b[^>]*>'), lambda c: greatest(1, coalesce(try_cast(
 regexp_extract(c, 'colspan="([^"]*)"', 1) AS INT), 1))))"""
_HEAD = r"regexp_extract(t, '(?is)<thead\b[^>]*>.*?</thead>')"
_BODY = r"regexp_extract(t, '(?is)<tbody\b[^>]*>.*?</tbody>')"
_ROWS = r"regexp_extract_all({x}, '(?is)<tr\b[^>]*>.*?</tr>')"
_N_EMPTY = " + ".join(
    f"len(list_filter({_inner(t)}, lambda x: trim({_PLAIN.format('x')}) = '' AND NOT regexp_matches(x, '(?i)<(img|input)')))"
    for t in ("p", "td", "th"))
_N_EQ = " + ".join(f"len(list_filter({_inner(t)}, lambda x: regexp_matches({_PLAIN.format('x')}, '(?i)Equation\\s*\\[')))"
                   for t in ("p", "td", "th", "li", "span", "div", "caption"))
SQL_GAPS = SQL_V + rf""", pt AS (SELECT doc_id, v, regexp_extract(v, '(?i)<html\b[^>]*>') AS ht, {_PLAIN.format('v')} AS txt,
 regexp_extract_all(v, '(?is)<table\b[^>]*>.*?</table>') AS tabs, list_transform(regexp_extract_all(v, '(?i)<h([1-6])\b', 1), lambda x: CAST(x AS INT)) AS lv,
 len(list_filter(regexp_extract_all(v, '(?is)<img\b[^>]*>'), lambda x: NOT regexp_matches(x, '(?i)\salt(\s|=|>|/)'))) AS no_alt,
 regexp_matches(v, '(?i)<main\b') AS has_main, {_N_EMPTY} AS n_empty, {_N_EQ} AS n_eq,
 regexp_extract_all({_PLAIN.format('v')}, '(?i)(\$\d|\bfee\b|\bschedule\b|\brate\b|\btariff\b|\bassessment\b|\bcharge\b)') AS hints FROM vis),
pt1 AS (SELECT *, len(list_filter(range(2, len(lv) + 1), lambda i: lv[i] > lv[i - 1] + 1)) AS skips FROM pt),
tb AS (SELECT doc_id, tabs[i] AS t, CAST(i AS INT) AS no FROM (SELECT doc_id, tabs, unnest(range(1, len(tabs) + 1)) AS i FROM pt)),
tf AS (SELECT doc_id, no, regexp_matches(t, '(?i)<thead\b') AS hh, regexp_matches(t, '(?i)<tbody\b') AS hb,
 len(regexp_extract_all({_HEAD}, '(?is)<th\b[^>]*>')) AS n_th, len(list_filter(regexp_extract_all({_HEAD}, '(?is)<th\b[^>]*>'),
  lambda h: lower(regexp_extract(h, 'scope="([^"]*)"', 1)) = 'col')) AS n_col, {_W.format(r=_ROWS.format(x=_HEAD) + '[1]')} AS hw,
 list_transform({_ROWS.format(x=_BODY)}, lambda r: {_W.format(r='r')}) AS ws,
 len(list_filter({_ROWS.format(x=_BODY)}, lambda r: len(regexp_extract_all(r, '(?is)<td\b[^>]*>')) = 1 AND regexp_matches(
  {_PLAIN.format(r"regexp_extract(r, '(?is)<td\b[^>]*>(.*?)</td>', 1)")}, '(?i)^\s*\[|\[[\w\d]+\]|pursuant|equation|parcel|per unit|see note|footnote|endnote|ibid'))) AS notes FROM tb),
gap AS (SELECT doc_id, 'LANG_ATTRIBUTE' AS check_id, 'minor' AS severity, 'GREEN' AS classification, NULL AS issue, NULL AS table_no, 1 AS n, 0 AS o
  FROM pt1 WHERE trim(regexp_extract(ht, 'lang="([^"]*)"', 1)) = ''
 UNION ALL SELECT doc_id, 'TABLE_EXISTS', 'critical', 'RED', array_to_string(list_distinct2, ','), NULL, len(hints), 1 FROM (SELECT *,
  list_filter(list_transform(hints, lambda x: lower(x)), lambda x, i: list_position(list_transform(hints, lambda y: lower(y)), x) = i)[1:5] AS list_distinct2 FROM pt1) WHERE len(hints) > 0 AND len(tabs) = 0
 UNION ALL SELECT doc_id, 'TABLE_HEADERS', 'serious', 'GREEN', i, no, 1, 2 FROM (SELECT *, CASE WHEN NOT hh THEN 'missing_thead' WHEN n_th = 0
  THEN 'empty_thead' WHEN n_col = 0 THEN 'missing_scope_col' END AS i FROM tf) WHERE i IS NOT NULL
 UNION ALL SELECT doc_id, 'TABLE_STRUCTURE', 'moderate', 'GREEN', i, no, 1, 3 FROM (SELECT *, CASE WHEN NOT hb THEN CASE WHEN n_th > 0 THEN NULL
  ELSE 'missing_tbody' END WHEN len(ws) = 0 THEN 'empty_tbody' WHEN len(list_distinct(ws)) > 1 THEN 'inconsistent_col_counts' WHEN hw > 0 AND ws[1] <> hw
  THEN 'header_body_col_mismatch' END AS i FROM tf) WHERE i IS NOT NULL
 UNION ALL SELECT doc_id, 'FOOTNOTE_LEAK', 'moderate', 'GREEN', 'footnote_rows', no, notes, 4 FROM tf WHERE notes > 0
 UNION ALL SELECT doc_id, 'HEADING_HIERARCHY', 'moderate', 'YELLOW', NULL, NULL, skips, 5 FROM pt1 WHERE skips > 0
 UNION ALL SELECT doc_id, 'NO_EMPTY_ELEMENTS', 'minor', 'GREEN', NULL, NULL, n_empty, 6 FROM pt1 WHERE n_empty > 0
 UNION ALL SELECT doc_id, 'SEMANTIC_STRUCTURE', 'moderate', 'YELLOW', concat_ws('+', CASE WHEN NOT has_main THEN 'no_main' END,
  CASE WHEN len(lv) = 0 AND len(tabs) = 0 THEN 'no_structure' END), NULL, 1, 7 FROM pt1 WHERE NOT has_main OR (len(lv) = 0 AND len(tabs) = 0)
 UNION ALL SELECT doc_id, 'IMAGE_ALT_TEXT', 'serious', 'GREEN', NULL, NULL, no_alt, 8 FROM pt1 WHERE no_alt > 0
 UNION ALL SELECT doc_id, 'EQUATION_FILTER', 'minor', 'GREEN', NULL, NULL, n_eq, 9 FROM pt1 WHERE n_eq > 0),
sc AS (SELECT p.doc_id, count(DISTINCT check_id) AS failed, round_even((10 - count(DISTINCT check_id)) * 10.0, 2) AS score
 FROM pt1 p LEFT JOIN gap USING (doc_id) GROUP BY p.doc_id)
"""

CHECKS = {
    "html_lang_attribute": "LANG_ATTRIBUTE", "html_table_exists": "TABLE_EXISTS", "html_table_headers": "TABLE_HEADERS",
    "html_table_structure": "TABLE_STRUCTURE", "html_footnote_leak": "FOOTNOTE_LEAK",
    "html_heading_hierarchy": "HEADING_HIERARCHY", "html_no_empty_elements": "NO_EMPTY_ELEMENTS",
    "html_semantic_structure": "SEMANTIC_STRUCTURE", "html_image_alt_text": "IMAGE_ALT_TEXT",
    "html_equation_filter": "EQUATION_FILTER",
}


def _register(name: str, check: str) -> None:
    @query(name, SQL_GAPS + f"""SELECT doc_id, severity, classification, issue, table_no, n FROM gap WHERE check_id = '{check}'""")
    def plan(spark, sf_dir):
        return H.html_gaps(_html(spark, sf_dir), check).drop("ord", "check_id")


for _name, _check in CHECKS.items():
    _register(_name, _check)


@query("html_gaps", SQL_GAPS + "SELECT doc_id, check_id, severity, classification, issue, table_no, n FROM gap")
def html_gaps(spark, sf_dir):
    return H.html_gaps(_html(spark, sf_dir)).drop("ord")


@query("html_score", SQL_GAPS + "SELECT doc_id, failed, 10 - failed AS passed, score FROM sc")
def html_score(spark, sf_dir):
    return H.html_scores(_html(spark, sf_dir))


@query("gap_normalization", SQL_GAPS + """SELECT doc_id, coalesce(check_id, 'unknown') AS criterion, severity, CASE WHEN n > 1 THEN classification
 WHEN severity IN ('critical', 'serious') THEN 'RED' ELSE 'YELLOW' END AS classification, CASE WHEN score > 1 THEN score / 100.0 ELSE score END AS score
FROM gap JOIN sc USING (doc_id)""")
def gap_normalization(spark, sf_dir):
    gaps = H.html_gaps(_html(spark, sf_dir)).join(H.html_scores(_html(spark, sf_dir)).select("doc_id", "score"), "doc_id")
    return H.normalize_gaps(gaps.withColumn("criterion", F.lit(None).cast("string")).withColumn(
        "classification", F.expr("CASE WHEN n > 1 THEN classification END")))


@query("top_gap_types", SQL_GAPS + """SELECT check_id, count(*) AS n FROM gap GROUP BY 1 ORDER BY n DESC, min((doc_id, o)) LIMIT 10""")
def top_gap_types(spark, sf_dir):
    return reports.top_gaps(H.html_gaps(_html(spark, sf_dir)))


@query("red_items", SQL_GAPS + """SELECT doc_id, check_id, issue, table_no FROM gap WHERE classification = 'RED' OR severity IN ('critical', 'serious')""")
def red_items(spark, sf_dir):
    return H.html_gaps(_html(spark, sf_dir)).filter(
        "classification = 'RED' OR severity IN ('critical', 'serious')").select("doc_id", "check_id", "issue", "table_no")


@query("builder_score_and_block", SQL_V + rf""", b0 AS (SELECT doc_id, v, regexp_extract_all(v, '(?is)<img\b[^>]*>') AS imgs,
 regexp_extract_all(v, '(?is)<table\b[^>]*>.*?</table>') AS tabs, list_transform(regexp_extract_all(v, '(?i)<h([1-6])\b', 1), lambda x: CAST(x AS INT)) AS lv FROM vis),
b1 AS (SELECT doc_id, len(imgs) AS ni, len(tabs) AS nt, trim(regexp_extract(regexp_extract(v, '(?i)<html\b[^>]*>'), 'lang="([^"]*)"', 1)) <> '' AS hl,
 trim(regexp_extract(v, '(?is)<title[^>]*>(.*?)</title>', 1)) <> '' AS hti, len(list_filter(imgs, lambda x: trim(regexp_extract(x, 'alt="([^"]*)"', 1)) = '')) AS na,
 len(list_filter(imgs, lambda x: trim(regexp_extract(x, 'src="([^"]*)"', 1)) = '')) AS ns, len(list_filter(tabs, lambda t: NOT regexp_matches(t, '<th[^>]*scope="(col|row)"'))) AS nsc,
 len(list_filter(tabs, lambda t: NOT contains(t, '<caption'))) AS nc, len(list_filter(range(2, len(lv) + 1), lambda i: lv[i] > lv[i - 1] + 1)) AS sk,
 contains(v, 'href="#main-content"') AS hs, contains(v, '<main') AS hm FROM b0),
b2 AS (SELECT *, 6 + ni + (ni > 0)::INT + 2 * nt AS total, hl::INT + hti::INT + ni - na + (ni > 0 AND ns = 0)::INT + nt - nsc + (sk = 0)::INT + hs::INT + hm::INT + 1 + nt - nc AS passed,
 NOT hl OR NOT hti OR (ns > 0 AND ns > greatest(1.0, ni * 0.1)) AS crit, (ni > 0 AND na > ni / 2) OR nsc > 0 OR NOT hs AS ser FROM b1)
SELECT doc_id, total, passed, CASE WHEN total < 5 THEN 0.0 ELSE round_even(passed / total, 4) END AS score, crit OR ser AS blocked_publish, crit AS blocked_draft FROM b2""")
def builder_score_and_block(spark, sf_dir):
    return H.builder_validation(_html(spark, sf_dir))
