"""Validation gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.operators import gates as G
from pagelight.plans.registry import query
from pagelight.sources import seeded

SQL = seeded.SQL_CORPUS


def _row(gate, name, status, sev, pri, act, n, src, where):
    return (f"SELECT doc_id, '{gate}' AS gate_id, '{name}' AS check_name, '{status}' AS status, '{sev}' AS severity, '{pri}' AS priority, "
            f"'{act}' AS next_action, CAST({n} AS BIGINT) AS n FROM {src} WHERE {where}")


HARD, SOFT = ("hard_fail", "critical", "P0", "block"), ("soft_fail", "serious", "P1", "flag_hitl")
MODERATE, PASS = ("soft_fail", "moderate", "P1", "flag_hitl"), ("pass", "minor", "P2", "proceed")


def _either(gate, name, bad, v, n="0", when="true", src="gf"):
    return _row(gate, name, *v, n, src, f"({when}) AND ({bad})") + " UNION ALL " + _row(
        gate, name, *PASS, "0", src, f"({when}) AND NOT ({bad})")


_G1_FACTS = """, gp AS (SELECT p.doc_id, p.page_num, count(b.seq) AS nb, count(b.seq) FILTER (trim(b.content) <> '') AS nt FROM pages1 p
 LEFT JOIN block b ON b.doc_id = p.doc_id AND b.page_num = p.page_num GROUP BY ALL),
bx AS (SELECT doc_id, page_num, seq, x1, x2 FROM block WHERE NOT (x1 = 0 AND x2 = 0) AND x2 > x1),
mc AS (SELECT DISTINCT a.doc_id, a.page_num FROM bx a JOIN bx b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND a.seq < b.seq
 WHERE greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / least(a.x2 - a.x1, b.x2 - b.x1) <= 0.5),
gf AS (SELECT d.doc_id, coalesce(np, 0) AS np, coalesce(ne, 0) AS ne, coalesce(nb, 0) AS nb, coalesce(nt, 0) AS nt, coalesce(ntp, 0) AS ntp,
 coalesce(nm, 0) AS nm FROM doc d LEFT JOIN (SELECT doc_id, count(*) AS np, count(*) FILTER (nb = 0) AS ne, sum(nb) AS nb, sum(nt) AS nt,
 count(*) FILTER (nt > 0) AS ntp FROM gp GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS nm FROM mc GROUP BY 1) USING (doc_id))
"""
_G1_ROWS = {
    "gate_has_pages": ("has_pages", _either("G1", "has_pages", "np = 0", HARD)),
    "gate_non_empty_pages": ("non_empty_pages", _either("G1", "non_empty_pages", "ne > 0", SOFT, "ne", "np > 0")),
    "gate_has_text_content": ("has_text_content", _either("G1", "has_text_content", "nt = 0", HARD, "nb", "nb > 0")),
    "gate_text_coverage": ("text_coverage", _row("G1", "text_coverage", *SOFT, "ntp", "gf", "np > 0 AND ntp / np < 0.1")),
    "gate_multi_column_bbox": ("multi_column_bbox", _either("G1", "multi_column_bbox", "nm > 0", MODERATE, "nm")),
}
_G2_FACTS = """, gf AS (SELECT d.doc_id, coalesce(nr, 0) AS nr, coalesce(ny, 0) AS ny, coalesce(nz, 0) AS nz FROM doc d LEFT JOIN
 (SELECT doc_id, count(*) - count(DISTINCT block_id) AS nr, count(*) FILTER (block_type NOT IN ('heading', 'paragraph', 'table', 'image', 'list',
  'form_field')) AS ny, count(*) FILTER (block_id = '') AS nz FROM block GROUP BY 1) USING (doc_id))
"""
_G2_ROWS = {
    "gate_unique_block_ids": ("unique_block_ids", _either("G2", "unique_block_ids", "nr > 0", HARD, "nr")),
    "gate_valid_block_types": ("valid_block_types", _either("G2", "valid_block_types", "ny > 0", HARD, "ny")),
    "gate_non_empty_ids": ("non_empty_ids", _row("G2", "non_empty_ids", *HARD, "nz", "gf", "nz > 0")),
}


def _register(rows, facts, build):
    for name, (check, sql) in rows.items():
        def plan(spark, sf_dir, check=check):
            return build(seeded.corpus(spark, sf_dir), check).filter(F.col("check_name") == check)

        query(name, SQL + facts + sql)(plan)


_register(_G1_ROWS, _G1_FACTS, lambda corpus, check: G.g1(corpus, columns=check == "multi_column_bbox"))
_register(_G2_ROWS, _G2_FACTS, lambda corpus, check: G.g2(corpus))

_PO = """, po AS (SELECT doc_id, page_num + CASE WHEN doc_id % 6 = 1 AND page_num = 0 THEN 5 ELSE 0 END AS pn, page_num AS pos FROM pages1),
pb AS (SELECT *, lag(pn) OVER (PARTITION BY doc_id ORDER BY pos) AS pp FROM po),
gf AS (SELECT doc_id, count(*) FILTER (pn < pp) AS nk FROM pb GROUP BY 1)
"""


@query("gate_page_order", SQL + _PO + _either("G2", "page_order", "nk > 0", SOFT, "nk"))
def gate_page_order(spark, sf_dir):
    page = seeded.corpus(spark, sf_dir).page.selectExpr(
        "doc_id", "page_num AS pos", "page_num + CASE WHEN doc_id % 6 = 1 AND page_num = 0 THEN 5 ELSE 0 END AS page_num")
    return G.page_order_checks(page)


_G3_FACTS = f"WITH {seeded.SQL_HTML}" + r""", hf0 AS (SELECT doc_id, html, regexp_extract_all(html, '(?i)<img[^>]*>') AS imgs,
 regexp_extract_all(html, '(?is)<table\b[^>]*>.*?</table>') AS tabs, list_transform(regexp_extract_all(html, '(?i)<h([0-9])\b', 1), lambda x: CAST(x AS INT)) AS lv,
 regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1) AS ps FROM html),
pp AS (SELECT doc_id, i, length(trim(regexp_replace(ps[i], '(?s)<[^>]+>', '', 'g'))) < 60 AS s FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM hf0)),
pr AS (SELECT doc_id, s, i - row_number() OVER (PARTITION BY doc_id, s ORDER BY i) AS g FROM pp),
ru AS (SELECT doc_id, max(k) AS longest FROM (SELECT doc_id, g, count(*) AS k FROM pr WHERE s GROUP BY ALL) GROUP BY 1),
gf AS (SELECT h.doc_id, regexp_matches(html, '(?i)<html[^>]*\blang="([^"]+)"') AS hl, len(list_filter(imgs, lambda x: NOT regexp_matches(x, '(?i)\balt='))) AS na,
 len(list_filter(imgs, lambda x: NOT regexp_matches(x, '(?i)\bsrc='))) + len(list_filter(imgs, lambda x: regexp_matches(x, '(?i)\bsrc\s*=\s*(?:""|'''')'))) AS ns,
 len(tabs) AS nt, len(list_filter(tabs, lambda t: NOT regexp_matches(t, '(?i)<th[^>]*\bscope=["''](?:col|row)["'']'))) AS nsc, len(lv) AS nh,
 len(list_filter(range(2, len(lv) + 1), lambda i: lv[i] > lv[i - 1] + 1)) AS nk, len(ps) AS np, contains(lower(html), '<main') AS hm, coalesce(longest, 0) AS lr
 FROM hf0 h LEFT JOIN ru USING (doc_id))
"""
_G3_ROWS = {
    "gate_html_lang": ("html_lang", _either("G3", "html_lang", "NOT hl", HARD)),
    "gate_img_alt": ("img_alt", _row("G3", "img_alt", *HARD, "na", "gf", "na > 0")),
    "gate_img_src": ("img_src", _row("G3", "img_src", *HARD, "ns", "gf", "ns > 0")),
    "gate_table_headers": ("table_headers", _either("G3", "table_headers", "nsc > 0", ("hard_fail", "serious", "P1", "flag_hitl"), "nsc", "nt > 0")),
    "gate_content_no_headings": ("content_no_headings", _row("G3", "content_no_headings", *HARD, "np", "gf", "nh = 0 AND np > 5")),
    "gate_heading_hierarchy": ("heading_hierarchy", _row("G3", "heading_hierarchy", *MODERATE, "nk", "gf", "nk > 0")),
    "gate_main_landmark": ("main_landmark", _either("G3", "main_landmark", "NOT hm", MODERATE)),
    "gate_multi_column_reading_order": ("multi_column_reading_order", _row("G3", "multi_column_reading_order", *MODERATE, "lr", "gf", "lr >= 5")),
}
for _name, (_check, _sql) in _G3_ROWS.items():
    def _plan(spark, sf_dir, check=_check):
        return G.g3_structural(seeded.html_pages(spark, sf_dir)).filter(F.col("check_name") == check)

    query(_name, _G3_FACTS + _sql)(_plan)

_IMPACT = "CASE (doc_id + k) % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'serious' WHEN 2 THEN 'moderate' WHEN 3 THEN 'minor' END"
_AXE = f"""ax AS (SELECT page_id AS doc_id, CAST(k AS INT) AS k FROM pages, range(0, 3) t(k) WHERE k < page_id % 4),
axc AS (SELECT doc_id, 'G3' AS gate_id, 'axe_rule' || k AS check_name, CASE WHEN i IN ('critical', 'serious') THEN 'hard_fail' ELSE 'soft_fail' END AS status,
 CASE WHEN i IN ('critical', 'serious', 'moderate') THEN i ELSE 'minor' END AS severity, CASE WHEN i IN ('critical', 'serious') THEN 'P0' ELSE 'P1' END AS priority,
 CASE WHEN i IN ('critical', 'serious') THEN 'block' ELSE 'flag_hitl' END AS next_action, CAST(1 AS BIGINT) AS n FROM (SELECT *, {_IMPACT} AS i FROM ax)
 UNION ALL SELECT page_id, 'G3', 'axe_clean', 'pass', 'minor', 'P2', 'proceed', 1 FROM pages WHERE page_id % 4 = 0)"""


def _axe(spark, sf_dir, id_prefix="rule"):
    return seeded.read_table(spark, sf_dir, "pages").selectExpr(
        "page_id AS doc_id", "CAST(page_id % 4 AS INT) AS m").selectExpr(
        "doc_id", f"""filter(transform(sequence(0, 2), k -> named_struct('k', k, 'id', concat('{id_prefix}', k), 'impact', {_IMPACT})),
         s -> s.k < m) AS violations""")


@query("gate_browser_rule_severity", f"WITH {_AXE} SELECT * FROM axc")
def gate_browser_rule_severity(spark, sf_dir):
    return G.severity_checks(_axe(spark, sf_dir), "G3", "axe_", "axe_clean")


_DOWN = """SELECT doc_id, gate_id, check_name, CASE WHEN status = 'hard_fail' AND starts_with(check_name, 'axe_') THEN 'soft_fail' ELSE status END AS status, severity,
 CASE WHEN status = 'hard_fail' AND starts_with(check_name, 'axe_') THEN 'P1' ELSE priority END AS priority,
 CASE WHEN status = 'hard_fail' AND starts_with(check_name, 'axe_') THEN 'flag_hitl' ELSE next_action END AS next_action, n"""


@query("gate_draft_downgrade", _G3_FACTS.replace("WITH ", f"WITH {_AXE}, ", 1) + f"{_DOWN} FROM (SELECT * FROM axc UNION ALL SELECT * FROM ({_G3_ROWS['gate_html_lang'][1]}))")
def gate_draft_downgrade(spark, sf_dir):
    lang = G.g3_structural(seeded.html_pages(spark, sf_dir)).filter("check_name = 'html_lang'")
    return G.draft_downgrade(gate_browser_rule_severity(spark, sf_dir).unionByName(lang))


_CATALOG = ["o_orderkey AS doc_id", "CAST(o_orderkey % 5 AS INT) AS pages", "CAST(o_orderkey % 1000 AS INT) AS n_bytes", "o_orderkey % 3 <> 0 AS struct_tree",
            "o_orderkey % 4 <> 1 AS mark_info", "CASE WHEN o_orderkey % 7 <> 2 THEN o_orderkey % 2 = 0 END AS marked",
            "CASE WHEN o_orderkey % 6 <> 5 THEN 'en' END AS lang", "o_orderkey % 9 <> 8 AS validator"]
_CAT = "gf AS (SELECT " + ", ".join(_CATALOG) + " FROM orders)"
_CAT_ROWS = " UNION ALL ".join([
    _either("G4", "pdf_has_pages", "pages = 0", HARD), _row("G4", "pdf_size", *HARD, "n_bytes", "gf", "n_bytes < 100"),
    _either("G4", "pdf_struct_tree_root", "NOT struct_tree", HARD, when="validator"),
    _either("G4", "pdf_mark_info", "NOT (mark_info AND coalesce(marked, false))", SOFT, when="validator"),
    _either("G4", "pdf_lang", "lang IS NULL", HARD, when="validator"), _row("G4", "pdf_no_validator", *HARD, "0", "gf", "NOT validator")])


def _catalog(spark, sf_dir):
    return seeded.read_table(spark, sf_dir, "orders").selectExpr(*_CATALOG)


@query("gate_pdf_catalog_facts", f"WITH {_CAT} {_CAT_ROWS}")
def gate_pdf_catalog_facts(spark, sf_dir):
    return G.g4_catalog(_catalog(spark, sf_dir))


_VAL = """va AS (SELECT o_orderkey AS doc_id, o_orderkey % 8 <> 0 AS available, o_orderkey % 3 = 0 AS compliant, o_orderkey % 11 AS error_count,
 CASE o_orderkey % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['7.1'] ELSE ['7.1', '7.18.1'] END AS clauses FROM orders),
ba AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 7 END AS before FROM orders),
gf AS (SELECT va.*, before FROM va LEFT JOIN ba USING (doc_id))"""
_FAIL = ("soft_fail", "serious", "P1", "flag_hitl")
_CLAUSES = " UNION ALL ".join([
    _row(G.PDFUA, "verapdf_available", *MODERATE, "0", "gf", "NOT available"),
    _either(G.PDFUA, "pdfua1_compliance", "NOT compliant", _FAIL, "error_count", "available"),
    _either(G.PDFUA, "verapdf_delta", "error_count > before", _FAIL, "before - error_count", "available AND before IS NOT NULL"),
    f"SELECT doc_id, '{G.PDFUA}', 'clause_' || unnest(clauses), 'soft_fail', 'serious', 'P1', 'flag_hitl', 1 FROM va WHERE available"])


def _validation(spark, sf_dir):
    orders = seeded.read_table(spark, sf_dir, "orders")
    now = orders.selectExpr(
        "o_orderkey AS doc_id", "o_orderkey % 8 <> 0 AS available", "o_orderkey % 3 = 0 AS compliant", "o_orderkey % 11 AS error_count",
        "CASE o_orderkey % 3 WHEN 0 THEN CAST(array() AS array<string>) WHEN 1 THEN array('7.1') ELSE array('7.1', '7.18.1') END AS clauses")
    before = orders.selectExpr("o_orderkey AS doc_id", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 7 END AS error_count")
    return now, before


@query("gate_pdfua_clauses", f"WITH {_VAL} {_CLAUSES}")
def gate_pdfua_clauses(spark, sf_dir):
    return G.clause_gate(*_validation(spark, sf_dir))


@query("validation_delta_join", f"""WITH {_VAL} SELECT doc_id, before, error_count AS after, before - error_count AS delta, error_count <= before AS improved
 FROM va JOIN ba USING (doc_id)""")
def validation_delta_join(spark, sf_dir):
    now, before = _validation(spark, sf_dir)
    return G.validation_delta(before, now)


_ISS = """isx AS (SELECT p_partkey AS doc_id, p_partkey % 5 <> 4 AS available, CAST(k AS INT) AS k, p_partkey % 4 AS m FROM part, range(0, 3) t(k)),
iss AS (SELECT doc_id, 'G4' AS gate_id, 'adobe_' || 'tag' || k AS check_name, CASE WHEN i IN ('critical', 'serious') THEN 'hard_fail' ELSE 'soft_fail' END AS status,
 CASE WHEN i IN ('critical', 'serious', 'moderate') THEN i ELSE 'minor' END AS severity, CASE WHEN i IN ('critical', 'serious') THEN 'P0' ELSE 'P1' END AS priority,
 CASE WHEN i IN ('critical', 'serious') THEN 'block' ELSE 'flag_hitl' END AS next_action, CAST(1 AS BIGINT) AS n FROM (SELECT *, """ + _IMPACT + """ AS i FROM isx) WHERE available AND k < m
 UNION ALL SELECT p_partkey, 'G4', 'adobe_checker_pass', 'pass', 'minor', 'P2', 'proceed', 1 FROM part WHERE p_partkey % 5 <> 4 AND p_partkey % 4 = 0
 UNION ALL SELECT p_partkey, 'G4', 'adobe_checker_unavailable', 'soft_fail', 'serious', 'P1', 'flag_hitl', 0 FROM part WHERE p_partkey % 5 = 4)"""


def _issues(spark, sf_dir):
    return seeded.read_table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS doc_id", "p_partkey % 5 <> 4 AS available", "CAST(p_partkey % 4 AS INT) AS m").selectExpr(
        "doc_id", "available", f"""filter(transform(sequence(0, 2), k -> named_struct('k', k, 'id', concat('tag', k), 'impact', {_IMPACT})),
         s -> s.k < m) AS violations""")


@query("gate_checker_issues", f"WITH {_ISS} SELECT * FROM iss")
def gate_checker_issues(spark, sf_dir):
    return G.checker_gate(_issues(spark, sf_dir))


@query("gate_checker_fallback", f"WITH {_ISS}, {_CAT} SELECT * FROM iss UNION ALL SELECT * FROM ({_CAT_ROWS}) WHERE doc_id IN (SELECT doc_id FROM iss WHERE check_name = 'adobe_checker_unavailable')")
def gate_checker_fallback(spark, sf_dir):
    return G.with_fallback(gate_checker_issues(spark, sf_dir), G.g4_catalog(_catalog(spark, sf_dir)))


def _union(rows, facts: str) -> str:
    """Checks of several names over the facts of one gate."""
    return " UNION ALL ".join(sql.replace(" FROM gf WHERE", f" FROM {facts} WHERE") for sql in rows)


#: Every gate over one set of documents: a document has its blocks, its page, its reports and its catalog under one id.
ALL_SQL = (
    SQL + _G1_FACTS.replace("gf AS", "gf1 AS", 1) + _G2_FACTS.replace("gf AS", "gf2 AS", 1)
    + _PO.replace("gf AS", "gf2o AS", 1) + ", " + _G3_FACTS.removeprefix("WITH ").replace("gf AS", "gf3 AS", 1)
    + f""", {_AXE}, {_ISS}, {_CAT.replace("gf AS", "gf4 AS", 1)}, {_VAL},
ck AS (""" + " UNION ALL ".join([
        _union([sql for _, sql in _G1_ROWS.values()], "gf1"), _union([sql for _, sql in _G2_ROWS.values()], "gf2"),
        _union([_either("G2", "page_order", "nk > 0", SOFT, "nk")], "gf2o"), _union([sql for _, sql in _G3_ROWS.values()], "gf3"),
        "SELECT * FROM axc", "SELECT * FROM iss",
        f"SELECT * FROM ({_union([_CAT_ROWS], 'gf4')}) WHERE doc_id IN (SELECT doc_id FROM iss WHERE check_name = 'adobe_checker_unavailable')",
        _CLAUSES]) + ")")


def all_checks(spark, sf_dir) -> DataFrame:
    corpus = seeded.corpus(spark, sf_dir)
    return reduce(DataFrame.unionByName, [
        G.structure_checks(corpus), gate_page_order(spark, sf_dir),
        G.g3_structural(seeded.html_pages(spark, sf_dir)), gate_browser_rule_severity(spark, sf_dir),
        gate_checker_fallback(spark, sf_dir), gate_pdfua_clauses(spark, sf_dir)])


@query("gate_rollup", ALL_SQL + f""" SELECT doc_id, gate_id, CASE WHEN gate_id = '{G.PDFUA}' THEN bool_and(status = 'pass') ELSE bool_and(status <> 'hard_fail') END AS passed
 FROM ck GROUP BY doc_id, gate_id""")
def gate_rollup(spark, sf_dir):
    return G.gate_rollup(all_checks(spark, sf_dir))


_SUMMARY = """, sm AS (SELECT doc_id, count(*) AS total_checks, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'soft_fail') AS soft_fails,
 count(*) FILTER (status = 'hard_fail') AS hard_fails, count(*) FILTER (priority = 'P0' AND status <> 'pass') AS p0_count,
 count(*) FILTER (priority = 'P1' AND status <> 'pass') AS p1_count, count(*) FILTER (priority = 'P2' AND status <> 'pass') AS p2_count FROM ck GROUP BY doc_id),
sm1 AS (SELECT *, CASE WHEN p0_count > 0 THEN 'block' WHEN p1_count > 0 THEN 'flag_hitl' ELSE 'proceed' END AS decision, CASE WHEN hard_fails > 0 THEN 'fail' ELSE 'pass' END AS overall FROM sm)"""


@query("ledger_summary", ALL_SQL + _SUMMARY + " SELECT * FROM sm1")
def ledger_summary(spark, sf_dir):
    return G.ledger_summary(all_checks(spark, sf_dir))


@query("publishable_verdict", ALL_SQL + f""", pv AS (SELECT doc_id, bool_or(check_name = 'adobe_checker_pass' AND status = 'pass') AS ok,
 list_sort(list(DISTINCT check_name) FILTER (priority = 'P0' AND status <> 'pass')) AS n0, count(*) FILTER (priority = 'P0' AND status <> 'pass') AS p0,
 list_sort(list(DISTINCT check_name) FILTER (priority = 'P1' AND status <> 'pass')) AS na, count(*) FILTER (priority = 'P1' AND status <> 'pass') AS pa,
 list_sort(list(DISTINCT check_name) FILTER (priority = 'P1' AND status <> 'pass' AND check_name <> 'verapdf_available')) AS nb,
 count(*) FILTER (priority = 'P1' AND status <> 'pass' AND check_name <> 'verapdf_available') AS pb FROM ck GROUP BY doc_id),
pw AS (SELECT *, CASE WHEN ok THEN pb ELSE pa END AS p1, CASE WHEN ok THEN nb ELSE na END AS n1 FROM pv)
SELECT doc_id, p0 = 0 AND p1 = 0 AS publishable, CASE WHEN p0 > 0 THEN concat('Document blocked by ', p0, ' P0 issue(s): ', array_to_string(n0, ', '))
 WHEN p1 > 0 THEN concat('Document has ', p1, ' P1 issue(s) requiring HITL sign-off: ', array_to_string(n1, ', '))
 ELSE 'No P0 or P1 issues — document is publishable' END AS reason FROM pw""")
def publishable_verdict(spark, sf_dir):
    return G.publishable(all_checks(spark, sf_dir))


@query("validation_ledger", ALL_SQL + _SUMMARY + """, gl AS (SELECT doc_id, gate_id, count(*) AS n_check, bool_and(status <> 'hard_fail') AS passed FROM ck GROUP BY ALL)
SELECT doc_id, string_agg(concat(gate_id, ':', n_check, ':', passed), ',' ORDER BY gate_id) AS gates, first(decision) AS decision, first(overall) AS overall
FROM gl JOIN sm1 s USING (doc_id) GROUP BY doc_id""".replace("FROM gl JOIN sm1 s", "FROM gl JOIN (SELECT doc_id, decision, overall FROM sm1) s"))
def validation_ledger(spark, sf_dir):
    # The documents of the ledger from the keys of what the gates check, not from a second run of the checks.
    keys = (("documents", "doc_id"), ("pages", "page_id"), ("part", "p_partkey"), ("orders", "o_orderkey"))
    ids = reduce(DataFrame.union, [seeded.read_table(spark, sf_dir, t).select(F.col(k).cast("bigint").alias("doc_id")) for t, k in keys])
    doc = ids.distinct().withColumn("filename", F.concat(F.lit("f"), "doc_id"))
    return G.ledger(all_checks(spark, sf_dir), doc).selectExpr(
        "doc_id", "array_join(transform(gates, g -> concat(g.gate_id, ':', size(g.checks), ':', g.passed)), ',') AS gates",
        "summary.decision AS decision", "summary.overall AS overall")
