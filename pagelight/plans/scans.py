"""Report scans, envelopes, files, names and colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelight.operators import html_checks as H, ordered
from pagelight.plans.html import SQL_GAPS
from pagelight.plans.registry import query
from pagelight.sources import reports as S, seeded, sinks

_RULES = """CASE WHEN o_orderkey % 4 = 0 THEN '[]' ELSE concat('[{"ruleId":"R1","clause":"7.1","status":"failed","failedChecks":', o_orderkey % 5, '},{"ruleId":{"id":"R2"},"clause":"7.18.1","status":"',
 CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'passed' END, '","failedChecks":', CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END, '},{"ruleId":"R3","specification":"ISO","status":"failed","failedChecks":', o_orderkey % 2, '}]') END"""
_BODY = f"""CASE o_orderkey % 3 WHEN 0 THEN concat('{{"compliant":', CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END, ',"ruleSummaries":', {_RULES}, '}}')
 WHEN 1 THEN concat('{{"report":{{"jobs":[{{"validationResult":{{"compliant":', CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END, ',"details":{{"rules":', {_RULES}, '}}}}}}]}}}}')
 ELSE concat('{{"report":{{"batchSummary":{{"validationReports":{{"compliant":', o_orderkey % 2, ',"nonCompliant":', o_orderkey % 6, '}}}}}}}}') END"""


@query("validator_report_scan_pdfua", """WITH b AS (SELECT o_orderkey AS doc_id, o_orderkey AS k, o_orderkey % 3 AS shape, o_orderkey % 4 = 0 AS bare FROM orders),
r AS (SELECT *, CASE WHEN shape = 2 OR bare THEN 0 ELSE 3 END AS checked, shape < 2 AND NOT bare AND (shape = 1 OR k % 5 > 0) AS f1, shape < 2 AND NOT bare AND k % 3 = 0 AS f2,
 shape < 2 AND NOT bare AND (shape = 1 OR k % 2 > 0) AS f3 FROM b)
SELECT doc_id, CASE shape WHEN 2 THEN k % 2 > 0 ELSE k % 2 = 0 END AS compliant, CASE WHEN shape = 2 THEN k % 6 ELSE CASE WHEN f1 THEN k % 5 ELSE 0 END + CASE WHEN f2 THEN 2 ELSE 0 END
 + CASE WHEN f3 THEN k % 2 ELSE 0 END END AS error_count, array_to_string(list_filter([CASE WHEN f2 THEN '7.18.1' END, CASE WHEN f1 THEN '7.1' END, CASE WHEN f3 THEN 'ISO' END], lambda x: x IS NOT NULL).list_sort(), ',') AS clauses,
 checked, checked - (f1::INT + f2::INT + f3::INT) AS passed FROM r""")
def validator_report_scan_pdfua(spark, sf_dir):
    body = seeded.read_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"{_BODY} AS body")
    return S.scan_pdfua(body).selectExpr("doc_id", "compliant", "error_count", "array_join(clauses, ',') AS clauses", "checked", "passed")


@query("validator_report_scan_browser", """WITH b AS (SELECT p_partkey AS doc_id, p_partkey % 4 AS v, p_partkey % 6 AS p, p_partkey % 3 AS i FROM part)
SELECT doc_id, v AS n_violations, p AS passes, CASE WHEN v + p + i > 0 THEN round_even(p / (v + p + i), 4) ELSE 1.0 END AS score, CASE WHEN v > 0 THEN 'minor' END AS first_impact FROM b""")
def validator_report_scan_browser(spark, sf_dir):
    body = seeded.read_table(spark, sf_dir, "part").selectExpr("p_partkey AS doc_id", """concat('{"violations":[', array_join(transform(filter(sequence(1, 4), x -> x <= p_partkey % 4), x -> concat('{"id":"v', x, '","tags":["a"],"nodes":["n"]}')), ','),
     '],"passes":[', array_join(transform(filter(sequence(1, 6), x -> x <= p_partkey % 6), x -> '"p"'), ','), '],"incomplete":[', array_join(transform(filter(sequence(1, 3), x -> x <= p_partkey % 3), x -> '"i"'), ','), ']}') AS body""")
    return S.scan_browser_rules(body).selectExpr("doc_id", "size(violations) AS n_violations", "passes", "score", "try_element_at(violations, 1).impact AS first_impact")


_MH = """CASE (p_partkey + x) % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN 'fail' WHEN 2 THEN 'skip' WHEN 3 THEN 'odd' ELSE 'Pass' END"""


@query("validator_report_scan_matterhorn", f"""WITH m AS (SELECT p_partkey, lower({_MH}) AS s FROM part, range(1, 5) t(x))
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 4 = 0 THEN false ELSE count(*) FILTER (s = 'fail') = 0 END AS compliant, count(*) FILTER (s = 'pass') AS passed, count(*) FILTER (s = 'fail') AS failed, count(*) FILTER (s = 'skip') AS na,
 count(*) FILTER (s <> 'odd') AS total FROM m GROUP BY 1""")
def validator_report_scan_matterhorn(spark, sf_dir):
    body = seeded.read_table(spark, sf_dir, "part").selectExpr("p_partkey AS doc_id", f"""concat('{{"', CASE p_partkey % 3 WHEN 0 THEN 'checks' WHEN 1 THEN 'rules' ELSE 'results' END, '":[',
     array_join(transform(sequence(1, 4), x -> concat('{{"id":"c', x, '","', CASE WHEN p_partkey % 2 = 0 THEN 'status' ELSE 'result' END, '":"', {_MH}, '"}}')), ','), ']', CASE WHEN p_partkey % 4 = 0 THEN ',"is_compliant":false' ELSE '' END, '}}') AS body""")
    return S.scan_matterhorn(body)[0]


@query("checker_issue_scan", """SELECT l_orderkey AS doc_id, l_linenumber AS n, CASE WHEN l_returnflag = 'A' THEN 'critical' WHEN l_returnflag = 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'serious' ELSE 'moderate' END ELSE 'minor' END AS severity FROM lineitem""")
def checker_issue_scan(spark, sf_dir):
    raw = seeded.read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS n",
        "CASE WHEN l_returnflag = 'A' THEN 'Critical issue' WHEN l_returnflag = 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'ERROR' ELSE 'Warning' END ELSE 'info' END AS raw_severity")
    return S.scan_checker_issues(raw, raw.select("doc_id").distinct())[0].select("doc_id", "n", "severity")


@query("checker_issue_score", """SELECT c_custkey AS doc_id, count(o_orderkey) AS n, round_even(1.0 - count(o_orderkey) / greatest(count(o_orderkey) + 10, 10), 4) AS score
 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def checker_issue_score(spark, sf_dir):
    """Customers stand for documents: some of them have no order."""
    raw = seeded.read_table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc_id", "o_orderpriority AS raw_severity")
    return S.scan_checker_issues(raw, seeded.read_table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id"))[1]


def _cell(start: str, end: str) -> str:
    return f"named_struct('segments', array(named_struct('start', cast(least(n, {start}) AS int), 'end', cast(least(n, {end}) AS int))))"


@query("ocr_layout_scan", """WITH d AS (SELECT doc_id, replace(replace(text, chr(10), ' '), chr(9), ' ') AS ftxt FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, 'paragraph' AS block_type, k AS ord, trim(substr(ftxt, k * 200 + 1, 200)) AS content, '' AS headers, '' AS rows FROM (SELECT *, unnest(range(0, (length(ftxt) + 199) // 200)) AS k FROM d)),
t AS (SELECT doc_id, 'table', 0, '', trim(substr(ftxt, 1, 15)) || '|' || trim(substr(ftxt, 16, 25)),
 array_to_string(list_transform(range(0, (greatest(length(ftxt) - 40, 0) + 99) // 100 * 2), lambda r: trim(substr(ftxt, 41 + 50 * r, 50))), '|') FROM d WHERE doc_id % 2 = 0)
SELECT * FROM p WHERE content <> '' UNION ALL SELECT * FROM t""")
def ocr_layout_scan(spark, sf_dir):
    """Paragraphs of 200 characters in two segments and, of even documents, tables with rows of two cells: the last of each takes the rest."""
    docs = seeded.read_table(spark, sf_dir, "documents").selectExpr("doc_id", "replace(replace(text, '\\n', ' '), '\\t', ' ') AS full").filter(
        "full IS NOT NULL").selectExpr("*", "char_length(full) AS n")
    segment = "named_struct('start', cast({} AS int), 'end', cast(least(n, {}) AS int))"
    paras = f"""transform(sequence(0, greatest((n + 199) DIV 200 - 1, 0)), k -> named_struct('segments', array(
     {segment.format("CASE WHEN k > 0 THEN k * 200 END", "k * 200 + 120")}, {segment.format("least(n, k * 200 + 120)", "k * 200 + 200")})))"""
    heads = f"array(named_struct('cells', array({_cell('0', '3')})), named_struct('cells', array({_cell('0', '15')}, {_cell('15', '40')})))"
    rows = f"""transform(filter(sequence(0, n DIV 100), r -> 40 + r * 100 < n), r -> named_struct('cells', array(
     {_cell('40 + r * 100', '90 + r * 100')}, {_cell('90 + r * 100', '140 + r * 100')})))"""
    tables = f"""filter(array(named_struct('headerRows', {heads}, 'bodyRows', {rows}), named_struct('headerRows', filter({heads}, x -> false), 'bodyRows', filter({rows}, x -> false))),
     t -> doc_id % 2 = 0)"""
    body = docs.selectExpr("doc_id", f"to_json(named_struct('text', full, 'pages', array(named_struct('paragraphs', {paras}, 'tables', {tables})))) AS body")
    return S.scan_ocr(body).selectExpr("doc_id", "block_type", "ord", "content", "array_join(headers, '|') AS headers", "array_join(flatten(rows), '|') AS rows")


_ENV = """CASE event_id % 7 WHEN 0 THEN '{"other":1}' WHEN 1 THEN '{"message":{}}' WHEN 2 THEN '{"message":{"data":"***"}}' WHEN 3 THEN concat('{"message":{"data":"', base64(encode(concat('not json ', event_id), 'UTF-8')), '"}}')
 ELSE concat('{"message":{"data":"', base64(encode(props, 'UTF-8')), '"}}') END"""


def _envelopes(spark, sf_dir):
    return S.decode_envelopes(seeded.read_table(spark, sf_dir, "events").selectExpr("event_id", f"{_ENV} AS body"))


@query("event_envelope_decode", "SELECT event_id, props AS payload FROM events WHERE event_id % 7 > 3")
def event_envelope_decode(spark, sf_dir):
    return _envelopes(spark, sf_dir)[0]


@query("event_envelope_rejects", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'no_message' WHEN 1 THEN 'no_data' WHEN 2 THEN 'not_base64' ELSE 'not_json' END AS reason FROM events WHERE event_id % 7 <= 3")
def event_envelope_rejects(spark, sf_dir):
    return _envelopes(spark, sf_dir)[1]


@query("file_gate", """WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '%PDF-1.7 ' || html WHEN 1 THEN '' WHEN 2 THEN repeat('x', 1100) || '%PDF' ELSE 'junk %PDF ' || html END AS c FROM pages)
SELECT 'p' || page_id AS path, strlen(c) AS n_bytes, CASE WHEN c = '' THEN 'empty' WHEN page_id % 4 = 2 THEN 'not_pdf' WHEN strlen(c) > 4000 THEN 'too_large' ELSE 'accepted' END AS outcome FROM f""")
def file_gate(spark, sf_dir):
    files = seeded.read_table(spark, sf_dir, "pages").selectExpr("concat('p', page_id) AS path", """encode(CASE page_id % 4 WHEN 0 THEN concat('%PDF-1.7 ', html) WHEN 1 THEN ''
     WHEN 2 THEN concat(repeat('x', 1100), '%PDF') ELSE concat('junk %PDF ', html) END, 'UTF-8') AS content""")
    return S.file_gate(files, 4000)


@query("filename_sanitize", r"""WITH f AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(url || '.pdf', '[/\\]', '_', 'g'), '[^a-zA-Z0-9._\- ]', '_', 'g'), '_+', '_', 'g'), '_') AS s FROM pages)
SELECT page_id, coalesce(nullif(s, ''), 'document.pdf') AS safe FROM f""")
def filename_sanitize(spark, sf_dir):
    pages = seeded.read_table(spark, sf_dir, "pages").selectExpr("page_id", "concat(url, '.pdf') AS name")
    return pages.selectExpr("page_id", f"{S.sanitize_filename('name')} AS safe")


@query("data_uri_parse", seeded.SQL_CORPUS + """SELECT doc_id, seq, CASE WHEN starts_with(src, 'data:') THEN 'image/png' END AS mime, CASE WHEN starts_with(src, 'data:') THEN 8 END AS n_bytes FROM block WHERE block_type = 'image'""")
def data_uri_parse(spark, sf_dir):
    return seeded.blocks(spark, sf_dir).filter("block_type = 'image'").selectExpr("doc_id", "seq", f"{S.DATA_URI_PARTS} AS d").selectExpr(
        "doc_id", "seq", "d.mime AS mime", "octet_length(d.bytes) AS n_bytes")


@query("rgb_to_hex", """WITH c AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS p, [l_discount * 5, l_tax * 12, l_quantity / 40] AS rgb FROM lineitem)
SELECT id, n, p, '#' || array_to_string(list_transform(rgb, lambda c: lpad(lower(printf('%x', greatest(0, least(255, CAST(trunc(c * 255) AS INT))))), 2, '0')), '') AS hex FROM c""")
def rgb_to_hex(spark, sf_dir):
    rows = seeded.read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS n", "l_partkey AS p", "array(l_discount * 5, l_tax * 12, l_quantity / 40) AS rgb")
    return rows.selectExpr("id", "n", "p", f"{S.RGB_HEX} AS hex")


@query("gap_report", SQL_GAPS + """, gg AS (SELECT doc_id, string_agg(check_id, ',' ORDER BY o, table_no) AS checks FROM gap GROUP BY 1)
SELECT doc_id, score, CASE WHEN score >= 90 THEN 'GREEN' WHEN score >= 70 THEN 'YELLOW' ELSE 'RED' END AS colour, coalesce(checks, '') AS checks FROM sc LEFT JOIN gg USING (doc_id)""")
def gap_report(spark, sf_dir):
    html = seeded.html_pages(spark, sf_dir)
    report = sinks.gap_report(H.html_scores(html).select("doc_id", "score"), H.html_gaps(html))
    return report.selectExpr("doc_id", "score", "colour", "array_join(transform(gaps, g -> g.check_id), ',') AS checks")


@query("decorative_image_predicate", seeded.SQL_CORPUS + r"""SELECT doc_id, seq FROM block WHERE block_type = 'image' AND ((abs(x2 - x1) > 0 AND abs(x2 - x1) < 5) OR (abs(y2 - y1) > 0 AND abs(y2 - y1) < 5)
 OR regexp_matches(concat(coalesce(alt, ''), ' ', content), '(?i)\b(decorative|spacer|separator|border|divider|background)\b'))""")
def decorative_image_predicate(spark, sf_dir):
    from pagelight.operators.checks import IMAGE_KIND

    return seeded.blocks(spark, sf_dir).filter(f"({IMAGE_KIND}) = 'decorative'").select("doc_id", "seq")


@query("placeholder_alt_predicate", seeded.SQL_CORPUS + r"""SELECT doc_id, seq FROM block WHERE alt IS NOT NULL AND regexp_matches(trim(alt), '(?i)^(placeholder|.*\.(jpg|jpeg|png|gif))$')""")
def placeholder_alt_predicate(spark, sf_dir):
    from pagelight.functions.text import PLACEHOLDER_ALT, q_like, q_strip

    return seeded.blocks(spark, sf_dir).filter(f"alt IS NOT NULL AND {q_like(q_strip('alt'), PLACEHOLDER_ALT)}").select("doc_id", "seq")
