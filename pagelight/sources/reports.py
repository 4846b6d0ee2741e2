"""Scans of external reports, event envelopes and uploaded files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.functions.text import q, q_strip

_RULE = "ruleId:string,clause:string,specification:string,status:string,failedChecks:int,description:string"
PDFUA_SCHEMA = (
    f"compliant boolean, ruleSummaries array<struct<{_RULE}>>, report struct<jobs:array<struct<validationResult:"
    f"struct<compliant:boolean,details:struct<rules:array<struct<{_RULE}>>>>>>,batchSummary:struct<validationReports:"
    "struct<compliant:int,nonCompliant:int>>>"
)


def scan_pdfua(report: DataFrame) -> DataFrame:
    """Three shapes of PDF/UA reports in one table; a structured rule id is unwrapped."""
    p = report.withColumn("p", F.from_json("body", PDFUA_SCHEMA))
    job = "p.report.jobs[0].validationResult"
    shaped = p.selectExpr(
        "doc_id",
        """CASE WHEN p.compliant IS NOT NULL THEN 'direct' WHEN size(p.report.jobs) > 0 THEN 'nested' ELSE 'batch' END AS shape""",
        f"""CASE WHEN p.compliant IS NOT NULL THEN p.compliant WHEN size(p.report.jobs) > 0 THEN coalesce({job}.compliant, false)
         ELSE coalesce(p.report.batchSummary.validationReports.compliant, 0) > 0 END AS compliant""",
        f"""CASE WHEN p.compliant IS NOT NULL THEN coalesce(p.ruleSummaries, array())
         ELSE coalesce({job}.details.rules, array()) END AS rules""",
        "coalesce(p.report.batchSummary.validationReports.nonCompliant, 0) AS non_compliant",
    )
    failed = shaped.selectExpr(
        "*",
        """transform(filter(rules, r -> CASE shape WHEN 'direct' THEN coalesce(r.failedChecks, 0) > 0 ELSE r.status = 'failed' END),
         r -> named_struct('rule_id', coalesce(get_json_object(r.ruleId, '$.id'), r.ruleId, ''),
          'clause', coalesce(r.clause, r.specification, ''), 'n', coalesce(r.failedChecks, 1))) AS failed_rules""",
    )
    return failed.selectExpr(
        "doc_id", "compliant", "failed_rules",
        "array_sort(array_distinct(filter(transform(failed_rules, f -> f.clause), c -> c <> ''))) AS clauses",
        """CASE shape WHEN 'batch' THEN non_compliant ELSE aggregate(failed_rules, 0, (a, f) -> a + f.n) END AS error_count""",
        "size(rules) AS checked", "size(rules) - size(failed_rules) AS passed",
    )


BROWSER_SCHEMA = (
    "violations array<struct<id:string,impact:string,tags:array<string>,nodes:array<string>>>, passes array<string>, "
    "incomplete array<string>"
)


def scan_browser_rules(report: DataFrame) -> DataFrame:
    p = report.withColumn("p", F.from_json("body", BROWSER_SCHEMA))
    sized = p.selectExpr(
        "doc_id",
        """transform(coalesce(p.violations, array()), v -> named_struct('id', coalesce(v.id, ''), 'impact', coalesce(v.impact, 'minor'),
         'tags', coalesce(v.tags, array()), 'nodes', coalesce(size(v.nodes), 0))) AS violations""",
        "coalesce(size(p.passes), 0) AS passes", "coalesce(size(p.incomplete), 0) AS incomplete")
    total = "(size(violations) + passes + incomplete)"
    return sized.selectExpr(
        "doc_id", "violations", "passes", "incomplete", f"CASE WHEN {total} > 0 THEN bround(passes / {total}, 4) ELSE 1.0D END AS score")


_CHECK = "array<struct<rule_id:string,id:string,clause:string,status:string,result:string,failure_count:int,count:int>>"
MATTERHORN_SCHEMA = f"checks {_CHECK}, rules {_CHECK}, results {_CHECK}, compliant boolean, is_compliant boolean"


def scan_matterhorn(report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document counts, rule rows); statuses outside the known ones are in no counter."""
    p = report.withColumn("p", F.from_json("body", MATTERHORN_SCHEMA)).selectExpr(
        "doc_id", "coalesce(p.checks, p.rules, p.results, array()) AS checks", "coalesce(p.compliant, p.is_compliant) AS stated")
    rules = p.select("doc_id", F.posexplode("checks").alias("ord", "c")).selectExpr(
        "doc_id", "ord", "coalesce(c.rule_id, c.id, '') AS rule_id", "lower(coalesce(c.status, c.result, '')) AS status",
        "coalesce(c.failure_count, c.count, 0) AS failure_count")
    s = "transform(checks, c -> lower(coalesce(c.status, c.result, '')))"
    docs = p.selectExpr(
        "doc_id", "stated", f"size(filter({s}, x -> x = 'pass')) AS passed", f"size(filter({s}, x -> x = 'fail')) AS failed",
        f"size(filter({s}, x -> x IN ('not_applicable', 'na', 'skip'))) AS na",
    ).selectExpr("doc_id", "coalesce(stated, failed = 0) AS compliant", "passed", "failed", "na", "passed + failed + na AS total")
    return docs, rules


def scan_checker_issues(issue: DataFrame, doc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issue rows with their severity, score of every document of ``doc``, 1 without any issue)."""
    raw = "lower(raw_severity)"
    rows = issue.withColumn("severity", F.expr(
        f"""CASE WHEN raw_severity IS NULL THEN 'moderate' WHEN contains({raw}, 'critical') THEN 'critical'
         WHEN contains({raw}, 'serious') OR contains({raw}, 'error') THEN 'serious'
         WHEN contains({raw}, 'warning') THEN 'moderate' ELSE 'minor' END"""))
    counts = issue.groupBy("doc_id").agg(F.expr("count(*) AS n"))
    scores = doc.select("doc_id").join(counts, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).selectExpr(
        "doc_id", "n", "bround(greatest(0.0D, 1.0D - n / greatest(n + 10, 10)), 4) AS score")
    return rows, scores


_LAYOUT = "struct<segments:array<struct<start:int,end:int>>,confidence:double,vertices:array<struct<x:double,y:double>>>"
_ROWS = f"array<struct<cells:array<{_LAYOUT}>>>"
OCR_SCHEMA = f"text string, pages array<struct<paragraphs:array<{_LAYOUT}>,tables:array<struct<headerRows:{_ROWS},bodyRows:{_ROWS}>>>>"


PIECE = 512  # characters


def _slices(layout: str) -> str:
    """Text of the segments of a layout, from the pieces of the full text they lie in."""
    first = "greatest(coalesce(s.start, 0), 0)"
    held = f"slice(pieces, {first} div {PIECE} + 1, greatest((s.end - 1) div {PIECE} - {first} div {PIECE} + 1, 0))"
    return f"array_join(transform({layout}.segments, s -> substr(array_join({held}, ''), {first} % {PIECE} + 1, s.end - {first})), '')"


def scan_ocr(report: DataFrame) -> DataFrame:
    """OCR layout -> blocks: text by slices of the full text, last header row wins, empty tables dropped.

    A report is parsed once and its text cut once into pieces of ``PIECE`` characters, so a segment costs the pieces it lies in
    wherever it stands.  Blocks are built in the row of their page and leave it without the text.
    """
    def grid(rows: str) -> str:
        return f"filter(transform(coalesce({rows}, array()), r -> transform(r.cells, c -> {q_strip(_slices('c'))})), r -> size(r) > 0)"

    none = "CAST(array() AS array<string>) AS headers, CAST(array() AS array<array<string>>) AS rows"
    paras = f"""filter(transform(coalesce(page.paragraphs, array()), (l, i) -> struct(i AS ord, 'paragraph' AS block_type, {q_strip(_slices('l'))} AS content,
        CASE WHEN size(l.vertices) >= 4 THEN l.vertices[0].x ELSE 0.0D END AS x1,
        CASE WHEN size(l.vertices) >= 4 THEN l.vertices[2].y ELSE 0.0D END AS y2, {none})), b -> b.content <> '')"""
    tables = f"""filter(transform(coalesce(page.tables, array()), (t, i) -> struct(i AS ord, 'table' AS block_type, '' AS content, 0.0D AS x1, 0.0D AS y2,
        coalesce(try_element_at({grid('t.headerRows')}, -1), array()) AS headers, {grid('t.bodyRows')} AS rows)), b -> size(b.headers) > 0 OR size(b.rows) > 0)"""
    # Generators keep the optimizer from repeating the parse and the cut wherever their results are used.
    parsed = report.select("doc_id", F.explode(F.array(F.from_json("body", OCR_SCHEMA))).alias("p"))
    cut = parsed.selectExpr("doc_id", f"inline(array(struct(p.pages AS pages, regexp_extract_all(p.text, '(?s).{{1,{PIECE}}}', 0) AS pieces)))")
    pages = cut.selectExpr("doc_id", "pieces", "posexplode(pages) AS (page_num, page)")
    return pages.selectExpr("doc_id", "page_num", f"inline(concat({paras}, {tables}))").select(
        "doc_id", "page_num", "ord", "block_type", "content", "x1", "y2", "headers", "rows")


def decode_envelopes(envelope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects with a reason): base64 JSON inside ``message.data``; the same code runs on a stream."""
    opened = envelope.selectExpr(
        "event_id", "body", "get_json_object(body, '$.message') AS message", "get_json_object(body, '$.message.data') AS data",
    ).selectExpr("*", "try_to_binary(data, 'base64') AS bytes").selectExpr("*", "decode(bytes, 'UTF-8') AS payload")
    judged = opened.selectExpr(
        "event_id", "payload",
        """CASE WHEN message IS NULL THEN 'no_message' WHEN coalesce(data, '') = '' THEN 'no_data' WHEN bytes IS NULL THEN 'not_base64'
         WHEN try_parse_json(payload) IS NULL THEN 'not_json' END AS reason""")
    return judged.filter("reason IS NULL").select("event_id", "payload"), judged.filter("reason IS NOT NULL").select("event_id", "reason")


MAX_BYTES = 50 * 1024 * 1024
HEADER_BYTES = 1024


def file_gate(binary: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """binaryFile rows -> accepted or the reason of refusal; only the first kilobyte is searched."""
    head = f"decode(substring(content, 1, {HEADER_BYTES}), 'ISO-8859-1')"
    return binary.selectExpr(
        "path", "octet_length(content) AS n_bytes",
        f"""CASE WHEN octet_length(content) = 0 THEN 'empty' WHEN NOT contains({head}, '%PDF') THEN 'not_pdf'
         WHEN octet_length(content) > {max_bytes} THEN 'too_large' ELSE 'accepted' END AS outcome""")


_SAFE = "[^a-zA-Z0-9._\\- ]"


def sanitize_filename(x: str, limit: int = 255) -> str:
    """SQL text of a safe file name: separators and odd characters become one underscore, extension kept."""
    separators = q(r"[/\\]")
    clean = f"trim('_', regexp_replace(regexp_replace(regexp_replace({x}, {separators}, '_'), {q(_SAFE)}, '_'), '_+', '_'))"
    ext = f"regexp_extract({clean}, r'[^.](\\.[^.]*)$', 1)"
    cut = f"CASE WHEN length({clean}) > {limit} THEN concat(substr({clean}, 1, {limit} - length({ext})), {ext}) ELSE {clean} END"
    return f"coalesce(nullif({cut}, ''), 'document.pdf')"


DATA_URI = r"(?s)^data:([^;]+);base64,(.+)"
DATA_URI_PARTS = f"""CASE WHEN src rlike {q(DATA_URI)} AND try_to_binary(regexp_extract(src, {q(DATA_URI)}, 2), 'base64') IS NOT NULL
 THEN named_struct('mime', regexp_extract(src, {q(DATA_URI)}, 1), 'bytes', try_to_binary(regexp_extract(src, {q(DATA_URI)}, 2), 'base64')) END"""

RGB_HEX = """CASE WHEN size(rgb) = 3 THEN concat('#', array_join(transform(rgb,
 c -> lpad(lower(hex(CAST(greatest(0, least(255, CAST(c * 255 AS INT))) AS BIGINT))), 2, '0')), '')) END"""
