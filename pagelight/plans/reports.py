"""Audit aggregation, ranking, votes and corpus reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelight.operators import checks, reports
from pagelight.plans import gates
from pagelight.plans.checks import SQL_FACTS, SQL_FINDINGS, seeded_flags
from pagelight.plans.registry import query
from pagelight.sources import dimensions, seeded


def findings(spark, sf_dir, criteria=None):
    return checks.audit_findings(seeded.corpus(spark, sf_dir), criteria, seeded_flags(spark, sf_dir))


@query("audit_findings", SQL_FINDINGS + "SELECT * FROM finding")
def audit_findings(spark, sf_dir):
    return findings(spark, sf_dir).drop("rule_id")


_STATUS = """CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'not_applicable') THEN 'not_applicable'
 ELSE 'pass' END"""


@query("full_audit", SQL_FINDINGS + f"""SELECT doc_id, count(*) AS rules_checked,
 count(*) FILTER (s = 'pass') AS rules_passed, count(*) FILTER (s = 'fail') AS rules_failed,
 count(*) FILTER (s = 'not_applicable') AS rules_not_applicable, CAST(0 AS BIGINT) AS rules_errored,
 round_even(count(*) FILTER (s <> 'not_applicable') * 100.0
  / greatest(count(*) - count(*) FILTER (s = 'not_applicable'), 1), 1) AS coverage_pct
FROM (SELECT doc_id, criterion, {_STATUS} AS s FROM finding GROUP BY ALL) GROUP BY doc_id""")
def full_audit(spark, sf_dir):
    return checks.audit_documents(seeded.corpus(spark, sf_dir), seeded_flags(spark, sf_dir))


@query("rule_status", SQL_FINDINGS + f"SELECT doc_id, criterion, {_STATUS} AS status FROM finding GROUP BY doc_id, criterion")
def rule_status(spark, sf_dir):
    """Status per document and rule, from the findings."""
    return reports.rule_status(findings(spark, sf_dir))


@query("audit_summary", SQL_FINDINGS + """SELECT doc_id, count(*) FILTER (f) AS total_issues,
 count(*) FILTER (f AND severity = 'critical') AS critical, count(*) FILTER (f AND severity = 'serious') AS serious,
 count(*) FILTER (f AND severity = 'moderate') AS moderate, count(*) FILTER (f AND severity = 'minor') AS warning,
 count(*) FILTER (f AND auto_fixable) AS auto_fixable, count(*) FILTER (f AND NOT auto_fixable) AS needs_review
FROM (SELECT *, status = 'fail' AS f FROM finding) GROUP BY doc_id""")
def audit_summary(spark, sf_dir):
    return reports.severity_summary(findings(spark, sf_dir))


@query("rule_breakdown", SQL_FINDINGS + f"""SELECT d.doc_id, r.criterion,
 CASE WHEN count(f.status) FILTER (f.status = 'fail') > 0 THEN 'fail'
  WHEN count(f.status) FILTER (f.status = 'not_applicable') = count(f.status) THEN 'not_applicable' ELSE 'pass' END AS status,
 count(f.status) FILTER (f.status = 'fail') AS finding_count,
 CASE max(CASE WHEN f.status = 'fail' THEN CASE f.severity WHEN 'critical' THEN 4 WHEN 'serious' THEN 3
  WHEN 'moderate' THEN 2 ELSE 1 END END) WHEN 4 THEN 'critical' WHEN 3 THEN 'serious' WHEN 2 THEN 'moderate'
  WHEN 1 THEN 'minor' END AS severity_max
FROM doc d CROSS JOIN rule r LEFT JOIN finding f
 ON f.doc_id = d.doc_id AND f.criterion = r.criterion GROUP BY 1, 2""")
def rule_breakdown(spark, sf_dir):
    corpus = seeded.corpus(spark, sf_dir)
    return reports.rule_breakdown(corpus.doc, findings(spark, sf_dir))


_TYPE = """CASE WHEN criterion = '1.1.1' THEN 'image'
 WHEN issue IN ('table_caption_missing', 'layout_table', 'table_headers_missing', 'table_row_width') THEN 'table'
 WHEN issue IN ('heading_level_invalid', 'heading_empty', 'level_skipped') THEN 'heading'
 WHEN issue IN ('generic_link_text', 'bare_url') THEN CASE WHEN contains(lower(evidence), 'table') THEN 'table'
   WHEN contains(lower(evidence), 'heading') THEN 'heading' ELSE 'link' END
 WHEN issue = 'no_headings' THEN 'heading' WHEN issue = 'no_structure' THEN 'table'
 WHEN criterion = '2.4.2' OR issue = 'sensory_reference' THEN CASE WHEN contains(lower(evidence), 'table') THEN 'table'
   WHEN contains(lower(evidence), 'heading') THEN 'heading' WHEN contains(lower(evidence), 'link') THEN 'link'
   ELSE 'document' END
 ELSE 'document' END"""
_PRIORITY = """CASE severity WHEN 'critical' THEN 8 WHEN 'serious' THEN 6 WHEN 'moderate' THEN 4 ELSE 2 END
 + CASE WHEN auto_fixable THEN 0 ELSE 2 END
 + CASE remediation_type WHEN 'manual_review' THEN 3 WHEN 'ai_draft' THEN 1 ELSE 0 END"""


@query("findings_to_proposals", SQL_FINDINGS + f"""SELECT doc_id,
 coalesce(nullif(element_id, ''), 'wcag_' || replace(criterion, '.', '_')) AS proposal_id, criterion,
 CASE WHEN issue = 'scanned_pages' THEN 'table' ELSE {_TYPE} END AS element_type,
 CASE WHEN starts_with(evidence, 'image_ids: ') THEN nullif(trim(substr(evidence, 12)), '') END AS image_id,
 severity, page, auto_fixable, remediation_type AS action_type, issue
FROM finding WHERE status = 'fail'""")
def findings_to_proposals(spark, sf_dir):
    return reports.proposals(findings(spark, sf_dir)).drop("description")


@query("review_priority_order", SQL_FINDINGS + f"""SELECT doc_id, criterion, page, issue, priority, proposal_id,
 row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, ord, page, proposal_id, issue) AS review_rank
FROM (SELECT f.*, coalesce(nullif(element_id, ''), 'wcag_' || replace(criterion, '.', '_')) AS proposal_id, r.ord, {_PRIORITY} AS priority
 FROM finding f JOIN (SELECT criterion, ord FROM rule) r USING (criterion) WHERE status = 'fail')""")
def review_priority_order(spark, sf_dir):
    found = findings(spark, sf_dir)
    rules = dimensions.rules(spark).select("criterion", "ord")
    rows = reports.proposals(found).join(rules, "criterion")
    ranked = reports.ranked(rows, ["ord", "page", "proposal_id", "issue"], keep=["criterion"])
    return ranked.select("doc_id", "criterion", "page", "issue", "priority", "proposal_id",
                         F.col("review_rank").cast("bigint").alias("review_rank"))


_VOTES = """internal_raw AS (SELECT l.doc_id, r.rule_id, r.seq,
  CASE (l.doc_id + r.seq) % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'not_applicable' ELSE 'pass' END AS status
  FROM labels l, (SELECT 'r' || CAST(x % 5 AS VARCHAR) AS rule_id, x AS seq FROM range(0, 8) t(x)) r),
internal AS (SELECT doc_id, rule_id, CASE WHEN bool_or(status = 'fail') THEN 'fail' ELSE arg_min(status, seq) END AS result
  FROM internal_raw GROUP BY ALL),
pdfua AS (SELECT doc_id, 'r' || CAST(doc_id % 7 AS VARCHAR) AS rule_id,
  CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS result FROM labels),
matterhorn AS (SELECT doc_id, 'r' || CAST(doc_id % 3 AS VARCHAR) AS rule_id,
  CASE WHEN toxic = 1 THEN 'fail' WHEN doc_id % 6 = 0 THEN 'skip' ELSE 'pass' END AS result FROM labels),
votes AS (SELECT coalesce(i.doc_id, p.doc_id, m.doc_id) AS doc_id, coalesce(i.rule_id, p.rule_id, m.rule_id) AS rule_id,
  coalesce(i.result, 'skip') AS internal, coalesce(p.result, 'skip') AS pdfua, coalesce(m.result, 'skip') AS matterhorn
  FROM internal i FULL JOIN pdfua p USING (doc_id, rule_id)
  FULL JOIN matterhorn m ON coalesce(i.doc_id, p.doc_id) = m.doc_id AND coalesce(i.rule_id, p.rule_id) = m.rule_id),
conf AS (SELECT *, CASE WHEN np + nf < 2 THEN 'low' WHEN np = 0 OR nf = 0 THEN 'high' WHEN np <> nf THEN 'medium'
  ELSE 'low' END AS confidence, np + nf = 0 OR (np > 0 AND np = nf) AS needs_review
  FROM (SELECT *, (internal = 'pass')::INT + (pdfua = 'pass')::INT + (matterhorn = 'pass')::INT AS np,
   (internal = 'fail')::INT + (pdfua = 'fail')::INT + (matterhorn = 'fail')::INT AS nf FROM votes))"""


def _internal_raw(spark, sf_dir):
    labels = seeded.read_table(spark, sf_dir, "labels")
    return labels.selectExpr("doc_id", "explode(sequence(0, 7)) AS seq").selectExpr(
        "doc_id", "concat('r', seq % 5) AS criterion", "seq",
        "CASE (doc_id + seq) % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'not_applicable' ELSE 'pass' END AS status",
    )


def _results(spark, sf_dir):
    labels = seeded.read_table(spark, sf_dir, "labels")
    internal = reports.internal_results(_internal_raw(spark, sf_dir)).selectExpr(
        "doc_id", "criterion AS rule_id", "status AS result")
    pdfua = labels.selectExpr(
        "doc_id", "concat('r', doc_id % 7) AS rule_id", "CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS result")
    matterhorn = labels.selectExpr(
        "doc_id", "concat('r', doc_id % 3) AS rule_id",
        "CASE WHEN toxic = 1 THEN 'fail' WHEN doc_id % 6 = 0 THEN 'skip' ELSE 'pass' END AS result")
    return internal, pdfua, matterhorn


@query("internal_results", f"WITH {_VOTES} SELECT doc_id, rule_id AS criterion, result AS status FROM internal")
def internal_results(spark, sf_dir):
    return reports.internal_results(_internal_raw(spark, sf_dir))


@query("validator_full_outer_join", f"WITH {_VOTES} SELECT * FROM votes")
def validator_full_outer_join(spark, sf_dir):
    return reports.join_votes(*_results(spark, sf_dir))


@query("validator_rule_id_union", f"""WITH {_VOTES} SELECT doc_id, rule_id FROM internal
 UNION SELECT doc_id, rule_id FROM pdfua UNION SELECT doc_id, rule_id FROM matterhorn""")
def validator_rule_id_union(spark, sf_dir):
    return reports.all_rule_ids(*_results(spark, sf_dir))


@query("vote_confidence", f"""WITH {_VOTES} SELECT doc_id, rule_id, internal, pdfua, matterhorn, confidence, needs_review
 FROM conf""")
def vote_confidence(spark, sf_dir):
    return reports.vote_confidence(reports.join_votes(*_results(spark, sf_dir)))


@query("confidence_histogram", f"""WITH {_VOTES} SELECT doc_id, count(*) FILTER (confidence = 'high') AS high,
 count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low,
 count(*) FILTER (needs_review) AS needs_review FROM conf GROUP BY doc_id""")
def confidence_histogram(spark, sf_dir):
    return reports.confidence_histogram(vote_confidence(spark, sf_dir))


_FEATURES = SQL_FACTS


@query("document_features", _FEATURES + """SELECT doc_id, has_forms, has_media, has_javascript, is_document_set,
 n_image > 0 AS has_images, n_table > 0 AS has_tables, n_heading > 0 AS has_headings, has_links,
 CAST(coalesce(nullif(page_count, 0), n_page) AS BIGINT) AS pages FROM facts""")
def document_features(spark, sf_dir):
    return checks.doc_features(seeded.corpus(spark, sf_dir), seeded_flags(spark, sf_dir))


def _has(*words):
    return "(" + " OR ".join(f"contains(lower(condition), '{w}')" for w in words) + ")"


SQL_APPLICABLE = _FEATURES + f""",
{dimensions.SQL_RULE},
app AS (SELECT doc_id, ord, rule_id, criterion, level, principle, automation, applicability, remediation
 FROM facts CROSS JOIN rule WHERE applicability = 'always' OR (applicability = 'conditional' AND CASE
 WHEN {_has('form')} AND has_forms THEN true WHEN {_has('media', 'audio', 'video')} THEN has_media
 WHEN {_has('javascript', 'interactive')} THEN has_javascript WHEN {_has('document set')} THEN is_document_set
 WHEN {_has('hover', 'focus')} THEN has_javascript WHEN {_has('animated', 'flash', 'moving')} THEN has_media
 WHEN {_has('shortcut', 'time', 'pointer', 'gesture', 'motion')} THEN has_javascript
 WHEN {_has('legal', 'financial')} THEN has_forms WHEN {_has('status')} THEN has_javascript
 WHEN {_has('label', 'validation', 'error')} THEN has_forms ELSE true END))
"""


def _applicable(spark, sf_dir):
    return reports.applicable_rules(document_features(spark, sf_dir), dimensions.rules(spark))


@query("applicable_rules", SQL_APPLICABLE + "SELECT doc_id, rule_id FROM app")
def applicable_rules(spark, sf_dir):
    return _applicable(spark, sf_dir).select("doc_id", "rule_id")


@query("rules_by_principle", SQL_APPLICABLE + """SELECT doc_id, rule_id, level FROM app
 WHERE principle = 'operable'""")
def rules_by_principle(spark, sf_dir):
    return _applicable(spark, sf_dir).filter("principle = 'operable'").select("doc_id", "rule_id", "level")


_XREF = "xref AS (SELECT * FROM " + dimensions.sql_values(
    [(k, c, i, t) for k, table in (("technique", dimensions.CRITERION_TECHNIQUES),
                                   ("failure", dimensions.CRITERION_FAILURES))
     for c, ids in table.items() for i, t in enumerate(ids)], "kind, criterion, ord, technique_id") + ")"


@query("rule_technique_join", SQL_APPLICABLE + f""", {_XREF}, refs AS (SELECT criterion,
 string_agg(technique_id, ', ' ORDER BY ord) FILTER (kind = 'technique') AS t,
 string_agg(technique_id, ', ' ORDER BY ord) FILTER (kind = 'failure') AS f FROM xref GROUP BY criterion)
SELECT doc_id, criterion, coalesce(concat_ws('; ', t, 'Failures: ' || f), '') AS technique_refs
FROM app LEFT JOIN refs USING (criterion)""")
def rule_technique_join(spark, sf_dir):
    refs = dimensions.technique_refs(dimensions.rules(spark), dimensions.bridge(spark))
    return _applicable(spark, sf_dir).select("doc_id", "criterion").join(refs, "criterion", "left").select(
        "doc_id", "criterion", "technique_refs")


@query("coverage_matrix", SQL_APPLICABLE + f""", {_XREF}, refs AS (SELECT criterion,
 string_agg(technique_id, ',' ORDER BY ord) FILTER (kind = 'technique') AS t,
 string_agg(technique_id, ',' ORDER BY ord) FILTER (kind = 'failure') AS f FROM xref GROUP BY criterion)
SELECT doc_id, criterion, level, coalesce(t, '') AS techniques, coalesce(f, '') AS failures
FROM app LEFT JOIN refs USING (criterion)""")
def coverage_matrix(spark, sf_dir):
    return reports.coverage_matrix(_applicable(spark, sf_dir), dimensions.bridge(spark))


@query("coverage_summary", SQL_APPLICABLE + """, facets AS (SELECT 'level' AS facet, unnest(['A', 'AA']) AS value
 UNION ALL SELECT 'automation', unnest(['automated', 'semi_automated', 'manual'])
 UNION ALL SELECT 'applicability', unnest(['always', 'conditional', 'never'])
 UNION ALL SELECT 'remediation', unnest(['auto_fix', 'ai_draft', 'manual_review']))
SELECT d.doc_id, facet, value, count(a.doc_id) AS n FROM (SELECT DISTINCT doc_id FROM app) d CROSS JOIN facets
 LEFT JOIN app a ON a.doc_id = d.doc_id AND CASE facet WHEN 'level' THEN level WHEN 'automation' THEN automation
  WHEN 'applicability' THEN applicability ELSE remediation END = value GROUP BY ALL""")
def coverage_summary(spark, sf_dir):
    return reports.coverage_summary(_applicable(spark, sf_dir), ["doc_id"])


@query("content_type_matrix", SQL_FINDINGS + ", types AS (SELECT * FROM " + dimensions.sql_values(
    reports.CONTENT_TYPES, "content_type, criteria, automated, assisted, human") + """)
SELECT content_type, len(criteria) AS n_criteria, automated, assisted, human, (SELECT count(*) FROM finding f
 WHERE status = 'fail' AND list_contains(criteria, f.criterion)) AS failing FROM types""")
def content_type_matrix(spark, sf_dir):
    types = spark.createDataFrame(
        reports.CONTENT_TYPES, "content_type string, criteria array<string>, automated int, assisted int, human int")
    return reports.content_type_matrix(findings(spark, sf_dir), types)


_COLS = "doc_id, proposal_id, category, criterion, element_id, severity, page, auto_fixable"


@query("structure_proposals", SQL_FACTS + f"""SELECT {_COLS} FROM (
SELECT doc_id, coalesce(image_id, concat('img_p', page_num, '_i', row_number() OVER (PARTITION BY doc_id, page_num,
  image_id IS NULL ORDER BY seq) - 1)) AS proposal_id, 'alt_text' AS category, '1.1.1' AS criterion,
 proposal_id AS element_id, 'critical' AS severity, page_num AS page, true AS auto_fixable
 FROM block WHERE block_type = 'image' AND coalesce(alt, '') = ''
UNION ALL SELECT doc_id, 'str_heading_hierarchy_0', 'heading_hierarchy', '2.4.6', 'document-level', 'serious', 1, true
 FROM facts WHERE n_heading = 0 AND page_count > 1
UNION ALL SELECT doc_id, concat('hdg_p', page_num, '_i', row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1),
 'heading_hierarchy', '2.4.6', block_id, 'serious', page_num, true FROM (SELECT *, lag(coalesce(level, 1)) OVER
  (PARTITION BY doc_id ORDER BY seq) AS pl FROM block WHERE block_type = 'heading')
 WHERE pl > 0 AND coalesce(level, 1) > pl + 1
UNION ALL SELECT doc_id, concat('tbl_p', page_num, '_i', row_number() OVER (PARTITION BY doc_id, page_num
  ORDER BY seq) - 1), 'table_structure', '1.3.1', block_id, 'serious', page_num, true
 FROM block WHERE block_type = 'table' AND coalesce(len(headers), 0) = 0
UNION ALL SELECT doc_id, 'str_language_0', 'language', '3.1.1', 'document-lang', 'moderate', 1, true FROM doc
UNION ALL SELECT doc_id, concat('str_reading_order_', row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1),
 'reading_order', '1.3.2', concat('page-', page_num), 'moderate', page_num, true FROM (SELECT doc_id, page_num
  FROM block GROUP BY ALL HAVING count(*) >= 2
  AND count(DISTINCT CASE WHEN x1 > 0 THEN round_even(x1 / 10, 0) END) >= 3))""")
def structure_proposals(spark, sf_dir):
    return reports.structure_proposals(seeded.corpus(spark, sf_dir))


_SCORE = """score AS (SELECT 'f' || o_orderkey AS filename,
 CASE o_orderstatus WHEN 'P' THEN 'validation_error' WHEN 'O' THEN 'conversion_error' ELSE 'ok' END AS status,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey % 50) / 50.0 END AS score,
 CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE o_totalprice / 10000.0 END AS elapsed_s FROM orders)"""


def _score(spark, sf_dir):
    return seeded.read_table(spark, sf_dir, "orders").selectExpr(
        "concat('f', o_orderkey) AS filename",
        "CASE o_orderstatus WHEN 'P' THEN 'validation_error' WHEN 'O' THEN 'conversion_error' ELSE 'ok' END AS status",
        "CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 50) / 50.0D END AS score",
        "CASE WHEN o_orderkey % 7 = 0 THEN 0.0D ELSE o_totalprice / 10000.0D END AS elapsed_s",
    )


@query("corpus_run_statistics", f"""WITH {_SCORE} SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS ok,
 count(*) FILTER (status = 'validation_error') AS validation_errors,
 count(*) FILTER (status NOT IN ('ok', 'validation_error')) AS errors,
 round_even(count(*) FILTER (status = 'ok') / count(*), 4) AS pass_rate,
 round_even(count(*) FILTER (score >= 0.9) / count(*), 4) AS green_rate, round_even(avg(score), 4) AS avg_score,
 round_even(avg(elapsed_s) FILTER (elapsed_s <> 0), 3) AS avg_elapsed_s FROM score""")
def corpus_run_statistics(spark, sf_dir):
    return reports.corpus_statistics(_score(spark, sf_dir))


_CLASS = """CASE WHEN score IS NULL THEN 'UNKNOWN' WHEN score >= 0.9 THEN 'GREEN' WHEN score >= 0.7 THEN 'YELLOW'
 ELSE 'RED' END"""


@query("score_classification", f"WITH {_SCORE} SELECT filename, {_CLASS} AS colour FROM score")
def score_classification(spark, sf_dir):
    return _score(spark, sf_dir).selectExpr("filename", f"{reports.COLOUR} AS colour")


@query("colour_counts", f"""WITH {_SCORE} SELECT c.colour, count(s.filename) AS n FROM (VALUES ('GREEN'), ('YELLOW'),
 ('RED'), ('UNKNOWN')) c(colour) LEFT JOIN (SELECT filename, {_CLASS} AS colour FROM score) s USING (colour) GROUP BY 1""")
def colour_counts(spark, sf_dir):
    return reports.colour_counts(_score(spark, sf_dir))


@query("regression_gate", f"""WITH {_SCORE}, cur AS (SELECT avg(score) AS a, count(*) FILTER (score < 0.7) AS r
  FROM score WHERE status = 'ok'), gold AS (SELECT avg(score) AS a, count(*) FILTER (score < 0.7) AS r FROM score
  WHERE status <> 'conversion_error')
SELECT round_even(cur.a, 4) AS cur_avg, round_even(gold.a, 4) AS gold_avg, cur.r AS cur_red, gold.r AS gold_red,
 cur.a >= gold.a - 0.005 AS score_ok, cur.r <= gold.r AS red_ok FROM cur, gold""")
def regression_gate(spark, sf_dir):
    score = _score(spark, sf_dir)
    return reports.regression_verdict(score.filter("status = 'ok'"), score.filter("status <> 'conversion_error'"))


@query("facet_search", SQL_FINDINGS + """SELECT doc_id, criterion, issue, element_id FROM finding
 WHERE status = 'fail' AND severity = 'serious' AND (contains(lower(issue), 'link')
  OR contains(lower(coalesce(evidence, '')), 'link'))""")
def facet_search(spark, sf_dir):
    found = reports.facet_search(
        findings(spark, sf_dir), {"status": "fail", "severity": "serious"}, "LINK", ["issue", "evidence"])
    return found.select("doc_id", "criterion", "issue", "element_id")


@query("group_by_criterion_natural_order", SQL_FINDINGS + """SELECT criterion, count(*) AS n,
 row_number() OVER (ORDER BY list_transform(string_split(criterion, '.'), lambda p: CAST(p AS INT))) AS pos
FROM finding WHERE status = 'fail' GROUP BY criterion""")
def group_by_criterion_natural_order(spark, sf_dir):
    from pyspark.sql import Window

    from pagelight.functions.text import criterion_key

    # At most 50 rows reach this window: one per criterion.
    counts = findings(spark, sf_dir).filter("status = 'fail'").groupBy("criterion").agg(F.expr("count(*) AS n"))
    order = Window.partitionBy(F.lit(0)).orderBy(criterion_key(F.col("criterion")))
    return counts.withColumn("pos", F.row_number().over(order).cast("bigint"))


_QUEUE = """queue AS (SELECT o_orderkey AS item_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved'
  ELSE 'rejected' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS decision,
 o_custkey AS doc_id FROM orders)"""
QUEUE = [
    "o_orderkey AS item_id",
    "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status",
    "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS decision", "o_custkey AS doc_id",
]


@query("status_rank_sort", f"""WITH {_QUEUE} SELECT item_id, status, decision FROM queue
 ORDER BY decision IS NOT NULL, CASE status WHEN 'pending' THEN 0 WHEN 'approved' THEN 1 ELSE 2 END, item_id""")
def status_rank_sort(spark, sf_dir):
    rank = F.expr("CASE status WHEN 'pending' THEN 0 WHEN 'approved' THEN 1 ELSE 2 END")
    queue = seeded.read_table(spark, sf_dir, "orders").selectExpr(*QUEUE)
    return queue.orderBy(F.col("decision").isNotNull(), rank, "item_id").select(
        "item_id", "status", "decision")


@query("status_counts_and_progress", f"""WITH {_QUEUE} SELECT doc_id, count(*) AS total,
 count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved,
 count(*) FILTER (status = 'rejected') AS rejected, count(decision) AS reviewed,
 round_even(count(decision) / count(*), 4) AS progress FROM queue GROUP BY doc_id""")
def status_counts_and_progress(spark, sf_dir):
    queue = seeded.read_table(spark, sf_dir, "orders").selectExpr(*QUEUE)
    return queue.groupBy("doc_id").agg(
        F.expr("count(*) AS total"),
        *[F.expr(f"count_if(status = '{s}') AS {s}") for s in ("pending", "approved", "rejected")],
        F.expr("count(decision) AS reviewed"), F.expr("bround(count(decision) / count(*), 4) AS progress"),
    )


@query("pending_review_estimate", SQL_FACTS + """SELECT doc_id, CASE WHEN doc_id % 3 = 0
 THEN greatest(1, CAST(floor(page_count / 5) AS BIGINT)) ELSE 0 END AS estimate FROM doc""")
def pending_review_estimate(spark, sf_dir):
    doc = seeded.corpus(spark, sf_dir).doc.selectExpr(
        "*", "CASE WHEN doc_id % 3 = 0 THEN 'hitl_review' ELSE 'done' END AS status")
    return doc.selectExpr(
        "doc_id", "CASE WHEN status = 'hitl_review' THEN greatest(1, floor(page_count / 5)) ELSE 0 END AS estimate")


_REVIEW = """items AS (SELECT doc_id, block_id, c.category, c.severity FROM block, (SELECT unnest([
 {'category': 'low_confidence_ocr', 'severity': 'serious'}, {'category': 'complex_table', 'severity': 'serious'},
 {'category': 'missing_alt_text', 'severity': 'critical'}, {'category': 'ambiguous_heading', 'severity': 'moderate'},
 {'category': 'form_field', 'severity': 'moderate'}]) AS c) WHERE CASE c.category
 WHEN 'low_confidence_ocr' THEN source = 'ocr' AND confidence < 0.7
 WHEN 'complex_table' THEN block_type = 'table' AND len(list_filter(rows, lambda r: len(r) <> len(rows[1]))) > 0
 WHEN 'missing_alt_text' THEN block_type = 'image' AND trim(coalesce(alt, '')) = ''
 WHEN 'ambiguous_heading' THEN block_type = 'heading' AND (level IS NULL OR level > 6)
 ELSE block_type = 'form_field' END)"""


_REVIEW = f"""{_REVIEW}, needed AS (SELECT * FROM items UNION ALL SELECT doc_id, check_name,
 CASE WHEN starts_with(check_name, 'axe_') THEN 'browser_violation' ELSE 'gate_soft_fail' END, severity FROM ck WHERE status = 'soft_fail')"""


@query("review_needed", gates.ALL_SQL + f", {_REVIEW} SELECT * FROM needed")
def review_needed(spark, sf_dir):
    return reports.review_needed(seeded.corpus(spark, sf_dir), gates.all_checks(spark, sf_dir))


@query("review_needed_counts", gates.ALL_SQL + f""", {_REVIEW} SELECT category, severity, count(*) AS n FROM needed
 GROUP BY GROUPING SETS ((category), (severity))""")
def review_needed_counts(spark, sf_dir):
    return reports.review_counts(review_needed(spark, sf_dir))
