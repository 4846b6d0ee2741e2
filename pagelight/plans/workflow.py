"""Review workflow over the order, conversation and line tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelight.operators import elements as E, workflow as W
from pagelight.plans.elements import SQL_TYPED
from pagelight.plans.registry import query
from pagelight.sources import seeded

_COMMENT = """CASE turn % 5 WHEN 0 THEN concat('Always ', text) WHEN 1 THEN '' WHEN 2 THEN concat(text, ' for all documents') ELSE text END"""
_PROP = [
    "conv_id", "turn", f"{_COMMENT} AS human_comment", "CASE (conv_id + turn) % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'image' WHEN 2 THEN 'heading' ELSE 'link' END AS element_type",
    "CASE conv_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'serious' WHEN 2 THEN 'minor' WHEN 3 THEN '' END AS finding_severity",
    "CASE WHEN turn % 3 <> 0 THEN '1.1.1' END AS finding_criterion", "CASE WHEN conv_id % 7 = 0 THEN 'approve' END AS reviewer_decision",
]
_SQLP = "cp AS (SELECT " + ", ".join(_PROP) + " FROM conversations)"


@query("evaluate_change_proposal", f"""WITH {_SQLP}, ev AS (SELECT *, CASE WHEN reviewer_decision = 'approve' THEN 'negative' WHEN finding_severity IN ('critical', 'serious')
 AND finding_criterion IS NOT NULL AND trim(human_comment) <> '' THEN 'positive' ELSE 'neutral' END AS compliance_impact,
 regexp_matches(human_comment, '(?i)\\b(always|all documents|every|whenever|global|all cases)\\b') AS g FROM cp),
ev1 AS (SELECT *, CASE WHEN element_type = 'table' OR g THEN 'high' WHEN element_type = 'image' THEN 'low' ELSE 'medium' END AS risk, CASE WHEN g THEN 'global_rule' ELSE 'single_doc' END AS scope FROM ev)
SELECT conv_id, turn, compliance_impact, risk, scope, CASE WHEN compliance_impact = 'negative' OR risk = 'high' THEN 'reject' ELSE 'apply' END AS recommendation,
 concat_ws('; ', 'element_type=' || element_type, 'finding_severity=' || nullif(finding_severity, ''), 'wcag_criterion=' || finding_criterion,
  'compliance_impact=' || compliance_impact, 'risk=' || risk, 'scope=' || scope) AS evidence FROM ev1""")
def evaluate_change_proposal(spark, sf_dir):
    return W.evaluate(seeded.read_table(spark, sf_dir, "conversations").selectExpr(*_PROP)).select(
        "conv_id", "turn", "compliance_impact", "risk", "scope", "recommendation", "evidence")


_P = ["o_orderkey AS proposal_id", "o_custkey AS item_id", "CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'applied' WHEN 3 THEN 'rejected' ELSE 'rolled_back' END AS status",
      "concat('text ', CAST(o_orderkey AS STRING)) AS proposed_text", "CASE WHEN o_orderkey % 2 = 0 THEN 'approve' END AS snapshot_decision", "CAST(NULL AS STRING) AS snapshot_edit"]
_I = ["c_custkey AS item_id", "CASE c_custkey % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' END AS decision", "CASE WHEN c_custkey % 4 = 0 THEN 'old' END AS edit"]
_C = ["o_orderkey AS proposal_id", "CASE WHEN o_orderkey % 2 = 1 THEN 'none' WHEN o_orderkey % 3 = 0 THEN 'rollback' ELSE 'apply' END AS command"]
_AR = f"""pr AS (SELECT {', '.join(_P)} FROM orders), it AS (SELECT {', '.join(_I)} FROM customer), cm AS (SELECT {', '.join(_C)} FROM orders),
jd AS (SELECT *, CASE WHEN command = 'apply' AND status IN ('pending', 'approved') THEN 'applied' WHEN command = 'rollback' AND status = 'applied' THEN 'rolled_back' END AS ns
 FROM cm JOIN pr USING (proposal_id) LEFT JOIN it USING (item_id))"""


def _apply(spark, sf_dir):
    orders = seeded.read_table(spark, sf_dir, "orders")
    return W.apply_proposals(orders.selectExpr(*_P), seeded.read_table(spark, sf_dir, "customer").selectExpr(*_I),
                             orders.selectExpr(*_C))


@query("apply_and_rollback_proposals", f"""WITH {_AR} SELECT proposal_id, command, coalesce(ns, status) AS status, ns IS NULL AS refused,
 CASE ns WHEN 'applied' THEN 'edit' WHEN 'rolled_back' THEN snapshot_decision ELSE decision END AS decision,
 CASE ns WHEN 'applied' THEN proposed_text WHEN 'rolled_back' THEN snapshot_edit ELSE edit END AS edit FROM jd""")
def apply_and_rollback_proposals(spark, sf_dir):
    return _apply(spark, sf_dir)[0].select("proposal_id", "command", "status", "refused", "decision", "edit")


@query("proposal_audit_rows", f"""WITH {_AR} SELECT 'change_proposal' AS entity_type, proposal_id AS entity_id, CASE command WHEN 'apply' THEN 'proposal_applied' ELSE 'proposal_rolled_back' END AS action,
 status AS old_value, ns AS new_value FROM jd WHERE ns IS NOT NULL""")
def proposal_audit_rows(spark, sf_dir):
    return _apply(spark, sf_dir)[1]


_D = """it AS (SELECT o_orderkey AS item_id, CASE o_orderkey % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' END AS decision FROM orders),
de AS (SELECT o_orderkey AS item_id, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'reject' ELSE 'edit' END AS new_decision, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '__null' ELSE 'approve' END AS expected FROM orders),
jd AS (SELECT it.*, new_decision, expected, new_decision IS NOT NULL AND (expected IS NULL OR decision IS NOT DISTINCT FROM nullif(expected, '__null')) AS hit FROM it LEFT JOIN de USING (item_id))"""


def _decide(spark, sf_dir):
    orders = seeded.read_table(spark, sf_dir, "orders")
    item = orders.selectExpr("o_orderkey AS item_id", "CASE o_orderkey % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' END AS decision")
    decision = orders.selectExpr(
        "o_orderkey AS item_id", "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'reject' ELSE 'edit' END AS new_decision", "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '__null' ELSE 'approve' END AS expected")
    return W.decide(item, decision)


@query("decision_with_expected_state", f"WITH {_D} SELECT item_id, CASE WHEN hit THEN new_decision ELSE decision END AS decision FROM jd")
def decision_with_expected_state(spark, sf_dir):
    return _decide(spark, sf_dir)[0]


@query("decision_conflicts", f"WITH {_D} SELECT item_id, expected, decision AS actual FROM jd WHERE new_decision IS NOT NULL AND NOT hit")
def decision_conflicts(spark, sf_dir):
    return _decide(spark, sf_dir)[1]


_ALT = ["o_orderkey AS proposal_id", "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status", "concat('alt ', CAST(o_custkey AS STRING)) AS proposed_alt"]


def _alts(spark, sf_dir):
    return seeded.read_table(spark, sf_dir, "orders").selectExpr(*_ALT)


@query("alt_text_decisions", f"""WITH ap AS (SELECT {', '.join(_ALT)} FROM orders), de AS (SELECT l_orderkey AS proposal_id, CASE count(*) % 4 WHEN 1 THEN 'approve' WHEN 2 THEN 'edit' WHEN 3 THEN 'reject' END AS choice
 FROM lineitem GROUP BY 1)
SELECT proposal_id, CASE WHEN choice IS NULL THEN status WHEN choice IN ('approve', 'edit') THEN 'approved' ELSE 'rejected' END AS status,
 CASE choice WHEN 'edit' THEN 'edited ' || proposal_id WHEN 'approve' THEN proposed_alt END AS final_alt FROM ap LEFT JOIN de USING (proposal_id)""")
def alt_text_decisions(spark, sf_dir):
    first = seeded.read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("proposal_id")).agg(
        F.expr("count(*) AS n"))
    decision = first.selectExpr("proposal_id", "CASE n % 4 WHEN 1 THEN 'approve' WHEN 2 THEN 'edit' WHEN 3 THEN 'reject' END AS choice", "concat('edited ', proposal_id) AS edited_text")
    return W.alt_decisions(_alts(spark, sf_dir), decision)


@query("alt_text_batch_approve", f"""WITH ap AS (SELECT {', '.join(_ALT)} FROM orders) SELECT proposal_id, CASE WHEN status = 'pending' AND proposal_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
 THEN 'approved' ELSE status END AS status FROM ap""")
def alt_text_batch_approve(spark, sf_dir):
    ids = seeded.read_table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("proposal_id"))
    return W.batch_approve(_alts(spark, sf_dir), ids)[0]


@query("pending_queue_page", """SELECT o_orderkey AS item_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'O' ORDER BY created_at DESC, item_id LIMIT 50 OFFSET 100""")
def pending_queue_page(spark, sf_dir):
    rows = seeded.read_table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").selectExpr("o_orderkey AS item_id", "o_orderdate AS created_at")
    return W.queue_page(rows, [F.col("created_at").desc(), "item_id"], 50, 100)


@query("audit_trail", """SELECT o_custkey AS entity_id, o_orderdate AS ts, o_orderkey AS action_id, count(*) OVER (PARTITION BY o_custkey) AS n,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ord FROM orders""")
def audit_trail(spark, sf_dir):
    from pagelight.operators import events

    log = seeded.read_table(spark, sf_dir, "orders").selectExpr("o_custkey AS task_id", "o_orderdate AS ts", "o_orderkey AS event_id")
    return events.task_events(log).selectExpr("task_id AS entity_id", "ts", "event_id AS action_id", "n", "ord")


@query("list_proposals", """SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def list_proposals(spark, sf_dir):
    return seeded.read_table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").selectExpr(
        "o_orderkey AS id", "o_orderdate AS created_at").orderBy(F.col("created_at").desc(), "id")


_IT = ["l_orderkey AS doc_id", "l_linenumber AS item_id", "CASE l_returnflag WHEN 'A' THEN 'approve' WHEN 'N' THEN CASE WHEN l_linenumber % 3 = 0 THEN 'edit' ELSE 'approve' END ELSE CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE 'reject' END END AS decision"]


@query("recompile_readiness", f"""WITH it AS (SELECT {', '.join(_IT)} FROM lineitem), rd AS (SELECT doc_id, count(*) FILTER (decision IS NULL) AS pending, count(*) FILTER (decision IN ('approve', 'edit')) AS approved,
 count(*) FILTER (decision NOT IN ('approve', 'edit')) AS manual FROM it GROUP BY 1)
SELECT o_orderkey AS doc_id, CASE WHEN rd.doc_id IS NULL THEN 'no_items' WHEN pending > 0 THEN 'pending_review' ELSE 'ready' END AS state, coalesce(approved, 0) AS approved, coalesce(manual, 0) AS manual,
 coalesce(pending, 0) AS pending FROM orders LEFT JOIN rd ON rd.doc_id = o_orderkey""")
def recompile_readiness(spark, sf_dir):
    docs = seeded.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return W.readiness_of(docs, seeded.read_table(spark, sf_dir, "lineitem").selectExpr(*_IT))


_CH = "ch AS (SELECT o_custkey AS doc_id, CASE o_orderstatus WHEN 'O' THEN 'processing' WHEN 'F' THEN 'complete' ELSE 'hitl_review' END AS status, o_orderdate AS ts, o_orderkey AS n FROM orders)"


def _status(spark, sf_dir):
    doc = seeded.read_table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", "'uploaded' AS status")
    change = seeded.read_table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS doc_id", "CASE o_orderstatus WHEN 'O' THEN 'processing' WHEN 'F' THEN 'complete' ELSE 'hitl_review' END AS status", "o_orderdate AS ts", "o_orderkey AS n")
    return W.change_status(doc, change)


@query("document_status_history", f"""WITH {_CH} SELECT doc_id, n, ts, coalesce(lag(status) OVER (PARTITION BY doc_id ORDER BY n), 'uploaded') AS old, status AS new FROM ch WHERE doc_id IN (SELECT c_custkey FROM customer)""")
def document_status_history(spark, sf_dir):
    return _status(spark, sf_dir)[1]


@query("document_latest_status", f"WITH {_CH} SELECT c_custkey AS doc_id, coalesce(arg_max(status, n), 'uploaded') AS status FROM customer LEFT JOIN ch ON ch.doc_id = c_custkey GROUP BY 1")
def document_latest_status(spark, sf_dir):
    return _status(spark, sf_dir)[0]


_DRAFT = r""", dr AS (SELECT doc_id, Path || ':' || seq AS element_id, Text, len(regexp_extract_all(Path, '/')) - 1 AS depth, CASE WHEN element_type IN ('image', 'table', 'heading') THEN element_type END AS route,
 CASE WHEN h % 4 <> 0 THEN 'draft ' || seq END AS draft FROM sv),
dj AS (SELECT *, CASE WHEN route = 'table' AND depth >= 2 THEN 'manual' WHEN draft IS NULL THEN 'manual' WHEN route = 'heading' THEN 'simple' ELSE 'review' END AS complexity,
 CASE WHEN route = 'table' AND depth >= 2 THEN '[MANUAL REMEDIATION REQUIRED — nested table]' WHEN draft IS NULL THEN '[MANUAL REMEDIATION REQUIRED — draft failed]' ELSE draft END AS suggestion FROM dr WHERE route IS NOT NULL)"""


def _drafts(spark, sf_dir):
    typed = E.classify(seeded.elements(spark, sf_dir)).selectExpr(
        "doc_id", "seq", "concat(Path, ':', seq) AS element_id", "Text", "element_type", f"{E.NESTING_DEPTH} AS nesting_depth")
    draft = typed.filter("(doc_id * 31 + seq) % 4 <> 0").selectExpr("doc_id", "element_id", "concat('draft ', seq) AS draft")
    return W.route_drafts(typed, draft)


@query("draft_findings", SQL_TYPED + _DRAFT + "SELECT doc_id, element_id, CASE route WHEN 'image' THEN '1.1.1' WHEN 'table' THEN '1.3.1' ELSE '2.4.6' END AS criterion, complexity, suggestion FROM dj")
def draft_findings(spark, sf_dir):
    return _drafts(spark, sf_dir)[0]


@query("draft_review_items", SQL_TYPED + _DRAFT + "SELECT doc_id, element_id, route AS element_type, Text AS original, suggestion FROM dj")
def draft_review_items(spark, sf_dir):
    return _drafts(spark, sf_dir)[1].drop("decision")


_ITEM = ["l_orderkey * 10 + l_linenumber AS item_id", "l_orderkey AS document_id", "CASE l_linenumber % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'image' WHEN 2 THEN 'table' WHEN 3 THEN '' ELSE 'link' END AS element_type",
         "concat('f', CAST(l_partkey AS STRING)) AS finding_id", "CASE WHEN l_suppkey % 6 <> 0 THEN concat('suggest ', CAST(l_suppkey AS STRING)) END AS ai_suggestion",
         "CASE l_returnflag WHEN 'A' THEN 'approve' WHEN 'R' THEN 'reject' ELSE CASE WHEN l_linenumber > 4 THEN 'escalate' END END AS reviewer_decision",
         "CASE WHEN l_partkey % 7 = 0 THEN concat('edit ', CAST(l_partkey AS STRING)) ELSE '' END AS reviewer_edit", "CASE WHEN l_partkey % 3 = 0 THEN 'kim' END AS reviewed_by",
         "CAST(NULL AS TIMESTAMP) AS reviewed_at", "CAST(l_linenumber * 2 AS STRING) AS lvl"]


def _items(spark, sf_dir):
    return seeded.read_table(spark, sf_dir, "lineitem").selectExpr(*_ITEM).selectExpr("*", "map('level', lvl, 'caption', concat('cap ', lvl)) AS original")


@query("review_item_to_element", f"""WITH it AS (SELECT {', '.join(_ITEM)} FROM lineitem), tx AS (SELECT *, coalesce(nullif(reviewer_edit, ''), ai_suggestion, '') AS t FROM it)
SELECT item_id, coalesce(nullif(element_type, ''), 'paragraph') AS element_type, CASE WHEN element_type = 'image' THEN 'cap ' || lvl ELSE t END AS content, CASE WHEN element_type = 'image' THEN t END AS alt,
 CASE WHEN element_type = 'heading' THEN greatest(1, least(6, CAST(lvl AS INT))) END AS level, CASE WHEN element_type = 'table' THEN t END AS caption FROM tx""")
def review_item_to_element(spark, sf_dir):
    return W.review_item_elements(_items(spark, sf_dir))


@query("manual_review_rows", f"""WITH it AS (SELECT *, coalesce(reviewer_decision, 'pending') AS d FROM (SELECT {', '.join(_ITEM)} FROM lineitem))
SELECT item_id, document_id, element_type, finding_id, ai_suggestion, d AS reviewer_decision, reviewer_edit, coalesce(reviewed_by, '') AS reviewed_by, '' AS reviewed_at,
 CASE d WHEN 'reject' THEN 'Reviewer rejected AI suggestion — requires manual remediation.' WHEN 'pending' THEN 'Item not yet reviewed — manual review required before recompilation.'
 ELSE 'Flagged for manual review (decision: ' || d || ').' END AS reason_for_manual_review FROM it WHERE d NOT IN ('approve', 'edit')""")
def manual_review_rows(spark, sf_dir):
    return W.manual_review_rows(_items(spark, sf_dir))


@query("delete_by_document", """SELECT l_orderkey AS doc_id, count(*) AS removed FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def delete_by_document(spark, sf_dir):
    images = seeded.read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS image_id")
    docs = seeded.read_table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    return W.delete_documents(images, docs)[1]


@query("remaining_after_delete", """SELECT l_orderkey AS doc_id, l_linenumber AS image_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def remaining_after_delete(spark, sf_dir):
    images = seeded.read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS image_id")
    docs = seeded.read_table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    return W.delete_documents(images, docs)[0]


@query("partial_update_whitelist", """WITH ch AS (SELECT l_orderkey AS id, arg_max(CASE l_linestatus WHEN 'O' THEN 'applied' ELSE 'approved' END, (l_linenumber, l_partkey, l_linestatus)) AS s, max(l_shipdate) AS ts FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, coalesce(s, 'pending') AS status, 'note' AS reviewer_notes, CASE WHEN s IN ('approved', 'rejected', 'resolved') THEN ts END AS resolved_at FROM orders LEFT JOIN ch ON ch.id = o_orderkey""")
def partial_update_whitelist(spark, sf_dir):
    rows = seeded.read_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "'pending' AS status", "'note' AS reviewer_notes", "CAST(NULL AS TIMESTAMP) AS resolved_at")
    change = seeded.read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.expr("max_by(CASE l_linestatus WHEN 'O' THEN 'applied' ELSE 'approved' END, struct(l_linenumber, l_partkey, l_linestatus)) AS status"), F.expr("max(l_shipdate) AS ts"))
    return W.partial_update(rows, change.withColumn("owner", F.lit("x")))


@query("upsert_by_key", """WITH ba AS (SELECT l_orderkey AS id, l_linenumber * 1000000 + l_partkey AS t, l_shipmode AS name FROM (SELECT *, 'n' || l_partkey AS l_shipmode FROM lineitem))
SELECT o_orderkey AS id, coalesce((SELECT arg_max(name, t) FROM ba WHERE ba.id = o_orderkey), 'base') AS name, o_orderdate AS created_at FROM orders
UNION ALL SELECT id, arg_max(name, t), min(TIMESTAMP '2000-01-01') FROM ba WHERE id NOT IN (SELECT o_orderkey FROM orders) GROUP BY id""")
def upsert_by_key(spark, sf_dir):
    table = seeded.read_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "'base' AS name", "o_orderdate AS created_at")
    batch = seeded.read_table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS id", "concat('n', l_partkey) AS name", "TIMESTAMP '2000-01-01' AS created_at", "l_linenumber * 1000000L + l_partkey AS __turn")
    return W.upsert(table, batch, ["id"], keep=("created_at",))


@query("workflow_table_whitelist", """SELECT 'run' || user_id AS run_id, event_type AS stage, 'ok' AS status, NULL AS total_duration_s, NULL AS error_message FROM events""")
def workflow_table_whitelist(spark, sf_dir):
    return W.whitelisted(seeded.read_table(spark, sf_dir, "events").selectExpr(
        "concat('run', user_id) AS run_id", "event_type AS stage", "'ok' AS status", "value AS unknown_column"))


@query("json_column_decode", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INT) END AS k, CASE WHEN event_id % 5 = 0 THEN 'broken' || props END AS props_text FROM events""")
def json_column_decode(spark, sf_dir):
    rows = seeded.read_table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 5 = 0 THEN concat('broken', props) ELSE props END AS props")
    return W.decode_json(rows, "props", "k int").selectExpr("event_id", "props_value.k AS k", "props_text")


@query("document_child_join", """SELECT o_orderkey AS doc_id, l_linenumber AS item_no, o_orderstatus AS status FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def document_child_join(spark, sf_dir):
    doc = seeded.read_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "o_orderstatus AS status")
    child = seeded.read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS item_no")
    return doc.join(child, "doc_id")
