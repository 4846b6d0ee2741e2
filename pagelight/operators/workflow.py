"""Review workflow: proposals, decisions, queues, audit trail and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.functions.text import q_blank, q_like

# Fixed value: words that make a comment a global rule.
GLOBAL_WORDS = r"(?i)\b(always|all documents|every|whenever|global|all cases)\b"
_GLOBAL = q_like("coalesce(human_comment, '')", GLOBAL_WORDS)
EVALUATION = {
    "compliance_impact": f"""CASE WHEN reviewer_decision = 'approve' THEN 'negative'
     WHEN finding_severity IN ('critical', 'serious') AND coalesce(finding_criterion, '') <> '' AND NOT {q_blank('human_comment')}
     THEN 'positive' ELSE 'neutral' END""",
    "risk": f"""CASE WHEN element_type = 'table' THEN 'high' WHEN {_GLOBAL} THEN 'high' WHEN element_type = 'image' THEN 'low'
     ELSE 'medium' END""",
    "scope": f"CASE WHEN {_GLOBAL} THEN 'global_rule' ELSE 'single_doc' END",
}


def evaluate(proposal: DataFrame) -> DataFrame:
    """Impact, risk, scope, recommendation and the evidence text of change proposals."""
    out = proposal.selectExpr("*", *[f"{e} AS {n}" for n, e in EVALUATION.items()])
    return out.selectExpr(
        "*", "CASE WHEN compliance_impact = 'negative' OR risk = 'high' THEN 'reject' ELSE 'apply' END AS recommendation",
        """concat_ws('; ', concat('element_type=', element_type), concat('finding_severity=', nullif(finding_severity, '')),
         concat('wcag_criterion=', nullif(finding_criterion, '')), concat('compliance_impact=', compliance_impact),
         concat('risk=', risk), concat('scope=', scope)) AS evidence""",
    )


def apply_proposals(proposal: DataFrame, item: DataFrame, command: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposal states, audit rows) after apply and rollback commands.

    Apply works from pending or approved and snapshots the item, rollback only from
    applied; other commands are refused and change nothing.
    """
    joined = command.join(proposal, "proposal_id").join(item, "item_id", "left")
    judged = joined.selectExpr(
        "proposal_id", "item_id", "command", "status AS old_status", "decision AS decision_before", "edit AS edit_before",
        """CASE WHEN command = 'apply' AND status IN ('pending', 'approved') THEN 'applied'
         WHEN command = 'rollback' AND status = 'applied' THEN 'rolled_back' END AS new_status""",
        "proposed_text", "snapshot_decision", "snapshot_edit")
    done = judged.selectExpr(
        "proposal_id", "item_id", "command", "old_status", "coalesce(new_status, old_status) AS status", "new_status IS NULL AS refused",
        "CASE new_status WHEN 'applied' THEN 'edit' WHEN 'rolled_back' THEN snapshot_decision ELSE decision_before END AS decision",
        "CASE new_status WHEN 'applied' THEN proposed_text WHEN 'rolled_back' THEN snapshot_edit ELSE edit_before END AS edit",
        "decision_before", "edit_before")
    audit = done.filter("NOT refused").selectExpr(
        "'change_proposal' AS entity_type", "proposal_id AS entity_id",
        "CASE command WHEN 'apply' THEN 'proposal_applied' ELSE 'proposal_rolled_back' END AS action", "old_status AS old_value", "status AS new_value")
    return done, audit


def decide(item: DataFrame, decision: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, conflicts): a decision counts only when the stored state is the expected one."""
    both = item.join(decision, "item_id", "left").withColumn(
        "__hit", F.expr("new_decision IS NOT NULL AND (expected IS NULL OR expected = '__any' OR decision <=> nullif(expected, '__null'))"))
    items = both.selectExpr("item_id", "CASE WHEN __hit THEN new_decision ELSE decision END AS decision")
    conflicts = both.filter("new_decision IS NOT NULL AND NOT __hit").select("item_id", "expected", F.col("decision").alias("actual"))
    return items, conflicts


def alt_decisions(proposal: DataFrame, decision: DataFrame) -> DataFrame:
    """approve and edit approve the text, anything else rejects it."""
    return proposal.join(decision, "proposal_id", "left").selectExpr(
        "proposal_id",
        "CASE WHEN choice IS NULL THEN status WHEN choice IN ('approve', 'edit') THEN 'approved' ELSE 'rejected' END AS status",
        "CASE WHEN choice = 'edit' THEN edited_text WHEN choice = 'approve' THEN proposed_alt END AS final_alt")


def batch_approve(proposal: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, count): listed proposals that are still pending become approved."""
    hit = proposal.filter("status = 'pending'").join(ids, "proposal_id", "left_semi").select("proposal_id", F.lit(True).alias("__hit"))
    rows = proposal.join(hit, "proposal_id", "left").selectExpr(
        "proposal_id", "CASE WHEN __hit THEN 'approved' ELSE status END AS status")
    return rows, hit.agg(F.expr("count(*) AS approved"))


def queue_page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page of a queue."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def readiness(item: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with their status, items with their set)."""
    sets = item.selectExpr(
        "*", "CASE WHEN decision IS NULL THEN 'pending' WHEN decision IN ('approve', 'edit') THEN 'approved' ELSE 'manual' END AS bucket")
    docs = sets.groupBy("doc_id").agg(
        F.expr("count(*) AS items"), F.expr("count_if(bucket = 'pending') AS pending"),
        F.expr("count_if(bucket = 'approved') AS approved"), F.expr("count_if(bucket = 'manual') AS manual"),
    ).withColumn("state", F.expr("CASE WHEN pending > 0 THEN 'pending_review' ELSE 'ready' END"))
    return docs, sets


def readiness_of(doc: DataFrame, item: DataFrame) -> DataFrame:
    docs, _ = readiness(item)
    return doc.select("doc_id").join(docs, "doc_id", "left").selectExpr(
        "doc_id", "coalesce(state, 'no_items') AS state", "coalesce(approved, 0) AS approved", "coalesce(manual, 0) AS manual",
        "coalesce(pending, 0) AS pending")


def change_status(doc: DataFrame, change: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with their latest status, audit rows old -> new in time order)."""
    from pagelight.functions import scan

    start = doc.selectExpr("doc_id", "status", "CAST(NULL AS TIMESTAMP) AS ts", "-1L AS n")
    history = start.unionByName(change.select("doc_id", "status", "ts", "n"))
    seen = scan.running(
        history, ["doc_id"], ["n"], {"old": scan.previous(F.col("status"))}, segment=[F.floor(F.col("n") / scan.SEGMENT_ROWS)])
    audit = seen.filter("n >= 0").select("doc_id", "n", "ts", "old", F.col("status").alias("new"))
    latest = history.groupBy("doc_id").agg(F.expr("max_by(status, n) AS status"))
    return latest, audit


def route_drafts(element: DataFrame, draft: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, review items): elements routed by type, joined with their drafted text.

    Deep tables get a fixed placeholder, missing drafts become manual work.
    """
    routed = element.selectExpr(
        "*", "CASE WHEN element_type IN ('figure', 'image') THEN 'image' WHEN element_type = 'table' THEN 'table' WHEN element_type = 'heading' THEN 'heading' END AS route",
    ).filter("route IS NOT NULL")
    joined = routed.join(draft, ["doc_id", "element_id"], "left").selectExpr(
        "doc_id", "element_id", "route", "Text AS original",
        """CASE WHEN route = 'table' AND nesting_depth >= 2 THEN 'manual' WHEN draft IS NULL THEN 'manual'
         WHEN route = 'heading' THEN 'simple' ELSE 'review' END AS complexity""",
        """CASE WHEN route = 'table' AND nesting_depth >= 2 THEN '[MANUAL REMEDIATION REQUIRED — nested table]'
         WHEN draft IS NULL THEN '[MANUAL REMEDIATION REQUIRED — draft failed]' ELSE draft END AS suggestion""")
    findings = joined.selectExpr(
        "doc_id", "element_id", "CASE route WHEN 'image' THEN '1.1.1' WHEN 'table' THEN '1.3.1' ELSE '2.4.6' END AS criterion",
        "complexity", "suggestion")
    items = joined.selectExpr("doc_id", "element_id", "route AS element_type", "original", "suggestion", "CAST(NULL AS STRING) AS decision")
    return findings, items


def review_item_elements(item: DataFrame) -> DataFrame:
    """Decided review items back to elements of a document."""
    text = "coalesce(nullif(reviewer_edit, ''), ai_suggestion, '')"
    return item.selectExpr(
        "item_id", "coalesce(nullif(element_type, ''), 'paragraph') AS element_type",
        f"CASE WHEN element_type = 'image' THEN coalesce(original['caption'], '') ELSE {text} END AS content",
        f"CASE WHEN element_type = 'image' THEN {text} END AS alt",
        """CASE WHEN element_type = 'heading' THEN greatest(1, least(6, coalesce(try_cast(original['level'] AS INT), 2))) END AS level""",
        f"CASE WHEN element_type = 'table' THEN {text} END AS caption")


def manual_review_rows(item: DataFrame) -> DataFrame:
    """Rows of the manual review file; items without a decision are pending."""
    decision = "coalesce(nullif(reviewer_decision, ''), 'pending')"
    return item.filter(f"{decision} NOT IN ('approve', 'edit')").selectExpr(
        "item_id", "document_id", "element_type", "finding_id", "ai_suggestion", f"{decision} AS reviewer_decision",
        "coalesce(reviewer_edit, '') AS reviewer_edit", "coalesce(reviewed_by, '') AS reviewed_by",
        "coalesce(CAST(reviewed_at AS STRING), '') AS reviewed_at",
        f"""CASE {decision} WHEN 'reject' THEN 'Reviewer rejected AI suggestion — requires manual remediation.'
         WHEN 'pending' THEN 'Item not yet reviewed — manual review required before recompilation.'
         ELSE concat('Flagged for manual review (decision: ', {decision}, ').') END AS reason_for_manual_review""")


# --- stored tables -------------------------------------------------------------


def upsert(table: DataFrame, batch: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Last write per key wins; columns in ``keep`` stay as first stored.

    Both sides meet in one aggregation that combines before the shuffle.
    """
    rest = [c for c in table.columns if c not in (*key, *keep)]
    both = table.withColumn("__turn", F.lit(-1).cast("bigint")).unionByName(batch.withColumn("__turn", F.col("__turn").cast("bigint")))
    return both.groupBy(*key).agg(
        F.max_by(F.struct(*rest), "__turn").alias("__new"), *[F.min_by(c, "__turn").alias(c) for c in keep]
    ).select(*key, *keep, "__new.*").select(*table.columns)


def delete_documents(table: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, removed count per document)."""
    gone = table.join(docs, "doc_id", "left_semi").groupBy("doc_id").agg(F.expr("count(*) AS removed"))
    return table.join(docs, "doc_id", "left_anti"), gone


UPDATABLE = ("status", "reviewer_notes")


def partial_update(row: DataFrame, change: DataFrame) -> DataFrame:
    """Only listed columns change; the resolution time is set for final states."""
    new = change.select("id", *[F.col(c).alias(f"__{c}") for c in UPDATABLE if c in change.columns], F.col("ts").alias("__ts"))
    return row.join(new, "id", "left").selectExpr(
        "id", *[f"coalesce(__{c}, {c}) AS {c}" if c in change.columns else c for c in UPDATABLE],
        "CASE WHEN __status IN ('approved', 'rejected', 'resolved') THEN __ts ELSE resolved_at END AS resolved_at")


def decode_json(rows: DataFrame, column: str, ddl: str) -> DataFrame:
    """JSON column decoded; a value that does not parse stays as text in ``<column>_text``."""
    return rows.withColumns({
        f"{column}_value": F.expr(f"CASE WHEN try_parse_json({column}) IS NOT NULL THEN from_json({column}, '{ddl}') END"),
        f"{column}_text": F.expr(f"CASE WHEN try_parse_json({column}) IS NULL THEN {column} END"),
    })


TELEMETRY_COLUMNS = ("run_id", "stage", "status", "total_duration_s", "error_message")


def whitelisted(rows: DataFrame, allowed=TELEMETRY_COLUMNS) -> DataFrame:
    """Only known columns are stored; missing ones are null."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in allowed])
