"""The rule ledger and the technique registries as small DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The 50 success criteria
# (criterion, name, level, applicability, automation, severity, remediation, condition).
RULES = [
    ("1.1.1", "Non-text Content", "A", "always", "semi_automated", "critical", "ai_draft", ""),
    ("1.2.1", "Audio-only and Video-only (Prerecorded)", "A", "conditional", "semi_automated", "serious", "manual_review", "PDF contains embedded audio or video"),
    ("1.2.2", "Captions (Prerecorded)", "A", "conditional", "manual", "serious", "manual_review", "PDF contains synchronized media"),
    ("1.2.3", "Audio Description or Media Alternative (Prerecorded)", "A", "conditional", "manual", "serious", "manual_review", "PDF contains synchronized media"),
    ("1.2.4", "Captions (Live)", "AA", "never", "manual", "serious", "manual_review", ""),
    ("1.2.5", "Audio Description (Prerecorded)", "AA", "conditional", "manual", "serious", "manual_review", "PDF contains prerecorded video"),
    ("1.3.1", "Info and Relationships", "A", "always", "semi_automated", "serious", "auto_fix", ""),
    ("1.3.2", "Meaningful Sequence", "A", "always", "semi_automated", "serious", "auto_fix", ""),
    ("1.3.3", "Sensory Characteristics", "A", "always", "semi_automated", "moderate", "manual_review", ""),
    ("1.3.4", "Orientation", "AA", "always", "automated", "moderate", "auto_fix", ""),
    ("1.3.5", "Identify Input Purpose", "AA", "conditional", "semi_automated", "moderate", "manual_review", "PDF contains form fields collecting user information"),
    ("1.4.1", "Use of Color", "A", "always", "semi_automated", "serious", "manual_review", ""),
    ("1.4.2", "Audio Control", "A", "conditional", "automated", "serious", "manual_review", "PDF contains auto-playing audio"),
    ("1.4.3", "Contrast (Minimum)", "AA", "always", "semi_automated", "serious", "manual_review", ""),
    ("1.4.4", "Resize Text", "AA", "always", "semi_automated", "moderate", "auto_fix", ""),
    ("1.4.5", "Images of Text", "AA", "always", "semi_automated", "moderate", "manual_review", ""),
    ("1.4.10", "Reflow", "AA", "always", "automated", "moderate", "auto_fix", ""),
    ("1.4.11", "Non-text Contrast", "AA", "always", "semi_automated", "moderate", "manual_review", ""),
    ("1.4.12", "Text Spacing", "AA", "always", "semi_automated", "moderate", "auto_fix", ""),
    ("1.4.13", "Content on Hover or Focus", "AA", "conditional", "semi_automated", "moderate", "manual_review", "PDF contains hover/focus-triggered content"),
    ("2.1.1", "Keyboard", "A", "always", "automated", "critical", "auto_fix", ""),
    ("2.1.2", "No Keyboard Trap", "A", "conditional", "semi_automated", "critical", "manual_review", "PDF contains interactive elements or JavaScript"),
    ("2.1.4", "Character Key Shortcuts", "A", "conditional", "automated", "moderate", "manual_review", "PDF contains custom keyboard shortcuts"),
    ("2.2.1", "Timing Adjustable", "A", "conditional", "automated", "critical", "manual_review", "PDF contains time-limited interactions"),
    ("2.2.2", "Pause, Stop, Hide", "A", "conditional", "automated", "serious", "manual_review", "PDF contains moving, blinking, or auto-updating content"),
    ("2.3.1", "Three Flashes or Below Threshold", "A", "conditional", "semi_automated", "critical", "manual_review", "PDF contains animated or video content"),
    ("2.4.1", "Bypass Blocks", "A", "always", "automated", "serious", "auto_fix", ""),
    ("2.4.2", "Page Titled", "A", "always", "automated", "serious", "auto_fix", ""),
    ("2.4.3", "Focus Order", "A", "always", "automated", "serious", "auto_fix", ""),
    ("2.4.4", "Link Purpose (In Context)", "A", "always", "semi_automated", "serious", "ai_draft", ""),
    ("2.4.5", "Multiple Ways", "AA", "always", "automated", "moderate", "auto_fix", ""),
    ("2.4.6", "Headings and Labels", "AA", "always", "semi_automated", "serious", "auto_fix", ""),
    ("2.4.7", "Focus Visible", "AA", "always", "automated", "moderate", "auto_fix", ""),
    ("2.5.1", "Pointer Gestures", "A", "conditional", "automated", "moderate", "manual_review", "PDF contains multipoint gesture interactions"),
    ("2.5.2", "Pointer Cancellation", "A", "conditional", "automated", "moderate", "manual_review", "PDF contains pointer-down triggered actions"),
    ("2.5.3", "Label in Name", "A", "conditional", "semi_automated", "serious", "manual_review", "PDF contains labeled UI components (form fields, buttons)"),
    ("2.5.4", "Motion Actuation", "A", "never", "automated", "moderate", "manual_review", ""),
    ("3.1.1", "Language of Page", "A", "always", "automated", "serious", "auto_fix", ""),
    ("3.1.2", "Language of Parts", "AA", "always", "semi_automated", "moderate", "manual_review", ""),
    ("3.2.1", "On Focus", "A", "conditional", "automated", "serious", "manual_review", "PDF contains interactive elements with focus handlers"),
    ("3.2.2", "On Input", "A", "conditional", "automated", "serious", "manual_review", "PDF contains form fields with change handlers"),
    ("3.2.3", "Consistent Navigation", "AA", "conditional", "manual", "minor", "manual_review", "PDF is part of a document set with repeated navigation"),
    ("3.2.4", "Consistent Identification", "AA", "conditional", "manual", "minor", "manual_review", "PDF is part of a document set"),
    ("3.3.1", "Error Identification", "A", "conditional", "semi_automated", "serious", "manual_review", "PDF contains form fields with validation"),
    ("3.3.2", "Labels or Instructions", "A", "conditional", "automated", "serious", "auto_fix", "PDF contains form fields"),
    ("3.3.3", "Error Suggestion", "AA", "conditional", "manual", "moderate", "manual_review", "PDF contains form fields with validation"),
    ("3.3.4", "Error Prevention (Legal, Financial, Data)", "AA", "conditional", "manual", "serious", "manual_review", "PDF contains forms with legal/financial submissions"),
    ("4.1.1", "Parsing", "A", "always", "automated", "serious", "auto_fix", ""),
    ("4.1.2", "Name, Role, Value", "A", "conditional", "automated", "critical", "auto_fix", "PDF contains form fields, links, or buttons"),
    ("4.1.3", "Status Messages", "AA", "conditional", "semi_automated", "moderate", "manual_review", "PDF contains dynamic status messages"),
]
PRINCIPLES = {"1": "perceivable", "2": "operable", "3": "understandable", "4": "robust"}

# Techniques and the criteria each one serves.
TECHNIQUES = {
    "PDF1": ["1.1.1"], "PDF2": ["2.4.5"], "PDF3": ["1.3.2", "2.1.1", "2.4.3"], "PDF4": ["1.1.1"],
    "PDF5": ["3.3.1", "3.3.2"], "PDF6": ["1.3.1"], "PDF7": ["1.4.5"], "PDF8": ["3.1.4"],
    "PDF9": ["1.3.1", "2.4.1"], "PDF10": ["1.3.1", "3.3.2", "4.1.2"], "PDF11": ["1.3.1", "2.1.1", "2.4.4"],
    "PDF12": ["1.3.1", "4.1.2"], "PDF13": ["2.4.4"], "PDF14": ["3.2.3"], "PDF15": ["3.2.2"],
    "PDF16": ["3.1.1"], "PDF17": ["1.3.1", "3.2.3"], "PDF18": ["2.4.2"], "PDF19": ["3.1.1", "3.1.2"],
    "PDF20": ["1.3.1"], "PDF21": ["1.3.1"], "PDF22": ["3.3.1", "3.3.3"], "PDF23": ["2.1.1"],
}
FAILURES = {
    "F25": ["2.4.2"], "F30": ["1.1.1"], "F38": ["1.1.1"], "F39": ["1.1.1"], "F43": ["1.3.1"], "F46": ["1.3.1"],
    "F65": ["1.1.1"], "F68": ["4.1.2"], "F86": ["4.1.2"], "F90": ["1.3.1"], "F91": ["1.3.1"],
}
CRITERION_TECHNIQUES = {
    "1.1.1": ["PDF1", "PDF4"],
    "1.3.1": ["PDF6", "PDF9", "PDF10", "PDF11", "PDF12", "PDF17", "PDF20", "PDF21"],
    "1.3.2": ["PDF3"], "1.4.5": ["PDF7"], "2.1.1": ["PDF3", "PDF11", "PDF23"], "2.4.1": ["PDF9"],
    "2.4.2": ["PDF18"], "2.4.3": ["PDF3"], "2.4.4": ["PDF11", "PDF13"], "2.4.5": ["PDF2"],
    "3.1.1": ["PDF16", "PDF19"], "3.1.2": ["PDF19"], "3.2.2": ["PDF15"], "3.2.3": ["PDF14", "PDF17"],
    "3.3.1": ["PDF5", "PDF22"], "3.3.2": ["PDF5", "PDF10"], "3.3.3": ["PDF22"], "4.1.2": ["PDF10", "PDF12"],
}
CRITERION_FAILURES = {
    "1.1.1": ["F30", "F38", "F39", "F65"], "1.3.1": ["F43", "F46", "F90", "F91"], "2.4.2": ["F25"],
    "4.1.2": ["F68", "F86"],
}

RULE_SCHEMA = (
    "ord int, rule_id string, criterion string, name string, level string, principle string, "
    "applicability string, automation string, severity string, remediation string, condition string, "
    "techniques array<string>, failures array<string>"
)


def rule_id(criterion: str) -> str:
    return "wcag_" + criterion.replace(".", "_")


def rule_rows() -> list[tuple]:
    return [
        (i, rule_id(c), c, name, level, PRINCIPLES[c[0]], app, auto, sev, rem, cond,
         CRITERION_TECHNIQUES.get(c, []), CRITERION_FAILURES.get(c, []))
        for i, (c, name, level, app, auto, sev, rem, cond) in enumerate(RULES)
    ]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), RULE_SCHEMA)


def techniques(spark: SparkSession) -> DataFrame:
    """(kind, technique_id, criteria) for both registries."""
    rows = [("technique", k, v) for k, v in TECHNIQUES.items()] + [("failure", k, v) for k, v in FAILURES.items()]
    return spark.createDataFrame(rows, "kind string, technique_id string, criteria array<string>")


def bridge(spark: SparkSession) -> DataFrame:
    """(kind, criterion, ord, technique_id)."""
    rows = [
        (kind, c, i, t)
        for kind, table in (("technique", CRITERION_TECHNIQUES), ("failure", CRITERION_FAILURES))
        for c, ids in table.items()
        for i, t in enumerate(ids)
    ]
    return spark.createDataFrame(rows, "kind string, criterion string, ord int, technique_id string")


def technique_refs(rule: DataFrame, xref: DataFrame) -> DataFrame:
    """Criterion -> "PDF1, PDF4; Failures: F30"; empty when it has none."""

    def ids(kind: str) -> Column:
        mine = F.collect_list(F.when(F.col("kind") == kind, F.struct("x.ord", "technique_id")))
        return F.array_join(F.transform(F.array_sort(mine), lambda s: s["technique_id"]), ", ")

    parts = (
        rule.alias("r")
        .join(xref.alias("x"), "criterion", "left")
        .groupBy("criterion")
        .agg(ids("technique").alias("t"), ids("failure").alias("f"))
    )
    return parts.select(
        "criterion",
        F.concat_ws(
            "; ",
            F.when(F.col("t") != "", F.col("t")),
            F.when(F.col("f") != "", F.concat(F.lit("Failures: "), F.col("f"))),
        ).alias("technique_refs"),
    )


def ledger_violations(rule: DataFrame, xref: DataFrame) -> DataFrame:
    """Integrity of the rule ledger: one row per broken constraint."""
    counts = rule.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("level") == "A").alias("a"),
        F.count_if(F.col("level") == "AA").alias("aa"),
    )
    totals = counts.select(
        F.explode(
            F.array(
                F.struct(F.lit("rule_count").alias("constraint"), (F.col("n") != 50).alias("bad")),
                F.struct(F.lit("level_a_count").alias("constraint"), (F.col("a") != 30).alias("bad")),
                F.struct(F.lit("level_aa_count").alias("constraint"), (F.col("aa") != 20).alias("bad")),
            )
        ).alias("c")
    ).filter("c.bad").select("c.constraint", F.lit("").alias("subject"))
    repeated = [
        rule.groupBy(F.col(k).alias("subject")).count().filter("count > 1").select(
            F.lit(f"unique_{k}").alias("constraint"), "subject")
        for k in ("rule_id", "criterion")
    ]
    listed = rule.select("criterion", F.explode(F.concat("techniques", "failures")).alias("technique_id"))
    missing = listed.join(xref, ["criterion", "technique_id"], "left_anti")
    extra = xref.join(listed, ["criterion", "technique_id"], "left_anti")
    sides = [
        d.select(F.lit(n).alias("constraint"), F.concat_ws(" ", "criterion", "technique_id").alias("subject"))
        for n, d in (("not_in_bridge", missing), ("not_in_ledger", extra))
    ]
    out = totals
    for d in repeated + sides:
        out = out.unionByName(d)
    return out


def bridge_violations(tech: DataFrame, xref: DataFrame) -> DataFrame:
    """Integrity between the technique registries and the bridge table."""
    counts = tech.groupBy("kind").count()
    wrong = counts.filter(
        F.col("count") != F.when(F.col("kind") == "technique", 23).otherwise(11)
    ).select(F.lit("registry_count").alias("constraint"), F.col("kind").alias("subject"))
    claims = tech.select("kind", "technique_id", F.explode("criteria").alias("criterion"))
    unknown = xref.join(tech, ["kind", "technique_id"], "left_anti")
    unclaimed = xref.join(claims, ["kind", "technique_id", "criterion"], "left_anti")
    covered = xref.filter("kind = 'technique'").select("criterion").distinct()
    unlisted = (
        claims.filter("kind = 'technique'").join(covered, "criterion", "left_semi")
        .join(xref, ["kind", "technique_id", "criterion"], "left_anti")
    )
    out = wrong
    for n, d in (("unknown_technique", unknown), ("criterion_not_claimed", unclaimed), ("claim_not_bridged", unlisted)):
        out = out.unionByName(
            d.select(F.lit(n).alias("constraint"), F.concat_ws(" ", "criterion", "technique_id").alias("subject"))
        )
    return out


def sql_values(rows, names: str) -> str:
    """The same dimension as a VALUES list for the comparison SQL."""

    def lit(v):
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]" if v else "CAST([] AS VARCHAR[])"
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") AS t({names})"


SQL_RULE = "rule AS (SELECT * FROM " + sql_values(
    rule_rows(),
    "ord, rule_id, criterion, name, level, principle, applicability, automation, severity, remediation, "
    "condition, techniques, failures",
) + ")"
