"""Data-driven repair rules: trigger ``type:condition``, action on the element."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.functions.text import q, q_blank, q_empty

# Fixed values.
ELEMENT_TYPES = ("table", "image", "heading", "paragraph", "link", "form_field")


def conditions(alt: str = "alt", level: str = "level") -> dict[str, str]:
    """Test of each condition; ``alt`` and ``level`` may be values that earlier rules changed."""
    return {
        "missing_headers": f"type = 'table' AND {q_empty('headers')}",
        "no_alt": q_blank(alt),
        "skip_level": f"coalesce({level} - prev_level > 1, false)",
        "empty": q_blank("content"),
    }


CONDITIONS = tuple(conditions())
MIN_CONFIDENCE, MIN_DOCUMENTS = 0.7, 3
# Rules that are counted for the documents of a task together.
BLOCK_RULES = 500


def valid_rules(rule: DataFrame) -> DataFrame:
    """Rules with a known type and condition, an action and enough confidence, in version order."""
    types = ", ".join(q(t) for t in ELEMENT_TYPES)
    conditions = ", ".join(q(c) for c in CONDITIONS)
    split = rule.selectExpr("*", "split(trigger_pattern, ':', 2) AS __p").filter("size(__p) = 2").selectExpr(
        *rule.columns, "__p[0] AS rule_type", "__p[1] AS condition")
    return split.filter(
        f"rule_type IN ({types}) AND condition IN ({conditions}) AND action.type IS NOT NULL AND confidence >= {MIN_CONFIDENCE}"
    ).orderBy("version", "id")


def match_rules(element: DataFrame, rule: DataFrame) -> DataFrame:
    """(element, rule) pairs that match: the tests that rules of the type ask for, then the rules of each test that was met.

    The tests, at most one per type and condition, meet the elements where they are read; what meets none leaves there, and of the
    others only the columns that are asked for travel. They are dealt out evenly before they meet their rules: few rows become many
    there, so the number of partitions is not left to their size.
    """
    tests = " ".join(f"WHEN {q(c)} THEN {e}" for c, e in conditions().items())
    key = [F.col("rule_type").alias("__type"), F.col("condition").alias("__condition")]
    asked = rule.select(*key).distinct()
    rules = rule.groupBy(*key).agg(
        F.collect_list(F.struct(*[c for c in rule.columns if c not in ("rule_type", "condition")])).alias("__rules"))
    parts = int(element.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = element.join(F.broadcast(asked), F.col("type") == F.col("__type")).filter(
        F.expr(f"CASE __condition {tests} ELSE false END")).repartition(parts, "doc_id", "seq")
    return met.join(rules, ["__type", "__condition"]).select(
        *element.columns, F.col("__type").alias("rule_type"), F.col("__condition").alias("condition"), F.inline("__rules")
    ).select(*element.columns, *rule.columns)


# What a rule can ask of an element beside its type, as columns of a state.  Earlier rules change the first two.
STATE = ("no_alt", "skip_level", "missing_headers", "empty", "above")
# Levels are 1 to 6, so of the heading above only this much decides whether a new level skips one.
ABOVE = "coalesce(greatest(-1, least(prev_level, 5)), 5)"


def _state() -> dict[str, str]:
    return {c: f"coalesce({e}, false)" for c, e in conditions().items()} | {"above": ABOVE}


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The outcome of a type's rules for every state an element of the type can start in, all states side by side."""
    flags = np.array(list(itertools.product((False, True), repeat=4)))
    above = np.repeat(np.arange(-1, 6), len(flags))
    start = np.tile(flags, (7, 1)).T
    for batch in batches:
        for kind, rules in zip(*(batch.column(i).to_pylist() for i in range(2))):
            state = dict(zip(STATE, (*start.copy(), above)))
            changed = {field: np.full(len(above), -1) for field in ("alt", "level", "scope")}
            removed = np.zeros(len(above), bool)
            hits = np.zeros((len(rules), len(above)), bool)
            for k, rule in enumerate(rules):
                hit = state[rule["condition"]].copy()
                hits[k] = hit
                if rule["act"] == "set_alt":
                    changed["alt"][hit] = k
                    state["no_alt"][hit] = rule["blank"]
                elif rule["act"] == "set_heading" and 1 <= (rule["number"] or 0) <= 6:
                    changed["level"][hit] = k
                    state["skip_level"][hit] = rule["number"] - above[hit] > 1
                elif rule["act"] == "add_scope":
                    changed["scope"][hit] = k
                elif rule["act"] == "remove_element":
                    removed |= hit
            new = {field: [None if k < 0 else rules[k]["number" if field == "level" else "value"] for k in at] for field, at in changed.items()}
            # Rules that match in the same states are one kind; the kinds of all types are numbered apart.
            kinds, kind_of = np.unique(np.packbits(hits, axis=1), axis=0, return_inverse=True)
            first = ELEMENT_TYPES.index(kind)
            matched = np.unpackbits(kinds, axis=1, count=len(above)).astype(bool)
            hit_kinds = [(np.flatnonzero(matched[:, i]) * len(ELEMENT_TYPES) + first).tolist() for i in range(len(above))]
            of_rules = [{"pos": rule["pos"], "kind": int(j) * len(ELEMENT_TYPES) + first} for rule, j in zip(rules, kind_of.reshape(-1))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(above)), *(pa.array(x) for x in start), pa.array(above, pa.int32()), pa.array(new["alt"], pa.string()),
                 pa.array(new["level"], pa.int32()), pa.array(new["scope"], pa.string()), pa.array(removed),
                 pa.array(hit_kinds, pa.list_(pa.int32())),
                 pa.array([of_rules] + [None] * (len(above) - 1), pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.int32())])))],
                names=["__type", *STATE, "new_alt", "new_level", "new_scope", "new_removed", "matched", "kinds"])


def compile_rules(rule: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, rules): what the rules of ``valid_rules`` make of an element, by its type and state.

    A rule asks for the type of an element and for one of four conditions, and what a rule changes can only change two
    of the answers.  So the rules of a type, in version order, are a machine over few states: whether alt is blank and
    whether the level skips one, with what no rule changes: empty headers, empty content and the level above as far as it
    matters.  ``outcomes`` has one row per type and start state (__type, the columns of ``STATE``, new_alt, new_level and new_scope:
    the values of the last rules that set them, null if none did, new_removed, matched: the kinds of rules that matched);
    ``rules`` (__id, __kind) has a row per rule.  Rules that match in the same states are of one kind, and with so few states
    there are few kinds however many rules there are.
    """
    number = "CASE WHEN trim(r.value) rlike '^[+-]?[0-9]{1,9}$' THEN CAST(trim(r.value) AS INT) END"
    ordered = rule.agg(F.array_sort(F.collect_list(F.struct(
        "version", "id", "rule_type", "condition", F.col("action.type").alias("act"),
        F.coalesce(F.col("action.value"), F.lit("")).alias("value")))).alias("rules"))
    placed = ordered.selectExpr("posexplode(rules) AS (pos, r)").selectExpr(
        "r.rule_type", f"""struct(pos, r.condition AS condition, r.act AS act, r.value AS value, {number} AS number,
        {q_blank('r.value')} AS blank) AS rule""")
    by_type = placed.groupBy("rule_type").agg(F.array_sort(F.collect_list("rule")).alias("rules"))
    outcome = by_type.mapInArrow(_walked, """__type string, no_alt boolean, skip_level boolean, missing_headers boolean, empty boolean,
        above int, new_alt string, new_level int, new_scope string, new_removed boolean, matched array<int>, kinds array<struct<pos: int, kind: int>>""")
    named = ordered.selectExpr("posexplode(rules) AS (pos, r)").selectExpr("pos", "r.id AS __id")
    kinds = outcome.selectExpr("inline(kinds)").withColumnRenamed("kind", "__kind")
    return outcome.drop("kinds"), named.join(kinds, "pos").select("__id", "__kind")


def _with_outcome(element: DataFrame, outcome: DataFrame, hint: bool = False) -> DataFrame:
    """Elements, or counts of elements, with the outcome of their type and state; null where no rule has the type."""
    same = [F.col("type") == F.col("__type"), *[F.col(f"__{c}") == F.col(c) for c in STATE]]
    return element.join(F.broadcast(outcome) if hint else outcome, reduce(and_, same), "left")


def _in_state(element: DataFrame) -> DataFrame:
    return element.selectExpr("*", *[f"{e} AS __{c}" for c, e in _state().items()])


def apply_rules(element: DataFrame, rule: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, log) after the rules of ``valid_rules``, in version order; later rules see the changes of earlier ones.

    Elements look their outcome up by type and state, so a rule costs nothing per element.  At most 112 outcomes per element type
    are broadcast, each with three values.  Unknown actions and heading levels outside 1 to 6 change
    nothing.  The log has a row per rule and element with what the rule matched.
    """
    outcome, ids = compile_rules(rule)
    done = _with_outcome(_in_state(element), outcome.drop("matched"), hint=True)
    changed = [f"coalesce(new_{c}, {c}) AS {c}" if c in ("alt", "level", "scope") else
               "removed OR coalesce(new_removed, false) AS removed" if c == "removed" else c for c in element.columns]
    met = _with_outcome(_in_state(element.select("doc_id", "seq", "type", "alt", "level", "prev_level", "headers", "content")), outcome)
    log = met.crossJoin(F.broadcast(ids)).selectExpr(
        "doc_id", "seq", "__id AS rule_id", "coalesce(array_contains(matched, __kind), false) AS matched")
    return done.selectExpr(*changed), log


def execution_counts(element: DataFrame, rule: DataFrame) -> DataFrame:
    """(doc_id, rule_id, n, matched): the log of ``apply_rules`` counted per document and rule.

    Elements are counted by document, type and state first, and what matched by kind of rule; only the finished rows
    are one per document and rule.  A document gathers one entry per state its elements are in.

    The rows of a task come block by block of rules, and in a block document by document: so the rules of neighbouring rows
    repeat, and documents and counts stand in runs, as columnar files store well.  Documents are dealt out evenly, since
    few rows become many, and every task reads the blocks once, over its own documents.
    """
    outcome, ids = compile_rules(rule)
    parts = int(element.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = [f"__{c}" for c in STATE]
    count = _in_state(element).groupBy("doc_id", "type", *state).agg(F.count(F.lit(1)).alias("elements"))
    met = _with_outcome(count, outcome).repartition(parts, "doc_id").groupBy("doc_id").agg(
        F.sum("elements").alias("n"), F.collect_list(F.struct("elements", "matched")).alias("states"))
    top = "coalesce(array_max(flatten(transform(states, e -> coalesce(e.matched, array())))), 0)"
    hits = met.selectExpr("doc_id", "n", f"""transform(sequence(0, {top}), k -> aggregate(states, 0L, (s, e) ->
        s + CASE WHEN array_contains(e.matched, k) THEN e.elements ELSE 0L END)) AS hits""")
    # The hint keeps the blocks outside and the documents inside; one partition of blocks is one pass over the documents.
    return _blocks(ids).repartition(1).hint("shuffle_replicate_nl").crossJoin(hits).select(
        "doc_id", "n", "hits", F.inline("rules")).selectExpr(
        "doc_id", "__id AS rule_id", "n", "coalesce(get(hits, __kind), 0L) AS matched")


def _blocks(ids: DataFrame) -> DataFrame:
    """(rules): the rules in blocks of ``BLOCK_RULES``, those of a kind next to each other."""
    ordered = ids.agg(F.sort_array(F.collect_list(F.struct("__kind", "__id"))).alias("rules"))
    return ordered.selectExpr(f"""explode(transform(sequence(0, greatest(size(rules) - 1, 0), {BLOCK_RULES}),
        i -> slice(rules, i + 1, {BLOCK_RULES}))) AS rules""")


def promotable(rule: DataFrame) -> DataFrame:
    """Candidates confirmed on enough documents become active."""
    ready = f"status = 'candidate' AND coalesce(size(validated_on_docs), 0) >= {MIN_DOCUMENTS} AND confidence >= {MIN_CONFIDENCE}"
    return rule.withColumn("new_status", F.expr(f"CASE WHEN {ready} THEN 'active' ELSE status END"))


def list_rules(rule: DataFrame, status: str = "active") -> DataFrame:
    return rule.filter(F.col("status") == status).orderBy(F.col("confidence").desc(), "id")


def update_status(rule: DataFrame, change: DataFrame) -> DataFrame:
    """Latest valid status change per rule wins."""
    allowed = change.filter("new_status IN ('candidate', 'active', 'retired')")
    latest = allowed.groupBy("id").agg(F.expr("max_by(new_status, struct(ts, new_status)) AS new_status"))
    return rule.join(latest, "id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")
