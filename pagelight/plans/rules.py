"""Rules engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelight.functions import scan
from pagelight.operators import rules as R
from pagelight.plans.registry import query
from pagelight.sources import seeded

_RULE = """ru AS (SELECT 'r' || s_suppkey AS id, CASE s_suppkey % 9 WHEN 0 THEN 'table:missing_headers' WHEN 1 THEN 'image:no_alt' WHEN 2 THEN 'heading:skip_level'
 WHEN 3 THEN 'paragraph:empty' WHEN 4 THEN 'nocolon' WHEN 5 THEN 'widget:empty' WHEN 6 THEN 'table:unknown' WHEN 7 THEN 'link:empty' ELSE 'heading:empty' END AS trigger_pattern,
 CASE s_suppkey % 5 WHEN 0 THEN 'add_scope' WHEN 1 THEN 'set_alt' WHEN 2 THEN 'remove_element' WHEN 3 THEN 'set_heading' END AS action_type, CAST(s_suppkey % 8 AS VARCHAR) AS action_value,
 0.5 + (s_suppkey * 7 % 50) / 100.0 AS confidence, CAST(s_suppkey % 11 AS INT) AS version, CASE s_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'candidate' ELSE 'retired' END AS status,
 s_suppkey % 5 AS n_docs FROM supplier),
va AS (SELECT * FROM ru WHERE contains(trigger_pattern, ':') AND split_part(trigger_pattern, ':', 1) IN ('table', 'image', 'heading', 'paragraph', 'link', 'form_field')
 AND split_part(trigger_pattern, ':', 2) IN ('missing_headers', 'no_alt', 'skip_level', 'empty') AND action_type IS NOT NULL AND confidence >= 0.7)"""


def _rules(spark, sf_dir):
    return seeded.read_table(spark, sf_dir, "supplier").selectExpr(
        "concat('r', s_suppkey) AS id",
        """CASE s_suppkey % 9 WHEN 0 THEN 'table:missing_headers' WHEN 1 THEN 'image:no_alt' WHEN 2 THEN 'heading:skip_level'
         WHEN 3 THEN 'paragraph:empty' WHEN 4 THEN 'nocolon' WHEN 5 THEN 'widget:empty' WHEN 6 THEN 'table:unknown'
         WHEN 7 THEN 'link:empty' ELSE 'heading:empty' END AS trigger_pattern""",
        """named_struct('type', CASE s_suppkey % 5 WHEN 0 THEN 'add_scope' WHEN 1 THEN 'set_alt' WHEN 2 THEN 'remove_element'
         WHEN 3 THEN 'set_heading' END, 'value', CAST(s_suppkey % 8 AS STRING)) AS action""",
        "CAST(0.5 + (s_suppkey * 7 % 50) / 100.0 AS DOUBLE) AS confidence", "CAST(s_suppkey % 11 AS INT) AS version",
        "CASE s_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'candidate' ELSE 'retired' END AS status",
        "CASE WHEN s_suppkey % 5 = 0 THEN CAST(array() AS array<string>) ELSE transform(sequence(1, CAST(s_suppkey % 5 AS INT)), i -> concat('d', i)) END AS validated_on_docs",
    )


@query("valid_rules", f"WITH {_RULE} SELECT id, trigger_pattern, version FROM va")
def valid_rules(spark, sf_dir):
    return R.valid_rules(_rules(spark, sf_dir)).select("id", "trigger_pattern", "version")


_EL = seeded.SQL_CORPUS + f""", {_RULE}, hp AS (SELECT doc_id, seq, lag(level) OVER (PARTITION BY doc_id ORDER BY seq) AS pl FROM block WHERE block_type = 'heading'),
em AS (SELECT b.doc_id, b.seq, b.block_type AS type, b.content, b.alt, b.headers, b.level, hp.pl FROM block b LEFT JOIN hp ON hp.doc_id = b.doc_id AND hp.seq = b.seq)"""


def _elements(spark, sf_dir):
    """Only headings know the heading above, so only headings are scanned; all other rows stay where they are read."""
    block = seeded.blocks(spark, sf_dir).selectExpr(
        "doc_id", "seq", "block_type AS type", "content", "alt", "headers", "level")
    heads = scan.running(block.filter("type = 'heading'"), ["doc_id"], ["seq"], {"prev_level": scan.previous(F.col("level"))})
    rest = block.filter("NOT type <=> 'heading'").withColumn("prev_level", F.lit(None).cast("int"))
    return heads.unionByName(rest).selectExpr("*", "CAST(NULL AS STRING) AS scope", "false AS removed")


@query("rule_pattern_match", _EL + """SELECT doc_id, seq, id FROM em JOIN va ON type = split_part(trigger_pattern, ':', 1) WHERE CASE split_part(trigger_pattern, ':', 2)
 WHEN 'missing_headers' THEN type = 'table' AND coalesce(len(headers), 0) = 0 WHEN 'no_alt' THEN trim(coalesce(alt, '')) = ''
 WHEN 'skip_level' THEN coalesce(level - pl > 1, false) ELSE trim(coalesce(content, '')) = '' END""")
def rule_pattern_match(spark, sf_dir):
    rules = R.valid_rules(_rules(spark, sf_dir)).select("id", "rule_type", "condition")
    return R.match_rules(_elements(spark, sf_dir), rules).select("doc_id", "seq", "id")


# The rules walk over each element one after the other, as (version, id) order says; ``l`` holds what they made of it.
_WALK = _EL.replace("WITH ", "WITH RECURSIVE ", 1) + """, vo AS (SELECT *, row_number() OVER (ORDER BY version, id) AS k,
  split_part(trigger_pattern, ':', 1) AS rt, split_part(trigger_pattern, ':', 2) AS rc FROM va),
wk AS (SELECT doc_id, seq, type, content, headers, pl, CAST(0 AS BIGINT) AS k, alt, level, CAST(NULL AS VARCHAR) AS scope, false AS removed, CAST(NULL AS VARCHAR) AS rule_id, false AS hit FROM em
 UNION ALL SELECT doc_id, seq, type, content, headers, pl, k, CASE WHEN h AND action_type = 'set_alt' THEN action_value ELSE alt END,
  CASE WHEN h AND action_type = 'set_heading' AND CAST(action_value AS INT) BETWEEN 1 AND 6 THEN CAST(action_value AS INT) ELSE level END,
  CASE WHEN h AND action_type = 'add_scope' THEN action_value ELSE scope END, removed OR (h AND action_type = 'remove_element'), id, h
 FROM (SELECT wk.*, vo.k AS k2, vo.id, vo.action_type, vo.action_value, type = rt AND CASE rc WHEN 'missing_headers' THEN type = 'table' AND coalesce(len(headers), 0) = 0
   WHEN 'no_alt' THEN trim(coalesce(alt, '')) = '' WHEN 'skip_level' THEN coalesce(level - pl > 1, false) ELSE trim(coalesce(content, '')) = '' END AS h
   FROM wk JOIN vo ON vo.k = wk.k + 1) x (doc_id, seq, type, content, headers, pl, k0, alt, level, scope, removed, r0, h0, k, id, action_type, action_value, h))
"""


@query("apply_rules", _WALK + "SELECT doc_id, seq, alt, level, scope, removed FROM wk WHERE k = (SELECT count(*) FROM vo)")
def apply_rules(spark, sf_dir):
    done, _ = R.apply_rules(_elements(spark, sf_dir), R.valid_rules(_rules(spark, sf_dir)))
    return done.select("doc_id", "seq", "alt", "level", "scope", "removed")


@query("rule_execution_log", _WALK + "SELECT doc_id, rule_id, count(*) AS n, count(*) FILTER (hit) AS matched FROM wk WHERE k > 0 GROUP BY ALL")
def rule_execution_log(spark, sf_dir):
    return R.execution_counts(_elements(spark, sf_dir), R.valid_rules(_rules(spark, sf_dir)))


@query("rule_promotion", f"""WITH {_RULE} SELECT id, status, CASE WHEN status = 'candidate' AND n_docs >= 3 AND confidence >= 0.7 THEN 'active' ELSE status END AS new_status FROM ru""")
def rule_promotion(spark, sf_dir):
    return R.promotable(_rules(spark, sf_dir)).select("id", "status", "new_status")


@query("list_active_rules", f"WITH {_RULE} SELECT id, CAST(confidence AS DOUBLE) AS confidence FROM ru WHERE status = 'active'")
def list_active_rules(spark, sf_dir):
    return R.list_rules(_rules(spark, sf_dir)).select("id", "confidence")


@query("rule_status_update", f"""WITH {_RULE}, ch AS (SELECT 'r' || l_suppkey AS id, CASE l_linenumber % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'active' WHEN 2 THEN 'retired' ELSE 'odd' END AS s,
 l_shipdate AS ts FROM lineitem), la AS (SELECT id, arg_max(s, (ts, s)) AS s FROM ch WHERE s <> 'odd' GROUP BY 1)
SELECT ru.id, coalesce(la.s, ru.status) AS status FROM ru LEFT JOIN la USING (id)""")
def rule_status_update(spark, sf_dir):
    change = seeded.read_table(spark, sf_dir, "lineitem").selectExpr(
        "concat('r', l_suppkey) AS id", "l_shipdate AS ts",
        "CASE l_linenumber % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'active' WHEN 2 THEN 'retired' ELSE 'odd' END AS new_status")
    return R.update_status(_rules(spark, sf_dir), change).select("id", "status")
