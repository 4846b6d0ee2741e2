"""Duplicates, identifiers and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelight.operators import checks, dedupe as D
from pagelight.plans.registry import query
from pagelight.sources import seeded

SQL = seeded.SQL_CORPUS
_COPIES = """, bl AS (SELECT doc_id, seq, page_num, block_type, content, headers, rows FROM block UNION ALL
 SELECT doc_id, seq + 100000, page_num, block_type, '  ' || content, headers, rows FROM block WHERE block_type = 'table' AND seq % 2 = 0)"""


def _with_copies(spark, sf_dir):
    block = seeded.blocks(spark, sf_dir).select("doc_id", "seq", "page_num", "block_type", "content", "headers", "rows")
    copies = block.filter("block_type = 'table' AND seq % 2 = 0").selectExpr(
        "doc_id", "seq + 100000 AS seq", "page_num", "block_type", "concat('  ', content) AS content", "headers",
        "rows")
    return block.unionByName(copies)


_SIG = r""", sg AS (SELECT doc_id, seq, page_num, trim(regexp_replace(lower(concat_ws(' ', content, CASE WHEN len(headers) > 0
 THEN array_to_string(headers, ' | ') END, coalesce(array_to_string(list_transform(rows, lambda r: array_to_string(r, ' | ')), ' '), ''))),
 '\s+', ' ', 'g')) AS sig FROM bl WHERE block_type = 'table')"""


@query("duplicate_tables_in_page", SQL + _COPIES + _SIG + """SELECT doc_id, seq, f AS first_seq FROM (SELECT *, min(seq) OVER
 (PARTITION BY doc_id, page_num, sig) AS f FROM sg) WHERE seq > f""")
def duplicate_tables_in_page(spark, sf_dir):
    return D.duplicate_tables(_with_copies(spark, sf_dir))


@query("blocks_without_duplicate_tables", SQL + _COPIES + _SIG + """SELECT doc_id, seq, block_type FROM bl WHERE (doc_id, seq) NOT IN
 (SELECT (doc_id, seq) FROM (SELECT *, min(seq) OVER (PARTITION BY doc_id, page_num, sig) AS f FROM sg) WHERE seq > f)""")
def blocks_without_duplicate_tables(spark, sf_dir):
    return D.drop_duplicate_tables(_with_copies(spark, sf_dir)).select("doc_id", "seq", "block_type")


@query("running_headers_and_footers", SQL + r""", sh AS (SELECT doc_id, seq, regexp_replace(upper(trim(content)), '\s+', ' ', 'g') AS norm,
 round_even(y1 / 792.0 / 0.05, 0) AS band FROM block WHERE block_type IN ('paragraph', 'heading') AND NOT (y1 = 0 AND y2 = 0)),
kn AS (SELECT *, count(*) OVER (PARTITION BY doc_id, norm, band) AS n FROM sh WHERE norm <> '' AND length(norm) <= 40)
SELECT doc_id, seq, norm, n FROM kn WHERE n >= 3""")
def running_headers_and_footers(spark, sf_dir):
    corpus = seeded.corpus(spark, sf_dir)
    return D.running_artifacts(corpus.block, corpus.page)


@query("duplicate_block_ids", SQL + "SELECT doc_id, block_id, count(*) AS uses, min(seq) AS first_seq FROM block GROUP BY ALL HAVING count(*) > 1")
def duplicate_block_ids(spark, sf_dir):
    return checks.duplicate_ids(seeded.blocks(spark, sf_dir))


_PLAN = """lg AS (SELECT o_orderkey AS doc_id, CAST(o_orderkey % 900 AS INT) AS page_count FROM orders),
pl AS (SELECT doc_id, CAST(i AS INT) AS chunk, CAST(i * 248 AS INT) AS start_page, page_count FROM (SELECT *, unnest(range(0,
  CAST(ceil(page_count / 248) AS BIGINT))) AS i FROM lg WHERE page_count > 250)),
pl1 AS (SELECT *, least(start_page + 250, page_count) AS split_page, CASE WHEN start_page = 0 THEN 0 ELSE 2 END AS overlap_start,
  CASE WHEN start_page + 248 >= page_count THEN 0 ELSE 2 END AS overlap_end FROM pl)"""


def _long(spark, sf_dir):
    return seeded.read_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS doc_id", "CAST(o_orderkey % 900 AS INT) AS page_count")


@query("chunk_boundary_plan", f"WITH {_PLAN} SELECT doc_id, chunk, start_page, split_page, page_count, overlap_start, overlap_end FROM pl1")
def chunk_boundary_plan(spark, sf_dir):
    return D.chunk_plan(_long(spark, sf_dir))


@query("chunk_boundary_shift", f"""WITH {_PLAN}, pb AS (SELECT doc_id, split_page, page_count, chunk, start_page, overlap_end,
 CASE WHEN split_page < page_count AND (doc_id * 7 + split_page) % 3 <> 0 THEN split_page
  WHEN split_page < page_count AND split_page + 1 < page_count AND (doc_id * 7 + split_page + 1) % 3 <> 0 THEN split_page + 1
  ELSE split_page END AS s FROM pl1)
SELECT doc_id, chunk, start_page, least(s + overlap_end, page_count) AS end_page FROM pb""")
def chunk_boundary_shift(spark, sf_dir):
    docs = _long(spark, sf_dir)
    plan = D.chunk_plan(docs)
    page_bytes = docs.filter("page_count > 250").selectExpr(
        "doc_id", "explode(sequence(0, page_count - 1)) AS page_num").selectExpr(
        "doc_id", "page_num", "CASE WHEN (doc_id * 7 + page_num) % 3 = 0 THEN 100 ELSE 900 END AS n_bytes")
    return D.shift_boundaries(plan, page_bytes)


_CHUNKED = seeded.SQL_ELEMENT + """, ck AS (SELECT doc_id, 0 AS chunk, 0 AS start_page, seq, Page AS page, Path, Text FROM el
  UNION ALL SELECT doc_id, 1, 1, seq + 1000, Page - 1, Path, Text FROM el WHERE Page >= 1 AND seq % 3 <> 0)"""


@query("chunk_overlap_dedupe", _CHUNKED + """SELECT doc_id, chunk, seq, page, path, text FROM (SELECT doc_id, chunk, seq, page + start_page AS page,
 Path AS path, Text AS text, row_number() OVER (PARTITION BY doc_id, page + start_page, trim(Text), Path ORDER BY chunk, seq) AS k FROM ck) WHERE k = 1""")
def chunk_overlap_dedupe(spark, sf_dir):
    el = seeded.elements(spark, sf_dir).selectExpr(
        "doc_id", "seq", "Page", "Path", "Text", "CAST(array() AS array<string>) AS filePaths")
    first = el.withColumn("chunk", F.lit(0))
    second = el.filter("Page >= 1 AND seq % 3 <> 0").selectExpr(
        "doc_id", "seq + 1000 AS seq", "Page - 1 AS Page", "Path", "Text", "filePaths", "1 AS chunk")
    chunk = seeded.read_table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "inline(array(named_struct('chunk', 0, 'start_page', 0), named_struct('chunk', 1, 'start_page', 1)))")
    return D.merge_chunks(first.unionByName(second), chunk).selectExpr(
        "doc_id", "chunk", "seq", "page", "Path AS path", "Text AS text")


_VIOLATION = """vi AS (SELECT page_id AS doc_id, CAST(k AS INT) AS seq, CASE (page_id + k) % 9 WHEN 0 THEN 'Table 1 has no caption' WHEN 1 THEN 'Missing scope on header'
 WHEN 2 THEN 'Skip link not found' WHEN 3 THEN 'No <main> element' WHEN 4 THEN 'Heading jumps' WHEN 5 THEN 'Image missing alt' WHEN 6
 THEN 'Placeholder alt text' WHEN 7 THEN 'Empty src' ELSE 'Table 2 has no caption' END AS description, CASE WHEN k % 2 = 0 THEN 'serious'
 ELSE 'moderate' END AS severity FROM pages, range(0, 12) t(k))"""


@query("distinct_proposal_descriptions", f"""WITH {_VIOLATION}, fi AS (SELECT doc_id, description, min(seq) AS seq, arg_min(severity, seq) AS severity FROM vi GROUP BY ALL),
ca AS (SELECT *, CASE WHEN contains(description, 'caption') THEN 'table_caption' WHEN contains(description, 'scope') THEN 'table_headers'
 WHEN contains(description, 'Skip') THEN 'skip_navigation' WHEN contains(description, '<main') THEN 'landmark' WHEN contains(description, 'Heading')
 THEN 'heading_hierarchy' WHEN contains(description, 'Placeholder') THEN 'placeholder_alt_text' ELSE 'missing_image_src' END AS category
 FROM fi WHERE description <> 'Image missing alt')
SELECT doc_id, concat('str_', category, '_', row_number() OVER (PARTITION BY doc_id, category ORDER BY seq) - 1) AS proposal_id, category,
 description, severity, category <> 'placeholder_alt_text' AS auto_fixable FROM ca""")
def distinct_proposal_descriptions(spark, sf_dir):
    pages = seeded.read_table(spark, sf_dir, "pages").selectExpr("page_id AS doc_id", "explode(sequence(0, 11)) AS seq")
    texts = ["Table 1 has no caption", "Missing scope on header", "Skip link not found", "No <main> element", "Heading jumps",
             "Image missing alt", "Placeholder alt text", "Empty src", "Table 2 has no caption"]
    array = ", ".join(f"'{t}'" for t in texts)
    rows = pages.selectExpr(
        "doc_id", "seq", f"element_at(array({array}), CAST((doc_id + seq) % 9 AS INT) + 1) AS description",
        "CASE WHEN seq % 2 = 0 THEN 'serious' ELSE 'moderate' END AS severity")
    return D.distinct_descriptions(rows)


@query("append_unique_documents", """WITH ru AS (SELECT s_suppkey AS rule_id, [s_suppkey % 7, 3] AS docs FROM supplier),
ad AS (SELECT DISTINCT l_suppkey AS rule_id, l_partkey % 11 AS d FROM lineitem)
SELECT rule_id, array_to_string(list_sort(list_distinct(list_concat(docs, coalesce(a, [])))), ',') AS docs FROM ru LEFT JOIN
 (SELECT rule_id, list(d) AS a FROM ad GROUP BY 1) USING (rule_id)""")
def append_unique_documents(spark, sf_dir):
    rule = seeded.read_table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS rule_id", "array(s_suppkey % 7, 3L) AS docs")
    add = seeded.read_table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS rule_id", "l_partkey % 11 AS doc_id")
    return D.append_unique(rule, add).selectExpr("rule_id", "array_join(docs, ',') AS docs")


@query("append_unique_members", """WITH ru AS (SELECT s_suppkey AS rule_id, unnest([s_suppkey % 7, 3]) AS doc_id FROM supplier),
ad AS (SELECT DISTINCT l_suppkey AS rule_id, l_partkey % 11 AS doc_id FROM lineitem)
SELECT * FROM ru UNION ALL SELECT * FROM ad WHERE NOT EXISTS (FROM ru WHERE ru.rule_id = ad.rule_id AND ru.doc_id = ad.doc_id)""")
def append_unique_members(spark, sf_dir):
    member = seeded.read_table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS rule_id", "explode(array(s_suppkey % 7, 3L)) AS doc_id")
    add = seeded.read_table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS rule_id", "l_partkey % 11 AS doc_id")
    return D.append_members(member, add)


@query("image_id_assignment", SQL + """SELECT doc_id, seq, concat('img_p', page_num, '_i', row_number() OVER (PARTITION BY doc_id, page_num
 ORDER BY seq) - 1) AS image_id FROM block WHERE block_type = 'image' AND starts_with(src, 'data:')""")
def image_id_assignment(spark, sf_dir):
    return D.image_ids(seeded.blocks(spark, sf_dir))
