"""Ordered operators over blocks and the context of images."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelight.operators import ordered as O
from pagelight.plans.registry import query
from pagelight.sources import seeded

SQL = seeded.SQL_CORPUS


def _corpus(spark, sf_dir):
    return seeded.corpus(spark, sf_dir)


_HEADS = """, hd AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS p FROM block
 WHERE block_type = 'heading' AND level IS NOT NULL)"""
# The sequential rule, written as a recursion over headings.
_CLAMP = """, RECURSE AS (SELECT 1)"""


def _clamp_sql(source, level):
    return f"""walk AS (SELECT doc_id, p, {level} AS lv FROM {source} WHERE p = 1 UNION ALL
 SELECT s.doc_id, s.p, CASE WHEN s.{level} > w.lv + 1 THEN w.lv + 1 ELSE s.{level} END
 FROM walk w JOIN {source} s ON s.doc_id = w.doc_id AND s.p = w.p + 1)"""


@query("smooth_heading_sequence", SQL.replace("WITH ", "WITH RECURSIVE ", 1) + _HEADS + ", " + _clamp_sql("hd", "level") + """
SELECT hd.doc_id, hd.seq, hd.level, walk.lv AS smoothed FROM hd JOIN walk USING (doc_id, p)""")
def smooth_heading_sequence(spark, sf_dir):
    return O.smooth_levels(_corpus(spark, sf_dir).block).select("doc_id", "seq", "level", "smoothed")


@query("enforce_heading_hierarchy", SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
e0 AS (SELECT doc_id, seq, block_type, content, coalesce(level, 1) AS level, bool_and(block_type = 'heading'
  AND coalesce(level, 1) = 1) OVER (PARTITION BY doc_id ORDER BY seq) AS lead_run FROM block),
e1 AS (SELECT doc_id, min(seq) AS seq, string_agg(content, ' -- ' ORDER BY seq) AS title FROM e0 WHERE lead_run GROUP BY doc_id),
e2 AS (SELECT e0.doc_id, e0.seq, coalesce(e1.title, content) AS content, level FROM e0 LEFT JOIN e1
  ON e0.doc_id = e1.doc_id AND e0.seq = e1.seq WHERE block_type = 'heading' AND (NOT lead_run OR title IS NOT NULL)),
e3 AS (SELECT *, CASE WHEN level = 1 AND count(*) FILTER (level = 1) OVER (PARTITION BY doc_id ORDER BY seq) > 1 THEN 2
  ELSE level END AS l2, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS p FROM e2), """ + _clamp_sql("e3", "l2") + """,
e4 AS (SELECT e3.doc_id, e3.seq, e3.content, walk.lv FROM e3 JOIN walk USING (doc_id, p))
SELECT doc_id, seq, content, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY lv), 6) AS level FROM e4""")
def enforce_heading_hierarchy(spark, sf_dir):
    return O.enforce_hierarchy(_corpus(spark, sf_dir).block).select("doc_id", "seq", "content", "level")


@query("heading_skip_detection", SQL + """, l AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY seq) AS prev_level
 FROM block WHERE block_type = 'heading' AND level IS NOT NULL)
SELECT doc_id, seq, block_id, level, prev_level FROM l WHERE level > prev_level + 1""")
def heading_skip_detection(spark, sf_dir):
    return O.heading_skip_pairs(_corpus(spark, sf_dir).block)


_READ = """, pg AS (SELECT doc_id, page_num FROM block GROUP BY ALL HAVING count(*) >= 2 AND bool_or(y1 > 0 OR x1 > 0)),
rd AS (SELECT b.*, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY round_even(y1 / 5, 0) * 5, x1, seq) AS new_pos,
 row_number() OVER (PARTITION BY doc_id, page_num ORDER BY seq) AS old_pos FROM block b SEMI JOIN pg USING (doc_id, page_num))"""


@query("reading_order_sort", SQL + _READ + "SELECT doc_id, page_num, seq, new_pos, old_pos FROM rd")
def reading_order_sort(spark, sf_dir):
    order, _ = O.reading_order(_corpus(spark, sf_dir).block)
    return order.select("doc_id", "page_num", "seq", "new_pos", "old_pos")


@query("reading_order_fixes", SQL + _READ + """SELECT a.doc_id, a.page_num, count(*) AS blocks_reordered FROM rd a JOIN rd b
 ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND a.old_pos = b.new_pos WHERE a.block_id <> b.block_id GROUP BY ALL""")
def reading_order_fixes(spark, sf_dir):
    return O.reading_order(_corpus(spark, sf_dir).block)[1]


@query("sequential_order", SQL + """, s AS (SELECT *, lag(page_num) OVER w AS pp, lag(y1) OVER w AS py FROM block
 WINDOW w AS (PARTITION BY doc_id ORDER BY seq))
SELECT doc_id, NOT coalesce(bool_or(page_num < pp OR (page_num = pp AND y1 < py - 20)), false) AS sequential FROM s GROUP BY 1""")
def sequential_order(spark, sf_dir):
    from pagelight.operators.checks import sequential_order as run

    return run(_corpus(spark, sf_dir).block)


@query("short_paragraph_runs", SQL + """, pa AS (SELECT doc_id, seq, length(content) < 60 AS s,
  row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS o FROM block WHERE block_type = 'paragraph'),
g AS (SELECT *, o - row_number() OVER (PARTITION BY doc_id, s ORDER BY seq) AS isl FROM pa),
r AS (SELECT doc_id, s, count(*) AS n FROM g GROUP BY doc_id, s, isl)
SELECT doc_id, coalesce(max(n) FILTER (s), 0) AS longest FROM r GROUP BY doc_id""")
def short_paragraph_runs(spark, sf_dir):
    from pagelight.functions import scan

    paras = _corpus(spark, sf_dir).block.filter("block_type = 'paragraph'").selectExpr(
        "doc_id", "seq", "length(content) AS n_chars")
    return O.short_runs(scan.renumber(paras, ["doc_id"], ["seq"], "ord"))


_ANCHOR = r""", an0 AS (SELECT doc_id, seq, level, content, substr('sec-' || coalesce(nullif(trim(regexp_replace(replace(
  lower(trim(content)), ' ', '-'), '[^a-z0-9\-]', '', 'g'), '-'), ''), 'section'), 1, 50) AS base
  FROM block WHERE block_type = 'heading'),
an AS (SELECT *, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS anchor FROM (SELECT *, row_number() OVER
  (PARTITION BY doc_id, base ORDER BY seq) AS n FROM an0))"""


def _heads(spark, sf_dir):
    return _corpus(spark, sf_dir).block.filter("block_type = 'heading'").select("doc_id", "seq", "level", "content")


@query("anchor_ids", SQL + _ANCHOR + "SELECT doc_id, seq, anchor FROM an")
def anchor_ids(spark, sf_dir):
    return O.anchors(_heads(spark, sf_dir)).select("doc_id", "seq", "anchor")


@query("table_of_contents", SQL + _ANCHOR + r""", tc AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM an
 WHERE level >= 2 AND NOT regexp_matches(content, '(?i)^\s*(table\s+of\s+contents|contents)\s*$'))
SELECT doc_id, seq, level, anchor, CASE WHEN level > 2 THEN max(CASE WHEN level = 2 THEN seq END) OVER
 (PARTITION BY doc_id ORDER BY seq) END AS parent_seq FROM tc WHERE k >= 3""")
def table_of_contents(spark, sf_dir):
    return O.contents_table(_heads(spark, sf_dir)).drop("content")


@query("table_grid_normalization", SQL + r""", gr0 AS (SELECT doc_id, seq, coalesce(headers, []) AS headers, coalesce(rows, []) AS rows
  FROM block WHERE block_type = 'table'),
gr1 AS (SELECT *, greatest(len(headers), coalesce(list_max(list_transform(rows, lambda r: len(r))), 0), 1) AS n_cols,
  CASE WHEN len(headers) > 0 THEN list_prepend(headers, rows) ELSE rows END AS grid, len(headers) > 0 AS hh FROM gr0),
gr2 AS (SELECT *, unnest(range(1, len(grid) + 1)) AS i FROM gr1),
gr3 AS (SELECT *, grid[i] AS cells, unnest(range(1, len(grid[i]) + 1)) AS j FROM gr2)
SELECT doc_id, seq, i - 1 AS row_no, j - 1 AS col_no, cells[j] AS cell, hh AND i = 1 AS is_header,
 CASE WHEN j = len(cells) THEN n_cols - len(cells) + 1 ELSE 1 END AS colspan,
 (i > 1 OR NOT hh) AND j = 1 AND len(cells) >= 2 AND trim(cells[j]) <> '' AND NOT regexp_matches(trim(cells[j]),
  '^[\s$€£]*([\d,]+\.?\d*)\s*%?\s*$') AS row_header FROM gr3""")
def table_grid_normalization(spark, sf_dir):
    return O.table_grid(_corpus(spark, sf_dir).block)


@query("row_header_cells", SQL + r""", c AS (SELECT doc_id, seq, unnest(flatten(rows)) AS cell FROM block WHERE block_type = 'table')
SELECT doc_id, cell, count(*) AS n FROM c WHERE trim(cell) <> '' AND NOT regexp_matches(trim(cell),
 '^[\s$€£]*([\d,]+\.?\d*)\s*%?\s*$') GROUP BY ALL""")
def row_header_cells(spark, sf_dir):
    cells = _corpus(spark, sf_dir).block.filter("block_type = 'table'").selectExpr("doc_id", "explode(flatten(rows)) AS cell")
    return cells.filter(O.ROW_HEADER_CELL).groupBy("doc_id", "cell").agg(F.expr("count(*) AS n"))


def _esc(x):
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), "
            "'''', '&#x27;')")


_FRAG = _ANCHOR + f""", fr AS (SELECT b.doc_id, b.seq, CASE block_type
 WHEN 'heading' THEN concat('<h', greatest(1, least(6, coalesce(b.level, 2))), ' id="', anchor, '">', {_esc('b.content')}, '</h', greatest(1, least(6, coalesce(b.level, 2))), '>')
 WHEN 'image' THEN concat('<figure><img src="', {_esc("coalesce(src, '')")}, '" alt="', {_esc("coalesce(alt, '')")}, '"></figure>')
 WHEN 'list' THEN concat(CASE WHEN ordered THEN '<ol>' ELSE '<ul>' END, coalesce(array_to_string(list_transform(items, lambda i: concat('<li>', {_esc('i')}, '</li>')), ''), ''), CASE WHEN ordered THEN '</ol>' ELSE '</ul>' END)
 WHEN 'table' THEN concat('<table>', CASE WHEN coalesce(caption, '') <> '' THEN concat('<caption>', {_esc('caption')}, '</caption>') ELSE '' END,
  CASE WHEN len(headers) > 0 THEN concat('<thead><tr>', array_to_string(list_transform(headers, lambda c, i: concat('<th scope="col"', CASE WHEN i = len(headers) AND i < b.nc THEN ' colspan="' || (b.nc - i + 1) || '"' ELSE '' END, '>', {_esc('c')}, '</th>')), ''), '</tr></thead>') ELSE '' END,
  CASE WHEN len(rows) > 0 THEN concat('<tbody>', array_to_string(list_transform(rows, lambda r: concat('<tr>', array_to_string(list_transform(r, lambda c, i: CASE WHEN i = 1 AND len(r) >= 2 AND trim(c) <> '' AND NOT regexp_matches(trim(c), '^[\\s$€£]*([\\d,]+\\.?\\d*)\\s*%?\\s*$')
   THEN concat('<th scope="row">', {_esc('c')}, '</th>') ELSE concat('<td', CASE WHEN i = len(r) AND i < b.nc THEN ' colspan="' || (b.nc - i + 1) || '"' ELSE '' END, '>', {_esc('c')}, '</td>') END), ''), '</tr>')), ''), '</tbody>') ELSE '' END, '</table>')
 ELSE concat('<p>', {_esc('b.content')}, '</p>') END AS html FROM (SELECT *, greatest(len(coalesce(headers, [])), coalesce(list_max(list_transform(rows, lambda r: len(r))), 0), 1) AS nc FROM block) b LEFT JOIN an ON an.doc_id = b.doc_id AND an.seq = b.seq)"""


@query("html_fragments", SQL + _FRAG + "SELECT doc_id, seq, html FROM fr")
def html_fragments(spark, sf_dir):
    return O.html_fragments(_corpus(spark, sf_dir).block)


@query("document_assembly", SQL + _FRAG + f""", tc AS (SELECT *, lag(level) OVER w AS lb, lead(level) OVER w AS la FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM an
 WHERE level >= 2 AND NOT regexp_matches(content, '(?i)^\\s*(table\\s+of\\s+contents|contents)\\s*$')) WHERE k >= 3 WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
ch AS (SELECT doc_id, min(seq) AS pos FROM an WHERE regexp_matches(content, '(?i)^\\s*(table\\s+of\\s+contents|contents)\\s*$') GROUP BY 1),
cl AS (SELECT doc_id, 2 AS part, seq AS item, concat(CASE WHEN level > 2 AND lb IS NULL THEN '<li><ol>' ELSE '' END, '<li><a href="#', anchor, '">', {_esc('trim(content)')}, '</a>',
  CASE WHEN level > 2 THEN '</li>' WHEN la > 2 THEN '<ol>' ELSE '</li>' END, CASE WHEN level > 2 AND coalesce(la, 2) = 2 THEN '</ol></li>' ELSE '' END) AS html FROM tc
 UNION ALL SELECT DISTINCT doc_id, 1, 0, '<nav aria-label="Table of Contents" id="toc"><h2>Contents</h2><ol>' FROM tc UNION ALL SELECT DISTINCT doc_id, 3, 0, '</ol></nav>' FROM tc)
SELECT doc_id, -2 AS seq, 0 AS part, 0 AS item, '<!DOCTYPE html><html lang="' || coalesce(nullif(language, ''), 'en') || '"><head><title>'
 || {_esc('coalesce(meta_title, filename)')} || '</title></head><body><a href="#main-content">Skip to main content</a><main id="main-content">' AS html FROM doc
UNION ALL SELECT doc_id, 2147483647, 0, 0, '</main></body></html>' FROM doc UNION ALL SELECT doc_id, seq, 0, 0, html FROM fr
UNION ALL SELECT doc_id, coalesce(pos, -1), part, item, html FROM cl LEFT JOIN ch USING (doc_id)""")
def document_assembly(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    return O.html_documents(corpus.block, corpus.doc)


_NEAR = "ordered2 AS (SELECT doc_id, seq, block_id, block_type, page_num, alt, src, trim(content) AS t FROM block)"


@query("surrounding_text", SQL + f""", {_NEAR}, im AS (SELECT * FROM ordered2 WHERE block_type = 'image'),
nb AS (SELECT i.doc_id, i.seq, o.seq AS s, o.t, row_number() OVER (PARTITION BY i.doc_id, i.seq, o.seq > i.seq
  ORDER BY abs(o.seq - i.seq)) AS k FROM im i JOIN ordered2 o ON o.doc_id = i.doc_id AND o.seq BETWEEN i.seq - 6 AND i.seq + 6
  AND o.seq <> i.seq AND o.block_type IN ('paragraph', 'heading') AND o.t <> '')
SELECT i.doc_id, i.seq, coalesce(string_agg(nb.t, ' ' ORDER BY s), '') AS nearby FROM im i LEFT JOIN nb
 ON nb.doc_id = i.doc_id AND nb.seq = i.seq AND k <= 3 GROUP BY ALL""")
def surrounding_text(spark, sf_dir):
    return O.image_context(_corpus(spark, sf_dir).block).select("doc_id", "seq", "nearby")


@query("nearest_preceding_heading", SQL + f""", {_NEAR}
SELECT i.doc_id, i.seq, arg_max(o.t, o.seq) AS heading FROM ordered2 i LEFT JOIN ordered2 o ON o.doc_id = i.doc_id
 AND o.seq BETWEEN i.seq - 9 AND i.seq - 1 AND o.block_type = 'heading' AND o.t <> ''
WHERE i.block_type = 'image' GROUP BY ALL""")
def nearest_preceding_heading(spark, sf_dir):
    return O.image_context(_corpus(spark, sf_dir).block).select("doc_id", "seq", "heading")


@query("following_caption", SQL + rf""", {_NEAR.replace('trim(content) AS t', "trim(CASE WHEN block_type = 'paragraph' AND seq % 2 = 0 THEN 'Source: ' || content ELSE content END) AS t")},
fl AS (SELECT *, lead(t) OVER w AS t1, lead(block_type) OVER w AS b1, lead(t, 2) OVER w AS t2, lead(block_type, 2) OVER w AS b2
 FROM ordered2 WINDOW w AS (PARTITION BY doc_id ORDER BY seq))
SELECT doc_id, seq, CASE WHEN b1 = 'image' THEN NULL WHEN b1 = 'paragraph' AND regexp_matches(t1,
  '(?i)^\s*(?:figure\s*\d+[.:]\s*|fig\.\s*\d+[.:]\s*|caption[.:]\s*|source[.:]\s*)') THEN t1 WHEN b2 = 'image' THEN NULL
 WHEN b2 = 'paragraph' AND regexp_matches(t2, '(?i)^\s*(?:figure\s*\d+[.:]\s*|fig\.\s*\d+[.:]\s*|caption[.:]\s*|source[.:]\s*)')
 THEN t2 END AS caption FROM fl WHERE block_type = 'image'""")
def following_caption(spark, sf_dir):
    block = _corpus(spark, sf_dir).block.withColumn(
        "content",
        F.expr("CASE WHEN block_type = 'paragraph' AND seq % 2 = 0 THEN concat('Source: ', content) ELSE content END"))
    return O.image_context(block).select("doc_id", "seq", "caption")


_CLASS = rf""", {_NEAR}, cx AS (SELECT i.doc_id, i.seq, i.alt, i.src, coalesce(string_agg(o.t, ' ' ORDER BY o.seq), '') AS t FROM ordered2 i
 LEFT JOIN ordered2 o ON o.doc_id = i.doc_id AND o.seq BETWEEN i.seq - 5 AND i.seq + 5 AND o.seq <> i.seq
 AND o.block_type IN ('paragraph', 'heading') AND o.t <> '' WHERE i.block_type = 'image' GROUP BY ALL),
cl AS (SELECT *, CASE WHEN coalesce(alt, '') = '' AND coalesce(src, '') = '' THEN 'decorative'
 WHEN regexp_matches(t, '(?i)\b(?:chart|graph|map|diagram|figure\s*\d+)\b') OR len(regexp_extract_all(t,
  '(?i)\b(?:see\s+figure|as\s+shown\s+in|figure\s+\d+|fig\.\s*\d+)\b')) >= 2 THEN 'complex' ELSE 'informative' END AS image_class FROM cx)"""


@query("image_class_by_context", SQL + _CLASS + "SELECT doc_id, seq, image_class FROM cl")
def image_class_by_context(spark, sf_dir):
    return O.image_context(_corpus(spark, sf_dir).block).select("doc_id", "seq", "image_class")


@query("draft_eligibility", SQL + _CLASS + """SELECT doc_id, count(*) AS images,
 count(*) FILTER (o = 'has_alt') AS has_alt, count(*) FILTER (o = 'decorative') AS decorative,
 count(*) FILTER (o = 'no_src') AS no_src, count(*) FILTER (o = 'eligible') AS eligible FROM (SELECT doc_id,
 CASE WHEN coalesce(alt, '') <> '' THEN 'has_alt' WHEN image_class = 'decorative' THEN 'decorative'
  WHEN NOT starts_with(coalesce(src, ''), 'data:') THEN 'no_src' ELSE 'eligible' END AS o FROM cl) GROUP BY doc_id""")
def draft_eligibility(spark, sf_dir):
    return O.eligibility_counts(O.draft_eligibility(O.image_context(_corpus(spark, sf_dir).block)))


_CAP = r""", cp AS (SELECT *, trim(content) AS c, lead(block_type, 1) OVER w AS n1, lead(block_type, 2) OVER w AS n2,
  lead(block_type, 3) OVER w AS n3 FROM block WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
ch AS (SELECT doc_id, seq, c, seq + CASE WHEN n1 = 'table' THEN 1 WHEN n2 = 'table' THEN 2 WHEN n3 = 'table' THEN 3 END AS ts
  FROM cp WHERE block_type IN ('paragraph', 'heading') AND (regexp_matches(c, '(?i)^(?:TABLE|FIGURE|CHART|EXHIBIT)\s+\d+')
  OR (length(c) < 120 AND starts_with(lower(c), 'table'))))"""


@query("table_caption_attach", SQL + _CAP + """SELECT h.doc_id, h.ts AS table_seq,
 coalesce(nullif(trim(first(t.content)), ''), arg_min(c, h.seq)) AS caption FROM ch h JOIN block t ON t.doc_id = h.doc_id
 AND t.seq = h.ts WHERE h.ts IS NOT NULL GROUP BY ALL""")
def table_caption_attach(spark, sf_dir):
    return O.attach_table_captions(_corpus(spark, sf_dir).block)[0]


@query("table_caption_consumed", SQL + _CAP + "SELECT doc_id, seq FROM ch WHERE ts IS NOT NULL")
def table_caption_consumed(spark, sf_dir):
    return O.attach_table_captions(_corpus(spark, sf_dir).block)[1]


@query("table_caption_predicate", SQL + _CAP + "SELECT doc_id, seq FROM ch")
def table_caption_predicate(spark, sf_dir):
    from pagelight.functions.text import q_strip

    block = _corpus(spark, sf_dir).block.selectExpr("doc_id", "seq", "block_type", f"{q_strip('content')} AS content")
    return block.filter(f"block_type IN ('paragraph', 'heading') AND {O.IS_TABLE_CAPTION}").select("doc_id", "seq")


@query("heading_outline", SQL + """, ho AS (SELECT doc_id, seq, coalesce(level, 2) AS level, page_num FROM block
 WHERE block_type = 'heading' AND trim(content) <> '')
SELECT h.doc_id, h.seq, h.level, max(p.seq) AS parent_seq, greatest(0, least(h.page_num, d.page_count - 1)) AS page
FROM ho h JOIN doc d USING (doc_id) LEFT JOIN ho p ON p.doc_id = h.doc_id AND p.seq < h.seq AND p.level < h.level
GROUP BY h.doc_id, h.seq, h.level, h.page_num, d.page_count""")
def heading_outline(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    return O.heading_outline(corpus.block, corpus.doc)


@query("page_text_context", SQL + """, pt AS (SELECT doc_id, page_num, string_agg(content, ' ' ORDER BY seq) AS c FROM block
 WHERE content <> '' GROUP BY ALL)
SELECT b.doc_id, b.seq, b.page_num, coalesce(c, '') AS context FROM block b LEFT JOIN pt ON pt.doc_id = b.doc_id
 AND pt.page_num = b.page_num WHERE block_type = 'image'""")
def page_text_context(spark, sf_dir):
    return O.page_text(_corpus(spark, sf_dir).block)


_SPANS = """, sp AS (SELECT doc_id, page_num, seq, content, block_type, coalesce(sum(CASE WHEN content <> '' THEN length(content) + 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_num
 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b,
 greatest(coalesce(sum(CASE WHEN content <> '' THEN length(content) + 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_num), 0) - 1, 0)::BIGINT AS n FROM block)
"""


@query("page_text_spans", SQL + _SPANS + 'SELECT doc_id, page_num, seq, b AS start, b + length(content) AS "end", content FROM sp WHERE content <> \'\'')
def page_text_spans(spark, sf_dir):
    return O.page_text_spans(_corpus(spark, sf_dir).block)


@query("image_text_references", SQL + _SPANS + "SELECT doc_id, seq, page_num, greatest(b - 1, 0) AS at, n AS n_chars FROM sp WHERE block_type = 'image'")
def image_text_references(spark, sf_dir):
    return O.image_text_references(_corpus(spark, sf_dir).block)


@query("alt_text_quality", SQL + f""", {_NEAR}, ql AS (SELECT doc_id, seq, trim(alt) AS s, lower(trim(lead(t) OVER (PARTITION BY doc_id ORDER BY seq))) AS cx,
  block_type FROM ordered2)
SELECT doc_id, seq, CASE WHEN regexp_matches(s, '(?i)^(?:image of|photo of|photograph of)\\b') THEN 'forbidden_prefix'
 WHEN s = 'placeholder' THEN 'generic' WHEN length(s) < 10 THEN 'too_short'
 WHEN regexp_matches(s, '^[a-zA-Z]+$') AND length(s) < 50 THEN 'single_word'
 WHEN coalesce(cx, '') <> '' AND length(s) > 20 AND contains(cx, lower(s)) THEN 'repeats_context' END AS reason
FROM ql WHERE block_type = 'image' AND s IS NOT NULL""")
def alt_text_quality(spark, sf_dir):
    from pagelight.functions import scan

    block = _corpus(spark, sf_dir).block.select("doc_id", "seq", "block_type", "alt", "content")
    seen = scan.neighbours(block, ["doc_id"], "seq", {"context": (1, F.col("content"))})
    return seen.filter("block_type = 'image' AND alt IS NOT NULL").withColumn(
        "context", F.coalesce("context", F.lit(""))).selectExpr("doc_id", "seq", f"{O.ALT_QUALITY} AS reason")


@query("alt_text_proposals", SQL + """SELECT doc_id, block_id, image_id, page_num, coalesce(alt, '') AS original_alt,
 coalesce(alt, '') AS proposed_alt, 'informative' AS image_class, CASE WHEN coalesce(alt, '') = '' THEN 0.0 ELSE 0.8 END
 AS confidence FROM block WHERE block_type = 'image' AND seq % 5 <> 0""")
def alt_text_proposals(spark, sf_dir):
    images = _corpus(spark, sf_dir).block.filter("block_type = 'image'").selectExpr(
        "*", "seq % 5 = 0 AS hidden", "'informative' AS image_class")
    return O.alt_text_proposals(images)


@query("revert_unapproved_images", SQL + """SELECT doc_id, block_id, image_id, CASE WHEN image_id IS NOT NULL AND seq % 3 <> 0
 THEN concat('[Figure on page ', page_num + 1, ' — alt text requires review]') ELSE alt END AS alt,
 image_id IS NOT NULL AND seq % 3 <> 0 AS needs_review FROM block WHERE block_type = 'image'""")
def revert_unapproved_images(spark, sf_dir):
    block = _corpus(spark, sf_dir).block
    approved = block.filter("image_id IS NOT NULL AND seq % 3 = 0").select("doc_id", "image_id")
    return O.revert_unapproved(block, approved)
