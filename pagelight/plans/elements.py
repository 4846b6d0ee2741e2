"""Extraction elements: predicates, findings and reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelight.operators import elements as E
from pagelight.plans.registry import query
from pagelight.sources import seeded
from pagelight.sources.seeded import SQL_ELEMENT

_TYPE = r"""CASE WHEN regexp_matches(Path, '(?i)//(?:[^/]+/)*Figure(?:/|$)') THEN 'image'
 WHEN regexp_matches(Path, '(?i)//(?:[^/]+/)*Table(?:/|$)') THEN 'table'
 WHEN regexp_matches(Path, '(?i)//(?:[^/]+/)*(?:H[1-6]?|Title)(?:/|$)') THEN 'heading'
 WHEN regexp_matches(Path, '(?i)//(?:[^/]+/)*(?:Link|Reference)(?:/|$)') THEN 'link'
 WHEN regexp_matches(Path, '(?i)//(?:[^/]+/)*(?:L|LI|LBody)(?:/|$)') THEN 'list' ELSE 'paragraph' END"""
SQL_TYPED = SQL_ELEMENT + f""", ty AS (SELECT *, {_TYPE} AS element_type FROM el),
cx AS (SELECT *, CASE element_type WHEN 'image' THEN CASE WHEN trim(coalesce(alt_attr, '')) = '' THEN 'review'
  ELSE 'simple' END WHEN 'table' THEN CASE WHEN len(regexp_extract_all(upper(Path), 'TABLE')) > 2 THEN 'manual'
  ELSE 'review' END WHEN 'heading' THEN CASE WHEN trim(Text) = '' THEN 'review' ELSE 'simple' END
  WHEN 'link' THEN CASE WHEN trim(Text) = '' THEN 'review' ELSE 'simple' END ELSE 'simple' END AS complexity FROM ty),
sv AS (SELECT *, CASE element_type WHEN 'image' THEN 'critical' WHEN 'table' THEN
  CASE WHEN complexity = 'manual' THEN 'critical' ELSE 'serious' END WHEN 'link' THEN 'serious'
  WHEN 'heading' THEN 'moderate' ELSE 'minor' END AS severity,
  CASE element_type WHEN 'image' THEN '1.1.1' WHEN 'table' THEN '1.3.1' WHEN 'list' THEN '1.3.1'
  WHEN 'heading' THEN '2.4.6' WHEN 'link' THEN '2.4.4' ELSE '1.3.2' END AS criterion FROM cx),
fd AS (SELECT * FROM sv WHERE coalesce(role, '') <> 'Artifact'
  AND Path NOT IN ('//Document', '//Sect', '//Part', '//Art', '//Div', '//Span')
  AND CASE element_type WHEN 'list' THEN NOT contains(Path, '//LI') WHEN 'paragraph' THEN trim(Text) = '' ELSE true END)
"""


@query("element_type", SQL_TYPED + "SELECT doc_id, seq, element_type FROM sv")
def element_type(spark, sf_dir):
    return E.classify(seeded.elements(spark, sf_dir)).select("doc_id", "seq", "element_type")


@query("element_complexity", SQL_TYPED + "SELECT doc_id, seq, complexity FROM sv")
def element_complexity(spark, sf_dir):
    return E.classify(seeded.elements(spark, sf_dir)).select("doc_id", "seq", "complexity")


@query("element_severity", SQL_TYPED + "SELECT doc_id, severity, count(*) AS n FROM sv GROUP BY ALL")
def element_severity(spark, sf_dir):
    return E.classify(seeded.elements(spark, sf_dir)).groupBy("doc_id", "severity").agg(F.expr("count(*) AS n"))


@query("element_criterion_lookup", SQL_TYPED + "SELECT doc_id, seq, criterion FROM sv")
def element_criterion_lookup(spark, sf_dir):
    typed = E.classify(seeded.elements(spark, sf_dir))
    return E.with_criterion(typed, E.criterion_dimension(spark)).select("doc_id", "seq", "criterion")


@query("element_finding_filter", SQL_TYPED + "SELECT doc_id, seq, element_type FROM fd")
def element_finding_filter(spark, sf_dir):
    return E.classify(seeded.elements(spark, sf_dir)).filter(E.WANTS_FINDING).select("doc_id", "seq", "element_type")


@query("element_finding_text", SQL_TYPED + r""", tx AS (SELECT *, CASE WHEN trim(substr(Text, 1, 80)) <> ''
  THEN concat(' (text: ''', trim(substr(Text, 1, 80)), ''')') ELSE '' END AS pv FROM fd)
SELECT doc_id, seq, CASE WHEN element_type = 'image' THEN concat('Image element at ', Path,
   ' is missing descriptive alt text (WCAG 1.1.1 Level A)', pv, '.')
  WHEN element_type = 'table' AND complexity = 'manual' THEN concat('Deeply nested table (>2 levels) at ', Path,
   ' requires manual remediation to establish proper header associations (WCAG 1.3.1 Level A).')
  WHEN element_type = 'table' THEN concat('Table at ', Path,
   ' requires header associations and semantic HTML structure (WCAG 1.3.1 Level A)', pv, '.')
  WHEN element_type = 'heading' THEN concat('Heading element at ', Path,
   ' needs verified hierarchy and descriptive label (WCAG 2.4.6 Level AA)', pv, '.')
  WHEN element_type = 'link' THEN concat('Link element at ', Path,
   ' requires meaningful link text for context (WCAG 2.4.4 Level A)', pv, '.')
  WHEN element_type = 'list' THEN concat('List element at ', Path,
   ' requires proper semantic list structure (WCAG 1.3.1 Level A)', pv, '.')
  ELSE concat('Content element at ', Path, ' must have correct reading order in the tag tree (WCAG 1.3.2 Level A)',
   pv, '.') END AS description FROM tx""")
def element_finding_text(spark, sf_dir):
    found = E.element_findings(seeded.elements(spark, sf_dir), E.criterion_dimension(spark))
    return found.select("doc_id", "seq", "description")


@query("drafting_complexity", SQL_TYPED + """SELECT doc_id, seq, CASE kind WHEN 'table' THEN CASE WHEN depth >= 2
  THEN 'manual' ELSE 'review' END WHEN 'figure' THEN 'review' WHEN 'heading' THEN 'simple' WHEN 'link' THEN 'simple'
  ELSE 'review' END AS flag FROM (SELECT doc_id, seq, CASE element_type WHEN 'image' THEN 'figure' ELSE element_type END
  AS kind, len(regexp_extract_all(Path, '/')) - 1 AS depth FROM sv)""")
def drafting_complexity(spark, sf_dir):
    typed = E.classify(seeded.elements(spark, sf_dir)).selectExpr(
        "doc_id", "seq", "CASE element_type WHEN 'image' THEN 'figure' ELSE element_type END AS element_type",
        f"{E.NESTING_DEPTH} AS nesting_depth")
    return typed.selectExpr("doc_id", "seq", f"{E.DRAFT_COMPLEXITY} AS flag")


_FLAG = "CASE h % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'LEVEL_CORRECTED' WHEN 2 THEN 'NEEDS_REVIEW' WHEN 3 THEN 'MANUAL' ELSE 'RENAMED' END"


@query("heading_correction_findings", SQL_ELEMENT + f""", co AS (SELECT doc_id, concat(Path, ':',
  CASE WHEN h % 7 = 0 THEN -1 ELSE seq END) AS element_id, line AS original, concat('Corrected: ', line) AS corrected,
  {_FLAG} AS flag FROM el WHERE h % 9 = 0 AND starts_with(Path, '//Document/H'))
SELECT c.doc_id, c.element_id, original, corrected, flag,
 CASE WHEN flag IN ('LEVEL_CORRECTED', 'NEEDS_REVIEW') THEN 'moderate' ELSE 'minor' END AS severity,
 CASE flag WHEN 'MANUAL' THEN 'manual' WHEN 'NEEDS_REVIEW' THEN 'review' ELSE 'simple' END AS complexity,
 coalesce(e.Text, original) AS source_text
FROM co c LEFT JOIN el e ON e.doc_id = c.doc_id AND concat(e.Path, ':', e.seq) = c.element_id WHERE flag <> 'OK'""")
def heading_correction_findings(spark, sf_dir):
    line = seeded.lines(spark, sf_dir).select("doc_id", "seq", "line", "h")
    element = seeded.elements(spark, sf_dir)
    heads = element.filter("startswith(Path, '//Document/H')").select("doc_id", "seq", "Path")
    correction = heads.join(line.filter("h % 9 = 0"), ["doc_id", "seq"]).selectExpr(
        "doc_id", "concat(Path, ':', CASE WHEN h % 7 = 0 THEN -1 ELSE seq END) AS element_id",
        "line AS original", "concat('Corrected: ', line) AS corrected", f"{_FLAG} AS flag")
    return E.heading_correction_findings(correction, element)


_ARTIFACT = r"""(regexp_matches(Path, '/Artifact|/Header|/Footer|/Pagination') OR coalesce(lower(role2), '') IN
 ('pagination', 'artifact', 'header', 'footer') OR regexp_full_match(trim(Text), '[0-9]{1,3}')
 OR upper(trim(Text)) = 'NOTE: ROUNDED')"""


@query("tagged_artifacts", SQL_ELEMENT + f"""SELECT doc_id, seq FROM (SELECT *, NULL AS role2 FROM el)
 WHERE {_ARTIFACT}""")
def tagged_artifacts(spark, sf_dir):
    return seeded.elements(spark, sf_dir).filter(E.artifact(("NOTE: ROUNDED",))).select("doc_id", "seq")


_CLEAN = r"""trim(regexp_replace(regexp_replace(replace(replace(Text,
 'I N F R A, JANU ARY. FOO BAR, NEW S; PROGR E S. (<>) ', 'INFRA, JANUARY. FOO BAR, NEWS; PROGRES.'),
 ' AND ', ' AND '),
 '(?i)\b\d{1,2}/\d{1,2}/\d{2,4}\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?\b', '', 'g'),
 '(?i)\bPage\s+\d+\s+of\s+\d+\b', '', 'g'))"""


@query("text_cleanup", SQL_ELEMENT + f"SELECT doc_id, seq, {_CLEAN} AS cleaned FROM el")
def text_cleanup(spark, sf_dir):
    return seeded.elements(spark, sf_dir).selectExpr("doc_id", "seq", f"{E.CLEAN_TEXT} AS cleaned")


@query("numbering_depth", SQL_ELEMENT + r"""SELECT doc_id, seq,
 CASE WHEN regexp_matches(Text, '^\d+\.(?:\d+\.?)*\s') THEN len(string_split(rtrim(regexp_extract(Text, '^(\d+\.(?:\d+\.?)*)\s', 1), '.'), '.'))
  WHEN regexp_matches(Text, '^[A-Z]\.(?:\d+\.?)*\s') THEN len(string_split(rtrim(regexp_extract(Text, '^([A-Z]\.(?:\d+\.?)*)\s', 1), '.'), '.'))
  WHEN regexp_matches(Text, '^\(\d+\)\s') THEN 1 WHEN regexp_matches(Text, '^\([a-z]\)\s') THEN 2 ELSE 0 END AS depth FROM el""")
def numbering_depth(spark, sf_dir):
    return seeded.elements(spark, sf_dir).selectExpr("doc_id", "seq", f"{E.NUMBERING_DEPTH} AS depth")


_STYLE_SQL = """st AS (SELECT *, coalesce(CASE WHEN seq % 11 = 3 THEN 'Times' END, nullif(family, ''), 'Plain') AS fam, round_even(TextSize, 1) AS size,
 CASE align_attr WHEN 'Center' THEN 'center' WHEN 'Start' THEN 'left' END AS al FROM el)"""


@query("style_projection", SQL_ELEMENT + f""", {_STYLE_SQL} SELECT doc_id, seq, fam AS font_family, weight >= 600 AS bold,
 italic, size, al AS align FROM st""")
def style_projection(spark, sf_dir):
    return E.with_style(seeded.elements(spark, sf_dir)).select("doc_id", "seq", "style.*")


@query("style_to_css", SQL_ELEMENT + f""", {_STYLE_SQL} SELECT doc_id, seq, concat_ws('; ', 'font-family: ' || fam,
 'font-size: ' || CAST(size AS VARCHAR) || 'pt', CASE WHEN weight >= 600 THEN 'font-weight: bold' END,
 CASE WHEN italic THEN 'font-style: italic' END, 'text-align: ' || al) AS css FROM st""")
def style_to_css(spark, sf_dir):
    return E.with_style(seeded.elements(spark, sf_dir)).selectExpr("doc_id", "seq", f"{E.STYLE_CSS} AS css")


@query("figure_alt_text", SQL_ELEMENT + """SELECT doc_id, seq, coalesce(alt_attr,
 concat('[Figure on page ', Page, ' — alt text requires review]')) AS alt, alt_attr IS NULL AS needs_review
FROM el WHERE Path = '//Document/Figure'""")
def figure_alt_text(spark, sf_dir):
    figures = seeded.elements(spark, sf_dir).filter("Path = '//Document/Figure'").selectExpr(
        "*", "CAST(NULL AS STRING) AS alternate_text", "CAST(NULL AS STRING) AS Alt")
    return figures.selectExpr("doc_id", "seq", f"{E.ALT_TEXT} AS alt", f"{E.ALT_NEEDS_REVIEW} AS needs_review")


# --- ordered -----------------------------------------------------------------

_PLAIN = r"""NOT regexp_matches(Path, '/H\d(?:\[\d+\])?(?:/|$)') AND NOT regexp_matches(Path, '/Figure') AND NOT contains(Path, '/Table')"""


@query("merge_fragments", SQL_ELEMENT + rf""",
m0 AS (SELECT doc_id, seq, Path, Text, trim(Text) AS t, length(trim(Text)) <= 2 AND regexp_matches(trim(Text), '\p{{Lu}}')
  AND upper(trim(Text)) = trim(Text) AND {_PLAIN} AS frag, regexp_matches(trim(Text), '^\p{{Lu}}') AND {_PLAIN} AS recv FROM el),
m1 AS (SELECT *, frag AND coalesce(lead(recv) OVER (PARTITION BY doc_id ORDER BY seq), false) AS pair FROM m0),
m2 AS (SELECT *, seq - coalesce(max(CASE WHEN NOT pair THEN seq END) OVER (PARTITION BY doc_id ORDER BY seq), -1) AS k FROM m1),
m3 AS (SELECT *, pair AND k % 2 = 1 AS merge FROM m2),
m4 AS (SELECT *, lag(CASE WHEN merge THEN t END) OVER (PARTITION BY doc_id ORDER BY seq) AS prefix FROM m3)
SELECT doc_id, seq, Path, CASE WHEN prefix IS NOT NULL THEN prefix || t ELSE Text END AS text FROM m4 WHERE NOT merge""")
def merge_fragments(spark, sf_dir):
    out = E.merge_fragments(seeded.elements(spark, sf_dir))
    return out.select("doc_id", "seq", "Path", F.col("Text").alias("text"))


@query("infer_heading_levels", SQL_ELEMENT + r""", sz AS (SELECT doc_id, round_even(TextSize, 1) AS size, max(weight) AS w FROM el
 WHERE regexp_matches(Path, '/H\d') AND TextSize IS NOT NULL GROUP BY ALL)
SELECT doc_id, size, least(row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, w DESC), 6) AS level FROM sz""")
def infer_heading_levels(spark, sf_dir):
    return E.infer_heading_levels(seeded.elements(spark, sf_dir))


SQL_CELLS = SQL_ELEMENT + rf""", tb AS (SELECT *, nullif(regexp_extract(Path, '^(.*?/Table(?:\[\d+\])?)(?:/|$)', 1), '') AS base FROM el),
tb1 AS (SELECT *, base IS NOT NULL AND coalesce(lag(base) OVER (PARTITION BY doc_id ORDER BY seq) <> base,
   lag(base) OVER (PARTITION BY doc_id ORDER BY seq) IS NULL) AS st FROM tb),
tb2 AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS table_no FROM tb1),
ce0 AS (SELECT doc_id, CAST(table_no AS BIGINT) AS table_no, Page AS page, seq, {_CLEAN} AS ctext,
  coalesce(try_cast(regexp_extract(Path, '/TR(?:\[(\d+)\])?/(TH|TD)(?:\[(\d+)\])?', 1) AS INT), 0) AS row,
  regexp_extract(Path, '/TR(?:\[(\d+)\])?/(TH|TD)(?:\[(\d+)\])?', 2) AS ct,
  coalesce(try_cast(regexp_extract(Path, '/TR(?:\[(\d+)\])?/(TH|TD)(?:\[(\d+)\])?', 3) AS INT), 0) AS col
  FROM tb2 WHERE base IS NOT NULL),
ce AS (SELECT doc_id, table_no, page, row, col * 2 + CASE WHEN ct = 'TH' THEN 0 ELSE 1 END AS sort_key,
  arg_min(ct, seq) AS cell_type, string_agg(ctext, ' ' ORDER BY seq) AS text FROM ce0 WHERE ct <> '' AND ctext <> '' GROUP BY ALL),
ro AS (SELECT doc_id, table_no, page, row, list(text ORDER BY sort_key) AS texts, list(cell_type ORDER BY sort_key) AS types
  FROM ce GROUP BY ALL),
ro1 AS (SELECT *, list_contains(types, 'TH') AS th, list_contains(types, 'TD') AS td, len(texts) AS n,
  len(list_filter(texts, lambda t: regexp_matches(t, '^[$€£]?\s*[\d,]+\.?\d*\s*%?$'))) AS num FROM ro),
hd AS (SELECT doc_id, table_no, page, coalesce(min(row) FILTER (th AND NOT td AND n >= 2), min(row) FILTER (th AND td),
  min(row) FILTER (n >= 2 AND NOT num > n / 2), min(row) FILTER (n >= 2), min(row)) AS header_row FROM ro1 GROUP BY ALL)
"""


@query("table_ranges", SQL_CELLS + """SELECT doc_id, CAST(table_no AS BIGINT) AS table_no, min(seq) AS first_seq,
 max(seq) AS last_seq, min(base) AS base FROM tb2 WHERE base IS NOT NULL GROUP BY ALL""")
def table_ranges(spark, sf_dir):
    return E.table_ranges(seeded.elements(spark, sf_dir)).groupBy("doc_id", "table_no").agg(
        F.expr("min(seq) AS first_seq"), F.expr("max(seq) AS last_seq"), F.expr("min(base) AS base"))


@query("table_cells", SQL_CELLS + "SELECT doc_id, table_no, page, row, sort_key, cell_type, text FROM ce")
def table_cells(spark, sf_dir):
    return E.table_cells(seeded.elements(spark, sf_dir))


@query("table_header_row", SQL_CELLS + "SELECT * FROM hd")
def table_header_row(spark, sf_dir):
    return E.header_rows(E.table_rows(E.table_cells(seeded.elements(spark, sf_dir))))


SQL_SPLIT = SQL_CELLS + r""", sp0 AS (SELECT r.*, h.header_row, max(CASE WHEN r.row < h.header_row THEN r.row END)
   OVER (PARTITION BY r.doc_id, r.table_no, r.page) AS above FROM ro1 r JOIN hd h USING (doc_id, table_no, page)),
sp1 AS (SELECT *, CASE WHEN bool_or(row = above AND td) OVER (PARTITION BY doc_id, table_no, page) THEN above END AS extra_row,
  array_to_string(list_filter(texts, lambda t: trim(t) <> ''), ' — ') AS joined,
  row > header_row AND n = 1 AND starts_with(lower(texts[1]), 'equation') AS dropped FROM sp0),
sp2 AS (SELECT *, row > header_row AND NOT dropped AND (regexp_matches(texts[1], '^\[\d+\]') OR (n = 1 AND
   regexp_matches(texts[1], '(?i)^(?:Source|Note|Notes)\s*:'))) AS opens, row < header_row AND NOT coalesce(row = extra_row, false) AS lead_row FROM sp1),
sp3 AS (SELECT *, bool_or(opens) OVER w AS notes, lead_row AND regexp_matches(joined, '(?i)^Table\s+\d+[A-Za-z]?\s*[-:.]\s*.+$') AS cap
  FROM sp2 WINDOW w AS (PARTITION BY doc_id, table_no, page ORDER BY row)),
sp4 AS (SELECT *, row > header_row AND NOT dropped AND NOT notes AS cand, count(*) FILTER (cap) OVER w AS caps FROM sp3
  WINDOW w AS (PARTITION BY doc_id, table_no, page ORDER BY row)),
sp5 AS (SELECT *, bool_or(cand AND n >= 2) OVER (PARTITION BY doc_id, table_no, page ORDER BY row
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, count(*) FILTER (cand AND n >= 2) OVER p AS multi,
  count(*) FILTER (cand AND n = 1) OVER p AS single, max(CASE WHEN row = header_row THEN n END) OVER p
   + coalesce(max(CASE WHEN row = extra_row THEN len(list_filter(types, lambda t: t = 'TD')) END) OVER p, 0) AS heads
  FROM sp4 WINDOW p AS (PARTITION BY doc_id, table_no, page)),
sp AS (SELECT *, CASE WHEN row = header_row THEN 'header' WHEN coalesce(row = extra_row, false) THEN 'extra_header'
  WHEN lead_row THEN CASE WHEN cap AND caps = 1 THEN 'caption' WHEN trim(joined) = '' THEN 'dropped' ELSE 'heading' END
  WHEN dropped THEN 'dropped' WHEN notes THEN 'footnote' WHEN heads >= 2 AND multi = 0 AND single > 0 THEN 'data'
  WHEN heads >= 2 AND n = 1 THEN CASE WHEN coalesce(seen, false) THEN 'footnote' ELSE 'paragraph' END ELSE 'data' END AS part FROM sp5)
"""


@query("table_body_split", SQL_SPLIT + "SELECT doc_id, table_no, page, row, part, array_to_string(texts, '|') AS texts FROM sp")
def table_body_split(spark, sf_dir):
    split = E.split_tables(E.table_rows(E.table_cells(seeded.elements(spark, sf_dir))))
    return split.selectExpr("doc_id", "table_no", "page", "row", "part", "array_join(texts, '|') AS texts")


@query("assembled_tables", SQL_SPLIT + """SELECT doc_id, table_no, page, max(joined) FILTER (part = 'caption') AS caption,
 array_to_string(list_concat(coalesce(first(texts) FILTER (part = 'header'), []), coalesce(first(list_filter(texts,
  lambda t, i: types[i] = 'TD')) FILTER (part = 'extra_header'), [])), '|') AS headers,
 coalesce(string_agg(array_to_string(texts, '|'), '/' ORDER BY row) FILTER (part = 'data'), '') AS rows FROM sp GROUP BY ALL""")
def assembled_tables(spark, sf_dir):
    tables = E.assemble_tables(E.split_tables(E.table_rows(E.table_cells(seeded.elements(spark, sf_dir)))))
    return tables.selectExpr("doc_id", "table_no", "page", "caption", "array_join(headers, '|') AS headers",
                             "array_join(transform(rows, r -> array_join(r, '|')), '/') AS rows")


@query("list_accumulation", SQL_ELEMENT + rf""", li0 AS (SELECT *, {_CLEAN} AS ctext, regexp_matches(Path, '/H\d|/Footnote') AS titled,
  contains(Path, '/Figure') AS fig, contains(Path, '/Table') AS tab, regexp_matches(Path, '/L(?:\[\d+\])?(?:/|$)') AS inl FROM el),
li1 AS (SELECT * FROM li0 WHERE tab OR (NOT contains(Path, '/TOC') AND NOT contains(Path, '/Artifact')
  AND NOT regexp_full_match(trim(Text), '[0-9]{{1,3}}') AND (fig OR (ctext <> '' AND (titled OR NOT contains(Path, '/Lbl')))))),
li2 AS (SELECT *, CASE WHEN tab OR fig OR titled THEN NULL WHEN regexp_matches(ctext, '^[•\-\*]\s+') THEN 'bullet'
  WHEN regexp_matches(ctext, '^(?:\d{{1,3}}[.)]\s+|\([a-zA-Z0-9]+\)\s+|[a-zA-Z][.)]\s+)') THEN 'number' WHEN inl THEN 'bullet' END AS kind,
  trim(regexp_replace(ctext, '^(?:[•\-\*]\s+|\d{{1,3}}[.)]\s+|\([a-zA-Z0-9]+\)\s+|[a-zA-Z][.)]\s+)', '')) AS item FROM li1),
li3 AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY seq) AS lk FROM li2 WHERE kind IS NULL OR item <> ''),
li4 AS (SELECT *, sum(CASE WHEN kind IS NOT NULL AND (lk IS NULL OR lk <> kind) THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY seq) AS list_no FROM li3)
SELECT doc_id, CAST(list_no AS BIGINT) AS list_no, seq, Page AS page, kind = 'number' AS ordered, item FROM li4 WHERE kind IS NOT NULL""")
def list_accumulation(spark, sf_dir):
    return E.list_items(seeded.elements(spark, sf_dir))


@query("figure_caption_attach", SQL_ELEMENT + rf""", fc AS (SELECT *, lead({_CLEAN}) OVER w AS nt, lead(seq) OVER w AS ns FROM el
 WINDOW w AS (PARTITION BY doc_id ORDER BY seq))
SELECT doc_id, seq, Page AS "Page", CASE WHEN m THEN nt END AS caption, CASE WHEN m THEN ns END AS consumed_seq
FROM (SELECT *, coalesce(regexp_matches(nt, '(?i)^(?:FIGURE|Fig\.?)\s+\d+'), false) AS m FROM fc WHERE Path = '//Document/Figure')""")
def figure_caption_attach(spark, sf_dir):
    return E.figure_captions(seeded.elements(spark, sf_dir))


@query("elements_to_blocks", SQL_TYPED + """SELECT d.doc_id, CAST(coalesce(max(e.Page) + 1, 1) AS INT) AS page_count,
 count(e.seq) FILTER (element_type IN ('heading', 'table', 'image', 'list')) AS n_known, count(e.seq) AS n_block
FROM documents d LEFT JOIN sv e ON e.doc_id = d.doc_id GROUP BY 1""")
def elements_to_blocks(spark, sf_dir):
    raw = seeded.elements(spark, sf_dir)
    typed = E.classify(raw).selectExpr("doc_id", "seq", "Page AS page", "element_type AS type", "Text AS content")
    doc, block = E.elements_to_blocks(typed, raw, seeded.read_table(spark, sf_dir, "documents"))
    counts = block.groupBy("doc_id").agg(
        F.expr("count_if(block_type <> 'paragraph') AS n_known"), F.expr("count(*) AS n_block"))
    return doc.join(counts, "doc_id", "left").fillna(0, ["n_known", "n_block"])


@query("extraction_json_scan", SQL_ELEMENT + """SELECT doc_id, seq, Path AS path, Text AS text FROM el""")
def extraction_json_scan(spark, sf_dir):
    """Elements written as extraction JSON and read back, with non-object entries dropped."""
    nested = seeded.elements(spark, sf_dir).groupBy("doc_id").agg(
        F.expr("array_sort(collect_list(struct(seq, Path, Text, Page))) AS es"))
    raw = nested.selectExpr(
        "doc_id", "to_json(named_struct('elements', transform(es, e -> named_struct('Path', e.Path, 'Text', e.Text, "
        "'Page', e.Page)))) AS json")
    return E.scan_extraction(raw).selectExpr("doc_id", "seq", "Path AS path", "Text AS text")


_PARAS = r"""pa AS (SELECT doc_id, trim(p) AS t, i - 1 AS ord FROM (SELECT doc_id, ps[i] AS p, i FROM (SELECT doc_id, ps,
 unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split(txt, chr(10) || chr(10)) AS ps FROM (SELECT doc_id,
 concat(CASE doc_id % 3 WHEN 0 THEN upper(substr(text, 1, 40)) WHEN 1 THEN 'Annual Report Of Fees' ELSE upper(substr(text, 1, 90)) END,
  chr(10), chr(10), text) AS txt FROM documents)))) WHERE trim(p) <> '')"""


@query("plain_text_heading_guess", f"WITH {_PARAS}" + r"""SELECT doc_id, ord, CASE
 WHEN regexp_matches(t, '\p{L}') AND upper(t) = t AND lower(t) <> t AND length(t) < 60 THEN '//Document/H1'
 WHEN regexp_matches(t, '\p{L}') AND upper(t) = t AND lower(t) <> t AND length(t) < 120 THEN '//Document/H2'
 WHEN regexp_matches(t, '\p{Lu}') AND NOT regexp_matches(t, '(^|[^\p{L}])\p{Ll}|\p{L}\p{Lu}') AND length(t) < 80
  AND NOT contains(t, chr(10)) THEN '//Document/H3' ELSE '//Document/P' END AS path FROM pa""")
def plain_text_heading_guess(spark, sf_dir):
    head = """CASE doc_id % 3 WHEN 0 THEN upper(substr(text, 1, 40)) WHEN 1 THEN 'Annual Report Of Fees'
     ELSE upper(substr(text, 1, 90)) END"""
    pages = seeded.read_table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "0 AS page_num", f"concat({head}, '\\n\\n', text) AS text")
    return E.heading_guess(pages).selectExpr("doc_id", "ord", "Path AS path")
