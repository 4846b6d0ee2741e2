"""Audit rules, one query per success criterion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.operators import checks
from pagelight.plans.registry import query
from pagelight.sources import dimensions, seeded

OUT = ("doc_id", "criterion", "status", "severity", "element_id", "page", "issue", "n", "auto_fixable",
       "remediation_type", "evidence")


def seeded_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = seeded.read_table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        (F.col("doc_id") % 12 == 1).alias("has_media"),
        (F.col("doc_id") % 12 == 2).alias("has_javascript"),
        (F.col("doc_id") % 12 == 3).alias("is_document_set"),
    )


# --- comparison SQL ---------------------------------------------------------

SQL_FACTS = seeded.SQL_CORPUS + r""",
flag AS (SELECT doc_id, doc_id % 12 = 1 AS has_media, doc_id % 12 = 2 AS has_javascript,
  doc_id % 12 = 3 AS is_document_set FROM doc),
bf AS (SELECT doc_id, count(*) AS n_block,
  count(*) FILTER (block_type = 'heading') AS n_heading, count(*) FILTER (block_type = 'list') AS n_list,
  count(*) FILTER (block_type = 'table') AS n_table, count(*) FILTER (block_type = 'image') AS n_image,
  count(*) FILTER (block_type = 'paragraph') AS n_paragraph,
  count(*) FILTER (block_type = 'form_field') AS n_form,
  count(*) FILTER (regexp_matches(content, '(?i)https?://\S+')) AS n_link,
  count(*) FILTER (block_type = 'image' AND regexp_matches(coalesce(nullif(alt, ''), content),
   '(?i)\b(chart|graph|figure|diagram|plot|pie|bar|line)\b')) AS n_chart
  FROM block GROUP BY doc_id),
pf AS (SELECT doc_id, count(*) AS n_page, count(*) FILTER (NOT has_text) AS n_scanned,
  count(*) FILTER (has_text) AS n_text, min(page_num) FILTER (NOT has_text) AS first_scanned,
  min(page_num) FILTER (has_text) AS first_text FROM pages1 GROUP BY doc_id),
facts AS (SELECT d.*, coalesce(n_block, 0) AS n_block, coalesce(n_heading, 0) AS n_heading,
  coalesce(n_list, 0) AS n_list, coalesce(n_table, 0) AS n_table, coalesce(n_image, 0) AS n_image,
  coalesce(n_paragraph, 0) AS n_paragraph,
  coalesce(n_form, 0) AS n_form, coalesce(n_link, 0) AS n_link, coalesce(n_chart, 0) AS n_chart,
  coalesce(n_page, 0) AS n_page, coalesce(n_scanned, 0) AS n_scanned, coalesce(n_text, 0) AS n_text,
  first_scanned, first_text, has_media, has_javascript, is_document_set,
  coalesce(n_form, 0) > 0 AS has_forms, coalesce(n_link, 0) > 0 AS has_links
  FROM doc d JOIN flag USING (doc_id) LEFT JOIN bf USING (doc_id) LEFT JOIN pf USING (doc_id))"""

_SEV, _REM = checks.SEVERITY, checks.REMEDIATION


def _row(c, status, src, issue="NULL", sev=None, element="''", page="0", n="1", auto="false", rem=None, ev="''",
         where="true"):
    sev = f"'{sev or _SEV[c]}'" if not (sev or "").startswith("CASE") else sev
    rem = f"'{rem or _REM[c]}'" if not (rem or "").startswith("CASE") else rem
    return (
        f"SELECT doc_id, '{c}' AS criterion, '{status}' AS status, {sev} AS severity, {element} AS element_id, "
        f"CAST({page} AS INT) AS page, {issue} AS issue, CAST({n} AS BIGINT) AS n, {auto} AS auto_fixable, "
        f"{rem} AS remediation_type, {ev} AS evidence FROM {src} WHERE {where}"
    )


def _gated(c, feature):
    return _row(c, "fail", "facts", "'needs_review'", element="'document'", rem="manual_review",
                where=feature) + "\nUNION ALL " + _row(c, "not_applicable", "facts", where=f"NOT ({feature})")


def _verdict(c, bad, issue, na=None, **kw):
    live = f"NOT ({na})" if na else "true"
    sql = _row(c, "fail", "facts", issue, where=f"{live} AND ({bad})", **kw)
    sql += "\nUNION ALL " + _row(c, "pass", "facts", where=f"{live} AND NOT ({bad})")
    if na:
        sql += "\nUNION ALL " + _row(c, "not_applicable", "facts", where=na)
    return sql


def _blocks(c, issues, na=None, extra=()):
    """Row findings plus the pass row of documents without any."""
    fails = [
        _row(c, "fail", "block", f"'{i}'", where=w, **{"element": "block_id", "page": "page_num", **kw})
        for i, w, kw in issues
    ] + list(extra)
    body = "\nUNION ALL ".join(fails)
    live = f"NOT ({na})" if na else "true"
    sql = f"SELECT * FROM ({body}) UNION ALL " + _row(
        c, "pass", "facts", where=f"{live} AND doc_id NOT IN (SELECT doc_id FROM ({body}))")
    if na:
        sql += "\nUNION ALL " + _row(c, "not_applicable", "facts", where=na)
    return sql


_BARE = "(headers IS NULL OR len(headers) = 0)"
_WIDEST = "coalesce(list_max(list_transform(rows, lambda r: len(r))), 0)"
_FORM = "block_type = 'form_field'"


def _first(*cols):
    return "trim(coalesce(" + ", ".join(f"nullif({c}, '')" for c in cols) + ", ''))"


_IMAGE_KIND = r"""CASE WHEN block_type = 'image' THEN
 CASE WHEN (abs(x2 - x1) > 0 AND abs(x2 - x1) < 5) OR (abs(y2 - y1) > 0 AND abs(y2 - y1) < 5)
   OR regexp_matches(concat(coalesce(alt, ''), ' ', content),
     '(?i)\b(decorative|spacer|separator|border|divider|background)\b') THEN 'decorative'
  WHEN trim(coalesce(alt, '')) = '' OR regexp_matches(trim(alt), '(?i)^(placeholder|.*\.(jpg|jpeg|png|gif))$')
   THEN 'missing'
  WHEN length(alt) > 150 THEN 'long_alt' END END"""

_SCRIPT = """CASE regexp_extract(content, '[一-鿿]|[Ѐ-ӿ]|[؀-ۿ]|[ऀ-ॿ]|[àáâãäåæçèéêëìíîïðñòóôõöùúûüýþÿ]{3,}')
  WHEN '' THEN NULL ELSE CASE
  WHEN regexp_matches(regexp_extract(content, '[一-鿿]|[Ѐ-ӿ]|[àáâãäåæçèéêëìíîïðñòóôõöùúûüýþÿ]{3,}'), '[一-鿿]')
   THEN 'CJK (Chinese/Japanese/Korean)'
  WHEN regexp_matches(regexp_extract(content, '[一-鿿]|[Ѐ-ӿ]|[àáâãäåæçèéêëìíîïðñòóôõöùúûüýþÿ]{3,}'), '[Ѐ-ӿ]')
   THEN 'Cyrillic' ELSE 'accented Latin' END END"""

_LAG = """ordered AS (SELECT *, lag(page_num) OVER w AS pp, lag(y1) OVER w AS py FROM block
 WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
brk AS (SELECT doc_id, count(*) FILTER (page_num < pp OR (page_num = pp AND y1 < py - 20)) AS breaks
 FROM ordered GROUP BY doc_id)"""

_TITLE = r"""title AS (SELECT *, trim(coalesce(nullif(meta_title, ''),
  regexp_replace(filename, '\.[^.]*$', ''))) AS t FROM facts),
titled AS (SELECT *, CASE WHEN t = '' THEN 'missing'
 WHEN regexp_matches(t, '(?i)^.*\.(pdf|doc|docx|xls|xlsx|ppt|pptx|txt|rtf|odt)$') THEN 'filename'
 WHEN contains(t, '/') OR contains(t, '\') THEN 'path'
 WHEN regexp_matches(t, '(?i)^(untitled|document|doc\d*|page\d*|file\d*|new document|microsoft word)$') THEN 'generic'
 WHEN regexp_matches(t, '(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$') THEN 'uuid'
 WHEN regexp_matches(t, '(?i)^[0-9a-f]{32,}$') THEN 'hash'
 WHEN regexp_matches(t, '^[a-z0-9][-_a-z0-9]*[a-z0-9]$') AND (contains(t, '-') OR contains(t, '_'))
  THEN 'filename_stem' END AS problem FROM title)"""

_LANG = r"""langs AS (SELECT *, trim(coalesce(meta_language, '')) AS raw FROM facts),
lang1 AS (SELECT *, CASE WHEN coalesce(meta_language, '') = '' AND language = 'en' AND raw = '' THEN 'unverified_default'
 WHEN coalesce(nullif(raw, ''), trim(coalesce(language, ''))) = '' THEN 'missing'
 WHEN NOT regexp_matches(coalesce(nullif(raw, ''), trim(coalesce(language, ''))),
  '^[a-zA-Z]{2,3}(-[a-zA-Z0-9]{2,8})*$') THEN 'invalid_tag' END AS problem FROM langs)"""

_IMAGES_SQL = f"""imgs AS (SELECT doc_id, page_num, seq, block_id, {_IMAGE_KIND} AS kind FROM block),
img1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, kind ORDER BY seq) AS pos FROM imgs
 WHERE kind IS NOT NULL),
imgp AS (SELECT doc_id, page_num, kind, count(*) AS n,
 concat('image_ids: ', string_agg(block_id, ', ' ORDER BY seq) FILTER (pos <= 25),
  CASE WHEN count(*) > 25 THEN concat(' (+', count(*) - 25, ' more)') ELSE '' END) AS ids
 FROM img1 GROUP BY ALL)"""

_COLS_SQL = """cols AS (SELECT doc_id, page_num, count(DISTINCT round_even(x1 / 50, 0)) AS n FROM block GROUP BY ALL)"""
_CHART_SQL = r"""charts AS (SELECT doc_id, page_num, count(*) AS n FROM block WHERE block_type = 'image'
 AND regexp_matches(coalesce(nullif(alt, ''), content), '(?i)\b(chart|graph|figure|diagram|plot|pie|bar|line)\b')
 GROUP BY ALL)"""
_SKIP_SQL = """levels AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY seq) AS pl FROM block
 WHERE block_type = 'heading' AND level IS NOT NULL),
skips AS (SELECT *, concat('H', pl, ' → H', level) AS ev FROM levels WHERE level > pl + 1)"""
_DUP_SQL = """dups AS (SELECT doc_id, block_id, min(seq) AS s FROM block GROUP BY ALL HAVING count(*) > 1),
dupd AS (SELECT doc_id, count(*) AS n, arg_min(block_id, s) AS block_id FROM dups GROUP BY doc_id)"""
_SCRIPT_SQL = f"""scr AS (SELECT *, {_SCRIPT} AS script FROM block),
scrd AS (SELECT doc_id, script, min(page_num) AS page_num, count(DISTINCT page_num) AS n,
 arg_min(block_id, seq) AS block_id FROM scr WHERE script IS NOT NULL GROUP BY ALL)"""


def _with(ctes, body):
    return SQL_FACTS + "".join(",\n" + c for c in ctes) + "\n" + body


def _src_pass(c, src):
    return "\nUNION ALL " + _row(c, "pass", "facts", where=f"doc_id NOT IN (SELECT doc_id FROM {src})")


_SENSORY = (
    r"'(?i)\bclick\s+the\s+(red|green|blue|yellow|orange|purple|round|square|triangle|circular|rectangular)\s+\w+|"
    r"\bon\s+the\s+(left|right|top|bottom)\b'"
)
_URL = r"regexp_matches(content, '(?i)https?://\S+')"
_GENERIC = r"regexp_matches(content, '(?i)\b(click here|here|read more|more info|learn more|more|details|link)\b')"
_TYPES = "('heading', 'paragraph', 'table', 'image', 'list', 'form_field')"

CHECK_SQL: dict[str, str] = {}
for _c in checks.MEDIA:
    CHECK_SQL[_c] = _gated(_c, "has_media")
for _c in checks.SCRIPTED:
    CHECK_SQL[_c] = _gated(_c, "has_javascript")
for _c in checks.FORMS:
    CHECK_SQL[_c] = _gated(_c, "has_forms")
for _c in checks.DOC_SET:
    CHECK_SQL[_c] = _gated(_c, "is_document_set")
CHECK_SQL["3.2.1"] = _gated("3.2.1", "has_forms OR has_javascript")
for _c in checks.NEVER:
    CHECK_SQL[_c] = _row(_c, "not_applicable", "facts")

CHECK_CTES: dict[str, list[str]] = {
    "1.1.1": [_IMAGES_SQL], "1.3.2": [_COLS_SQL], "1.4.1": [_CHART_SQL], "2.4.6": [_SKIP_SQL], "4.1.1": [_DUP_SQL],
    "3.1.2": [_SCRIPT_SQL], "2.4.3": [_LAG], "2.4.2": [_TITLE], "3.1.1": [_LANG],
}
CHECK_SQL["1.1.1"] = _row(
    "1.1.1", "fail", "imgp", "kind", "CASE WHEN kind = 'long_alt' THEN 'moderate' ELSE 'critical' END",
    "concat('page_', page_num, '_', CASE WHEN kind = 'missing' THEN 'images' ELSE kind END)", "page_num", "n",
    rem="CASE WHEN kind = 'missing' THEN 'ai_draft' ELSE 'manual_review' END", ev="ids") + _src_pass("1.1.1", "imgp")
CHECK_SQL["1.3.1"] = _blocks("1.3.1", [
    ("table_caption_missing", "block_type = 'table' AND trim(coalesce(caption, '')) = ''", {"auto": "true"}),
    ("layout_table", f"block_type = 'table' AND {_BARE} AND {_WIDEST} <= 1", {}),
    ("table_headers_missing", f"block_type = 'table' AND {_BARE} AND {_WIDEST} > 1", {"auto": "true"}),
    ("table_row_width", f"block_type = 'table' AND NOT {_BARE} AND "
     "len(list_filter(rows, lambda r: len(r) <> len(headers))) > 0", {}),
    ("list_empty", "block_type = 'list' AND len(items) = 0", {"auto": "true"}),
    ("list_blank_items", "block_type = 'list' AND len(list_filter(items, lambda x: trim(x) = '')) > 0", {}),
    ("heading_level_invalid", "block_type = 'heading' AND (level IS NULL OR level < 1 OR level > 6)",
     {"auto": "true"}),
])
CHECK_SQL["1.3.2"] = _row("1.3.2", "fail", "cols", "'columns'", "moderate", "concat('page_', page_num)", "page_num", "n",
                          rem="manual_review", where="n >= 3") + _src_pass(
    "1.3.2", "(SELECT * FROM cols WHERE n >= 3)")
CHECK_SQL["1.3.3"] = _blocks("1.3.3", [("sensory_reference", f"regexp_matches(content, {_SENSORY})",
                                        {"rem": "manual_review", "ev": "substr(content, 1, 120)"})])
CHECK_SQL["1.3.4"] = _verdict("1.3.4", "coalesce(meta_rotate, '0') <> '0'", "'rotation'", element="'document'",
                              rem="manual_review", ev="meta_rotate")
CHECK_SQL["1.3.5"] = _blocks("1.3.5", [("field_name_missing", f"{_FORM} AND {_first('name', 'content')} = ''",
                                        {"rem": "manual_review"})], "NOT has_forms")
CHECK_SQL["1.4.1"] = _row("1.4.1", "fail", "charts", "'charts'", None, "concat('page_', page_num, '_charts')",
                          "page_num", "n", rem="manual_review") + _src_pass("1.4.1", "charts")
_SCAN = dict(issue="'scanned_pages'", sev="serious", element="'scanned_pages'", page="first_scanned", n="n_scanned",
             rem="manual_review")
CHECK_SQL["1.4.3"] = "\nUNION ALL ".join([
    _row("1.4.3", "fail", "facts", where="n_scanned > 0", **_SCAN),
    _row("1.4.3", "not_applicable", "facts", "'text_pages'", "moderate", "'text_pages'", "first_text", "n_text",
         rem="manual_review", where="n_text > 0"),
    _row("1.4.3", "pass", "facts", where="n_page = 0"),
])
CHECK_SQL["1.4.4"] = _verdict("1.4.4", "n_scanned > 0", "'scanned_pages'", element="concat('page_', first_scanned)",
                              page="first_scanned", n="n_scanned", rem="manual_review")
_LONG = _row("1.4.5", "fail", "block", "'long_image_text'", element="coalesce(image_id, block_id)", page="page_num",
             rem="manual_review",
             where=r"block_type = 'image' AND len(regexp_extract_all(coalesce(alt, ''), '\S+')) > 50")
CHECK_SQL["1.4.5"] = _row("1.4.5", "fail", "facts", where="n_scanned > 0", **_SCAN) + "\nUNION ALL " + _LONG + \
    "\nUNION ALL " + _row("1.4.5", "pass", "facts", where=f"n_scanned = 0 AND doc_id NOT IN (SELECT doc_id FROM ({_LONG}))")
for _c in ("1.4.10", "1.4.12"):
    CHECK_SQL[_c] = _verdict(_c, "n_heading + n_list + n_table + n_paragraph = 0", "'no_structure'",
                             element="'document'", auto="true", rem="auto_fix")
CHECK_SQL["1.4.11"] = _verdict("1.4.11", "n_form + n_chart > 0", "'needs_contrast_review'", element="'document'",
                               n="n_form + n_chart", rem="manual_review")
_IDLE = "NOT has_forms AND NOT has_links AND NOT has_javascript"
CHECK_SQL["2.1.1"] = _verdict("2.1.1", "true", "'needs_keyboard_test'", _IDLE, element="'document'",
                              n="n_form + n_link", rem="manual_review")
CHECK_SQL["2.1.2"] = _verdict("2.1.2", "has_javascript", "'scripted'", "NOT has_javascript AND NOT has_forms",
                              element="'document'", rem="manual_review")
CHECK_SQL["2.4.1"] = _verdict("2.4.1", "n_heading = 0 AND (coalesce(nullif(page_count, 0), n_page) > 1 OR n_block > 10)",
                              "'no_headings'", element="'document'", auto="true")
CHECK_SQL["2.4.2"] = _verdict("2.4.2", "problem IS NOT NULL", "problem", element="'document'", auto="true",
                              ev="t").replace("FROM facts", "FROM titled")
CHECK_SQL["2.4.3"] = _verdict("2.4.3", "coalesce(breaks, 0) > 0", "'order_breaks'", _IDLE, element="'document'",
                              sev="serious", n="breaks", rem="manual_review").replace(
    "FROM facts", "FROM (FROM facts LEFT JOIN brk USING (doc_id))")
CHECK_SQL["2.4.4"] = _blocks("2.4.4", [
    ("generic_link_text", f"{_URL} AND {_GENERIC}", {"ev": "substr(content, 1, 120)"}),
    ("bare_url", rf"{_URL} AND NOT {_GENERIC} AND regexp_full_match(trim(content), '(?i)https?://\S+')",
     {"ev": "substr(trim(content), 1, 100)"}),
])
CHECK_SQL["2.4.5"] = _verdict("2.4.5", "n_heading = 0", "'no_headings'", element="'document'", auto="true")
CHECK_SQL["2.4.6"] = _blocks("2.4.6", [
    ("heading_empty", "block_type = 'heading' AND trim(content) = ''", {}),
    ("field_label_missing", f"{_FORM} AND {_first('label', 'content')} = ''", {}),
], extra=[_row("2.4.6", "fail", "skips", "'level_skipped'", element="block_id", page="page_num", auto="true", ev="ev")])
CHECK_SQL["3.1.1"] = _verdict("3.1.1", "problem IS NOT NULL", "problem", element="'document'", auto="true").replace(
    "FROM facts", "FROM lang1")
CHECK_SQL["3.1.2"] = _row("3.1.2", "fail", "scrd", "script", element="block_id", page="page_num", n="n",
                          rem="manual_review") + _src_pass("3.1.2", "scrd")
CHECK_SQL["3.3.2"] = _blocks("3.3.2", [("field_instructions_missing",
                                        f"{_FORM} AND {_first('tooltip', 'label', 'content')} = ''",
                                        {"auto": "true"})], "NOT has_forms")
CHECK_SQL["4.1.1"] = _blocks("4.1.1", [
    ("block_type_invalid", f"block_type NOT IN {_TYPES}", {"auto": "true"}),
], extra=[_row("4.1.1", "fail", "dupd", "'duplicate_ids'", element="block_id", n="n", auto="true")])
CHECK_SQL["4.1.2"] = _blocks("4.1.2", [("field_accessible_name_missing",
                                        f"{_FORM} AND {_first('name', 'tooltip', 'label', 'content')} = ''",
                                        {"auto": "true"})], "NOT has_forms AND NOT has_links")

NAMES = {
    "1.1.1": "non_text_content", "1.2.1": "audio_video_only", "1.2.2": "captions_prerecorded",
    "1.2.3": "audio_description", "1.2.4": "captions_live", "1.2.5": "audio_description_prerecorded",
    "1.3.1": "info_relationships", "1.3.2": "meaningful_sequence", "1.3.3": "sensory_characteristics",
    "1.3.4": "orientation", "1.3.5": "identify_input_purpose", "1.4.1": "use_of_color", "1.4.2": "audio_control",
    "1.4.3": "contrast_minimum", "1.4.4": "resize_text", "1.4.5": "images_of_text", "1.4.10": "reflow",
    "1.4.11": "non_text_contrast", "1.4.12": "text_spacing", "1.4.13": "content_on_hover_focus",
    "2.1.1": "keyboard", "2.1.2": "no_keyboard_trap", "2.1.4": "character_key_shortcuts",
    "2.2.1": "timing_adjustable", "2.2.2": "pause_stop_hide", "2.3.1": "three_flashes", "2.4.1": "bypass_blocks",
    "2.4.2": "page_titled", "2.4.3": "focus_order", "2.4.4": "link_purpose", "2.4.5": "multiple_ways",
    "2.4.6": "headings_and_labels", "2.4.7": "focus_visible", "2.5.1": "pointer_gestures",
    "2.5.2": "pointer_cancellation", "2.5.3": "label_in_name", "2.5.4": "motion_actuation",
    "3.1.1": "language_of_page", "3.1.2": "language_of_parts", "3.2.1": "on_focus", "3.2.2": "on_input",
    "3.2.3": "consistent_navigation", "3.2.4": "consistent_identification", "3.3.1": "error_identification",
    "3.3.2": "labels_or_instructions", "3.3.3": "error_suggestion", "3.3.4": "error_prevention", "4.1.1": "parsing",
    "4.1.2": "name_role_value", "4.1.3": "status_messages",
}


def _register(criterion: str) -> None:
    @query(
        f"check_{criterion.replace('.', '_')}_{NAMES[criterion]}",
        _with(CHECK_CTES.get(criterion, []), CHECK_SQL[criterion]),
    )
    def plan(spark, sf_dir):
        corpus = seeded.corpus(spark, sf_dir)
        return checks.audit_findings(corpus, [criterion], seeded_flags(spark, sf_dir)).select(*OUT)


for _c in checks.CRITERIA:
    _register(_c)

SQL_FINDINGS = _with(
    [c for cs in CHECK_CTES.values() for c in cs]
    + ["finding AS (" + "\nUNION ALL ".join(f"SELECT * FROM ({CHECK_SQL[c]})" for c in checks.CRITERIA) + ")",
       dimensions.SQL_RULE],
    "",
)


@query("flagged_images", seeded.SQL_CORPUS + f""", fi AS (SELECT doc_id, page_num, seq, block_id, {_IMAGE_KIND} AS kind FROM block)
SELECT * FROM fi WHERE kind IS NOT NULL""")
def flagged_images(spark, sf_dir):
    return checks.flagged_images(seeded.corpus(spark, sf_dir).block)
