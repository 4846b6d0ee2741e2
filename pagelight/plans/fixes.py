"""Deterministic repairs and the language audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelight.operators import checks, dedupe, fixes as X
from pagelight.plans.registry import query
from pagelight.sources import seeded

SQL = seeded.SQL_CORPUS


def _lang(x):
    s = f"substr({x}, 1, 500)"
    return f"""CASE WHEN len(regexp_extract_all({s}, '[一-鿿㐀-䶿぀-ヿ가-힯]')) >= 3 THEN 'zh'
 WHEN regexp_matches({s}, '[ßÄÖü]') AND len(list_distinct(regexp_extract_all({s}, '[äöüßÄÖÜ]'))) >= 2 THEN 'de'
 WHEN regexp_matches({s}, '[çÇœæ]') AND len(list_distinct(regexp_extract_all({s}, '[àâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸ]'))) >= 2 THEN 'fr'
 WHEN regexp_matches({s}, '[ñÑ¿¡]') THEN 'es' ELSE 'en' END"""


@query("language_detection", f"SELECT doc_id, {_lang('text')} AS lang FROM documents")
def language_detection(spark, sf_dir):
    return seeded.read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{X.language_of('text')} AS g").selectExpr(
        "doc_id", "g.lang AS lang")


_SAMPLE = """, sa AS (SELECT doc_id, concat(string_agg(content, ' ' ORDER BY seq), ' ') AS sample FROM block WHERE content <> '' GROUP BY 1)"""


@query("language_tag_fill", SQL + _SAMPLE + f""", lf AS (SELECT d.doc_id, language, nullif(trim(coalesce(meta_language, '')), '') AS m, coalesce(sample, '') AS s
 FROM doc d LEFT JOIN sa USING (doc_id) WHERE trim(coalesce(language, '')) = '')
SELECT doc_id, '(none)' AS before, coalesce(m, {_lang('s')}) AS after, CASE WHEN m IS NOT NULL THEN 'pdf_metadata' WHEN {_lang('s')} <> 'en'
 THEN 'content_heuristic' ELSE 'fallback_en' END AS reason FROM lf""")
def language_tag_fill(spark, sf_dir):
    corpus = seeded.corpus(spark, sf_dir)
    return X.fix_language(corpus.doc, corpus.block)[1].select("doc_id", "before", "after", "reason")


@query("title_fill", SQL + r""", tf AS (SELECT d.doc_id, coalesce(meta_title, '') AS old, h, regexp_replace(regexp_replace(filename, '^.*/', ''), '(.)\.[^.]*$', '\1') AS stem
 FROM doc d LEFT JOIN (SELECT doc_id, trim(arg_min(content, seq)) AS h FROM block WHERE block_type = 'heading' AND trim(content) <> '' GROUP BY 1) USING (doc_id)
 WHERE coalesce(meta_title, '') = '' OR regexp_matches(trim(meta_title), '^[\w\-]+\.\w{2,4}$')),
tg AS (SELECT *, coalesce(h, array_to_string(list_transform(regexp_extract_all(replace(replace(stem, '_', ' '), '-', ' '), '\p{L}+|[^\p{L}]+'),
  lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')) AS new FROM tf)
SELECT doc_id, coalesce(nullif(old, ''), '(none)') AS before, new AS after FROM tg WHERE new <> '' AND new <> old""")
def title_fill(spark, sf_dir):
    corpus = seeded.corpus(spark, sf_dir)
    return X.fix_title(corpus.doc, corpus.block)[1].select("doc_id", "before", "after")


_SCORE = r""", hs0 AS (SELECT doc_id, seq, block_id, rows, rows[1] AS f, list_filter(rows[2:6], lambda r: len(r) > 0) AS d FROM block
 WHERE block_type = 'table' AND coalesce(len(headers), 0) = 0 AND len(rows) > 0 AND len(rows[1]) > 0),
hs1 AS (SELECT *, len(list_distinct(list_transform(f, lambda c: trim(c)))) AS u, list_sum(list_transform(f, lambda c: length(c))) / len(f) AS fa,
 list_avg(list_transform(d, lambda r: list_sum(list_transform(r, lambda c: length(c))) / len(r))) AS da FROM hs0),
hs AS (SELECT *, CASE WHEN len(list_filter(f, lambda c: NOT regexp_matches(trim(c), '^\s*[\d,.\-/:%$€£¥]+\s*$'))) = 0 THEN 0.0 ELSE
 (CASE WHEN u = len(f) THEN 1.0 WHEN u >= len(f) * 0.8 THEN 0.5 ELSE 0.0 END + CASE WHEN len(d) = 0 THEN 0.5 WHEN da > 0 AND fa <= da THEN 1.0
  WHEN da > 0 AND fa <= da * 1.5 THEN 0.5 ELSE 0.0 END) / 2.0 END AS confidence FROM hs1)"""


@query("header_row_score", SQL + _SCORE + "SELECT doc_id, seq, CAST(confidence AS DOUBLE) AS confidence FROM hs")
def header_row_score(spark, sf_dir):
    return X.header_scores(seeded.blocks(spark, sf_dir)).select("doc_id", "seq", "confidence")


@query("header_promotion", SQL + _SCORE + """SELECT b.doc_id, b.seq, coalesce(array_to_string(CASE WHEN h.confidence >= 0.6 THEN b.rows[1] ELSE b.headers END, '|'), '') AS headers,
 coalesce(len(CASE WHEN h.confidence >= 0.6 THEN b.rows[2:] ELSE b.rows END), 0) AS n_rows FROM block b LEFT JOIN hs h ON h.doc_id = b.doc_id AND h.seq = b.seq
 WHERE b.block_type = 'table'""")
def header_promotion(spark, sf_dir):
    fixed, _ = X.promote_headers(seeded.blocks(spark, sf_dir))
    return fixed.filter("block_type = 'table'").selectExpr(
        "doc_id", "seq", "coalesce(array_join(headers, '|'), '') AS headers", "coalesce(size(rows), 0) AS n_rows")


_LEVELS = """, rh0 AS (SELECT doc_id, seq, block_id, coalesce(level, 1) AS old, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS p,
 first_value(coalesce(level, 1)) OVER (PARTITION BY doc_id ORDER BY seq) AS f FROM block WHERE block_type = 'heading'),
rh AS (SELECT *, CASE WHEN f > 1 THEN greatest(1, old - (f - 1)) ELSE old END AS sh FROM rh0),
walk AS (SELECT doc_id, p, sh AS lv FROM rh WHERE p = 1 UNION ALL SELECT r.doc_id, r.p, CASE WHEN w.lv > 0 AND r.sh > w.lv + 1 THEN w.lv + 1 ELSE r.sh END
 FROM walk w JOIN rh r ON r.doc_id = w.doc_id AND r.p = w.p + 1)"""
_RSQL = SQL.replace("WITH ", "WITH RECURSIVE ", 1)


@query("heading_renumber", _RSQL + _LEVELS + """, hx AS (SELECT rh.*, lv FROM rh JOIN walk USING (doc_id, p))
SELECT doc_id, block_id AS element_id, concat('h', old) AS before, concat('h', sh) AS after, 'start_level_normalised' AS reason FROM hx WHERE f > 1
UNION ALL SELECT doc_id, block_id, concat('h', sh), concat('h', lv), 'skipped_level_fixed' FROM hx WHERE sh <> lv""")
def heading_renumber(spark, sf_dir):
    return X.renumber_headings(seeded.blocks(spark, sf_dir))[1].select("doc_id", "element_id", "before", "after", "reason")


@query("reading_order_fix", SQL + """, pg AS (SELECT doc_id, page_num FROM block GROUP BY ALL HAVING count(*) >= 2 AND bool_or(y1 > 0 OR x1 > 0)),
rd AS (SELECT b.*, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY round_even(y1 / 5, 0) * 5, x1, seq) AS np,
 row_number() OVER (PARTITION BY doc_id, page_num ORDER BY seq) AS op FROM block b SEMI JOIN pg USING (doc_id, page_num))
SELECT a.doc_id, concat('page-', a.page_num) AS element_id, CAST(count(*) AS VARCHAR) AS after FROM rd a JOIN rd b ON a.doc_id = b.doc_id
 AND a.page_num = b.page_num AND a.op = b.np WHERE a.block_id <> b.block_id GROUP BY a.doc_id, a.page_num""")
def reading_order_fix(spark, sf_dir):
    return X.fix_reading_order(seeded.blocks(spark, sf_dir))[1].select("doc_id", "element_id", "after")


@query("fix_counts_all_repairs", _RSQL + _SAMPLE + _SCORE + _LEVELS + r""", hx AS (SELECT rh.*, lv FROM rh JOIN walk USING (doc_id, p)),
pg AS (SELECT doc_id, page_num FROM block GROUP BY ALL HAVING count(*) >= 2 AND bool_or(y1 > 0 OR x1 > 0)),
rd AS (SELECT b.*, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY round_even(y1 / 5, 0) * 5, x1, seq) AS np,
 row_number() OVER (PARTITION BY doc_id, page_num ORDER BY seq) AS op FROM block b SEMI JOIN pg USING (doc_id, page_num)),
al AS (SELECT doc_id, 'language_tag' AS fix FROM doc WHERE trim(coalesce(language, '')) = ''
 UNION ALL SELECT doc_id, 'document_title' FROM doc WHERE coalesce(meta_title, '') = '' OR regexp_matches(trim(meta_title), '^[\w\-]+\.\w{2,4}$')
 UNION ALL SELECT doc_id, CASE WHEN confidence >= 0.6 THEN 'table_headers_promoted' ELSE 'table_headers_skipped_low_confidence' END FROM hs
 UNION ALL SELECT doc_id, 'heading_level_adjusted' FROM hx WHERE f > 1 UNION ALL SELECT doc_id, 'heading_level_adjusted' FROM hx WHERE sh <> lv
 UNION ALL SELECT DISTINCT_PAGES.doc_id, 'reading_order_corrected' FROM (SELECT DISTINCT a.doc_id, a.page_num FROM rd a JOIN rd b ON a.doc_id = b.doc_id
  AND a.page_num = b.page_num AND a.op = b.np WHERE a.block_id <> b.block_id) DISTINCT_PAGES)
SELECT doc_id, fix, count(*) AS n FROM al GROUP BY ALL""")
def fix_counts_all_repairs(spark, sf_dir):
    _, rows = X.apply_all(seeded.corpus(spark, sf_dir))
    return rows.groupBy("doc_id", "fix").agg(F.expr("count(*) AS n"))


@query("language_audit", f"""WITH {seeded.SQL_LINES}, lg AS (SELECT doc_id, lang AS labelled, {_lang('text')} AS detected FROM documents),
fs AS (SELECT DISTINCT doc_id FROM lines WHERE regexp_matches(line, '[一-鿿Ѐ-ӿ؀-ۿऀ-ॿ]|[àáâãäåæçèéêëìíîïðñòóôõöùúûüýþÿ]{{3,}}')),
rp AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, upper(trim(line)) AS t FROM lines) GROUP BY doc_id, t HAVING count(*) >= 3)
SELECT labelled, detected, count(*) AS docs, count(fs.doc_id) AS foreign_script_docs, count(rp.doc_id) AS repeated_line_docs,
 round_even(count(fs.doc_id) / count(*), 4) AS foreign_rate FROM lg LEFT JOIN fs USING (doc_id) LEFT JOIN rp ON rp.doc_id = lg.doc_id GROUP BY ALL""")
def language_audit(spark, sf_dir):
    """Labelled against detected language with foreign-script and repeated-line rates."""
    docs = seeded.spread(seeded.read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    kept = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    read = docs.select(
        "doc_id", F.col("lang").alias("labelled"), F.expr(f"{X.language_of('text')}.lang").alias("detected"), kept.alias("lines")
    ).withColumn("foreign", F.coalesce(F.exists("lines", lambda x: x.rlike(checks.text.FOREIGN_SCRIPT)), F.lit(False)))
    # The lines are hashed before they are counted: only their number matters from here on.
    hashed = F.transform("lines", lambda x: F.struct(F.xxhash64(F.upper(F.trim(x))), F.crc32(F.upper(F.trim(x)))))
    keys = ["doc_id", "labelled", "detected", "foreign"]
    counts = read.select(*keys, F.explode_outer(hashed).alias("line")).groupBy(*keys, "line").agg(F.expr("count(line) AS n"))
    flagged = counts.groupBy(*keys).agg(F.expr("max(n) >= 3 AS repeated"))
    return flagged.groupBy("labelled", "detected").agg(
        F.expr("count(*) AS docs"), F.expr("count_if(foreign) AS foreign_script_docs"), F.expr("count_if(repeated) AS repeated_line_docs"),
        F.expr("bround(count_if(foreign) / count(*), 4) AS foreign_rate"))
