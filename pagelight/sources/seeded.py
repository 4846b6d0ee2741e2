"""Corpus tables derived from the given tables, with defects added by rule.

The raw text holds no tables, images, links or form fields, so most audit rules
would be constant on it.  Every expression below is plain SQL over the document
id and the line number and is shared by the Spark loader and the comparison SQL;
``ARR(`` and ``NONE`` stand for the list constructor and the empty string list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.sources.schemas import Corpus

BLOCK_KIND = """CASE WHEN doc_id % 13 = 7 THEN 'paragraph'
 WHEN h % 9 = 0 THEN 'heading' WHEN h % 9 = 3 THEN 'image' WHEN h % 18 = 5 THEN 'table'
 WHEN h % 18 = 14 THEN 'list' WHEN h % 27 = 7 AND doc_id % 2 = 0 THEN 'form_field'
 WHEN h % 211 = 8 THEN 'widget' ELSE 'paragraph' END"""

_W = {f"w{i}": f"split_part(line, ' ', {i})" for i in range(1, 10)}
#: What follows the first words of a line; the last cell or item takes it, so no text is lost.
_W |= {f"r{i}": "substr(line, " + " + ".join(f"length({_W[f'w{k}']}) + 1" for k in range(1, i)) + " + 1)" for i in range(2, 10)}

BLOCK_COLUMNS = {
    "page_num": "CAST(floor(seq / 8) AS INT)",
    "block_id": """CASE WHEN h % 89 = 1 THEN '' WHEN h % 41 = 5 THEN concat('b', CAST(doc_id AS STRING), '_0')
 ELSE concat('b', CAST(doc_id AS STRING), '_', CAST(seq AS STRING)) END""",
    "block_type": "kind",
    "content": """CASE kind
 WHEN 'heading' THEN CASE WHEN h % 54 = 0 THEN '' WHEN h % 63 = 0 THEN 'Contents' ELSE line END
 WHEN 'image' THEN CASE WHEN h % 45 = 3 THEN 'page divider' ELSE '' END
 WHEN 'table' THEN CASE WHEN h % 36 = 5 THEN line ELSE '' END
 WHEN 'list' THEN CASE WHEN h % 3 = 0 THEN line ELSE '' END
 WHEN 'form_field' THEN CASE WHEN h % 3 = 0 THEN '' ELSE line END
 ELSE CASE WHEN h % 29 = 4 THEN 'https://example.org/x'
  WHEN h % 11 = 2 THEN concat(line, ' click here https://example.org/a')
  WHEN h % 31 = 6 THEN concat(line, ' see https://example.org/report for data')
  WHEN h % 23 = 8 THEN concat(line, ' Click the red button.')
  WHEN h % 37 = 1 THEN concat(line, ' 汉字文本')
  WHEN h % 43 = 2 THEN concat('Привет мир ', line)
  WHEN h % 17 = 10 THEN concat('Table ', CAST(h % 5 AS STRING), ': rates')
  WHEN h % 19 = 11 THEN concat('Figure ', CAST(h % 5 AS STRING), ' overview')
  WHEN h % 7 = 1 THEN 'County of Example' ELSE line END END""",
    "x1": "CAST(CASE WHEN doc_id % 17 = 3 THEN 0 WHEN doc_id % 4 = 0 THEN 72 + 216 * (h % 3) ELSE 72 END AS DOUBLE)",
    "y1": """CAST(CASE WHEN doc_id % 17 = 3 THEN 0
 ELSE 40 + (seq % 8) * 85 - CASE WHEN h % 10 = 3 THEN 120 ELSE 0 END END AS DOUBLE)""",
    "x2": """CAST(CASE WHEN doc_id % 17 = 3 THEN 0
 WHEN doc_id % 4 = 0 THEN 72 + 216 * (h % 3) + CASE WHEN kind = 'image' AND h % 27 = 3 THEN 3 ELSE 190 END
 ELSE 72 + CASE WHEN kind = 'image' AND h % 27 = 3 THEN 3 ELSE 420 END END AS DOUBLE)""",
    "y2": """CAST(CASE WHEN doc_id % 17 = 3 THEN 0
 ELSE 70 + (seq % 8) * 85 - CASE WHEN h % 10 = 3 THEN 120 ELSE 0 END END AS DOUBLE)""",
    "confidence": "CAST(0.5 + (h % 50) / 100.0 AS DOUBLE)",
    "source": "CASE WHEN h % 5 = 0 THEN 'ocr' ELSE 'adobe' END",
    "status": "'raw'",
    "level": """CASE WHEN kind = 'heading' AND h % 72 <> 0
 THEN CAST(1 + CAST(floor(h / 9) AS BIGINT) % 7 AS INT) END""",
    "alt": """CASE WHEN kind = 'image' THEN CASE CAST(floor(h / 9) AS BIGINT) % 8
  WHEN 1 THEN '' WHEN 2 THEN 'placeholder' WHEN 3 THEN 'img001.jpg'
  WHEN 4 THEN 'A bar chart of yearly revenue by region' WHEN 5 THEN 'decorative border'
  WHEN 6 THEN line WHEN 7 THEN concat('Photograph of ', line) END END""",
    "src": """CASE WHEN kind = 'image' THEN CASE h % 4
  WHEN 1 THEN 'data:image/png;base64,iVBORw0KGgo=' WHEN 2 THEN 'img/a.png' WHEN 3 THEN '' END END""",
    "image_id": """CASE WHEN kind = 'image' AND h % 4 IN (1, 2)
 THEN concat('img_', CAST(doc_id AS STRING), '_', CAST(seq AS STRING)) END""",
    "caption": """CASE WHEN kind = 'table' THEN CASE h % 5 WHEN 0 THEN NULL WHEN 1 THEN ''
 ELSE concat('Table ', CAST(seq AS STRING), ': ', line) END END""",
    "headers": """CASE WHEN kind = 'table' THEN CASE h % 4 WHEN 0 THEN NULL WHEN 1 THEN NONE
 ELSE ARR({w1}, {w2}, {r3}) END END""",
    "rows": """CASE WHEN kind = 'table' THEN CASE h % 5
  WHEN 0 THEN ARR(ARR({w1}), ARR({r2}))
  WHEN 1 THEN ARR(ARR('1', '2', '3'), ARR({w1}, {w2}, {r3}))
  WHEN 2 THEN ARR(ARR({w1}, {w2}, {w3}), ARR({w4}, {r5}))
  WHEN 3 THEN ARR(ARR('Year', 'Fee', 'Note'), ARR({w1}, {w2}, {w3}), ARR({w4}, {w5}, {r6})) END END""",
    "items": """CASE WHEN kind = 'list' THEN CASE h % 3 WHEN 0 THEN NONE WHEN 1 THEN ARR({w1}, '', {r2})
 ELSE ARR({w1}, {w2}, {r3}) END END""",
    "ordered": "CASE WHEN kind = 'list' THEN h % 2 = 0 END",
    "name": "CASE WHEN kind = 'form_field' THEN CASE h % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE {w1} END END",
    "label": "CASE WHEN kind = 'form_field' THEN CASE WHEN h % 2 = 0 THEN '' ELSE {w2} END END",
    "tooltip": "CASE WHEN kind = 'form_field' THEN CASE WHEN h % 5 = 0 THEN {w3} ELSE '' END END",
}

DOC_COLUMNS = {
    "filename": """CASE doc_id % 6 WHEN 0 THEN concat('doc-', CAST(doc_id AS STRING), '.pdf')
 WHEN 1 THEN concat('Annual Report ', CAST(doc_id AS STRING), '.pdf') WHEN 2 THEN 'untitled.pdf'
 WHEN 3 THEN concat('path/file_', CAST(doc_id AS STRING), '.pdf') WHEN 4 THEN '.pdf'
 ELSE 'd41d8cd98f00b204e9800998ecf8427e.pdf' END""",
    "language": """CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'en' WHEN 2 THEN lang
 WHEN 3 THEN 'english language' END""",
    "meta_title": """CASE doc_id % 4 WHEN 1 THEN '' WHEN 2 THEN concat('report_', CAST(doc_id AS STRING), '.pdf')
 WHEN 3 THEN concat('Budget ', CAST(doc_id AS STRING)) END""",
    "meta_language": "CASE doc_id % 7 WHEN 0 THEN lang WHEN 1 THEN '' END",
    "meta_rotate": "CASE doc_id % 9 WHEN 0 THEN '90' WHEN 1 THEN '0' END",
}

HTML_COLUMN = """replace(CASE WHEN page_id % 11 = 6 THEN replace(replace(base, '<h1>', '<div>'), '</h1>', '</div>')
  ELSE base END,
 '</article>', concat(
 CASE page_id % 3
  WHEN 0 THEN '<table><caption>Fees</caption><thead><tr><th scope="col">Item</th><th>Fee</th></tr></thead><tbody><tr><td>A</td><td>$5</td></tr><tr><td colspan="2">[1] see note</td></tr></tbody></table>'
  WHEN 1 THEN '<table><tbody><tr><td>A</td><td>B</td></tr><tr><td>parcel list</td></tr></tbody></table>' ELSE '' END,
 CASE WHEN page_id % 10 = 7 THEN '<table><thead><tr><th>K</th><th>V</th></tr></thead></table><table><thead></thead><tbody></tbody></table><table><thead><tr><th scope="COL">K</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>' ELSE '' END,
 CASE WHEN page_id % 4 = 1 THEN '<img src="a.png"><img src="" alt="x"><p></p><p><img src="b.png" alt=""></p>' ELSE '' END,
 CASE WHEN page_id % 5 = 2 THEN '<h4>Skipped</h4><p>Equation [3] x</p>' ELSE '' END,
 CASE WHEN page_id % 7 = 3 THEN '<p>The fee is $5 per Schedule</p>' ELSE '' END,
 CASE WHEN page_id % 9 = 4 THEN '<p>a</p><p>b</p><p>c</p><p>d</p><p>e</p><p>f</p>' ELSE '' END,
 CASE WHEN page_id % 6 = 0 THEN '<main><p>body</p></main>' ELSE '' END, '</article>'))"""

HTML_BASE = "CASE WHEN page_id % 8 = 5 THEN replace(replace(html, '<html lang=\"en\">', '<html>'), '<html lang=\"fr\">', '<html lang=\" \">') ELSE html END"


def _spark(text: str) -> str:
    return text.format(**_W).replace("ARR(", "array(").replace("NONE", "cast(array() as array<string>)")


def _duck(text: str) -> str:
    return text.format(**_W).replace("ARR(", "list_value(").replace("NONE", "CAST([] AS VARCHAR[])")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a table has fewer input splits than the cluster has cores.

    Large tables come in more splits than cores and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of every document with their dense position."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return docs.select("doc_id", F.posexplode(kept).alias("seq", "line")).withColumn(
        "h", F.col("doc_id") * 31 + F.col("seq")
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = lines(spark, sf_dir).withColumn("kind", F.expr(BLOCK_KIND))
    return kinds.selectExpr("doc_id", "seq", *[f"{_spark(e)} AS {n}" for n, e in BLOCK_COLUMNS.items()])


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Documents, pages and blocks with seeded defects."""
    docs = read_table(spark, sf_dir, "documents")
    n_lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    pages = F.greatest(F.ceil(n_lines / 8), F.lit(0)) + F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)
    doc = docs.select(
        "doc_id",
        "lang",
        pages.cast("int").alias("page_count"),
        *[F.expr(e).alias(n) for n, e in DOC_COLUMNS.items()],
    ).select(
        "doc_id",
        "filename",
        "page_count",
        "language",
        F.map_filter(
            F.create_map(
                F.lit("title"), F.col("meta_title"), F.lit("language"), F.col("meta_language"),
                F.lit("Rotate"), F.col("meta_rotate"),
            ),
            lambda k, v: v.isNotNull(),
        ).alias("metadata"),
    )
    page = (
        docs.select("doc_id", pages.cast("int").alias("n"))
        .filter("n > 0")
        .select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("page_num"))
        .select(
            "doc_id",
            "page_num",
            F.lit(612.0).alias("width"),
            F.lit(792.0).alias("height"),
            ((F.col("doc_id") + F.col("page_num")) % 9 != 0).alias("has_text"),
        )
    )
    return Corpus(doc, page, blocks(spark, sf_dir))


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, html) with seeded table, image and heading defects."""
    pages = spread(read_table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.withColumn("base", F.expr(HTML_BASE)).select(
        F.col("page_id").alias("doc_id"), F.expr(HTML_COLUMN).alias("html")
    )


# --- the same tables as comparison SQL -------------------------------------

_BLOCK_LIST = ",\n ".join(f"{_duck(e)} AS {n}" for n, e in BLOCK_COLUMNS.items())
_DOC_LIST = ",\n ".join(f"{e} AS {n}" for n, e in DOC_COLUMNS.items())

SQL_LINES = """lines0 AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls
 FROM documents),
lines AS (SELECT doc_id, CAST(p AS INT) - 1 AS seq, ls[p] AS line, doc_id * 31 + p - 1 AS h
 FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM lines0))"""

SQL_BLOCK = f"""{SQL_LINES},
kinds AS (SELECT *, {BLOCK_KIND} AS kind FROM lines),
block AS (SELECT doc_id, seq, {_BLOCK_LIST} FROM kinds)"""

SQL_DOC = f"""doc AS (SELECT d.doc_id, CAST(ceil(coalesce(len(l.ls), 0) / 8) AS INT)
  + CASE WHEN d.doc_id % 10 = 0 THEN 1 ELSE 0 END AS page_count, {_DOC_LIST.replace('doc_id', 'd.doc_id').replace('lang ', 'd.lang ').replace('lang)', 'd.lang)')}
 FROM documents d LEFT JOIN lines0 l ON d.doc_id = l.doc_id),
page AS (SELECT doc_id, CAST(unnest(range(0, page_count)) AS INT) AS page_num FROM doc),
pages1 AS (SELECT doc_id, page_num, (doc_id + page_num) % 9 <> 0 AS has_text, 612.0 AS width, 792.0 AS height FROM page)"""

SQL_CORPUS = f"WITH {SQL_BLOCK},\n{SQL_DOC}\n"

SQL_HTML = f"""html AS (SELECT page_id AS doc_id, {HTML_COLUMN} AS html
 FROM (SELECT *, {HTML_BASE} AS base FROM pages))"""


# --- extraction elements derived from the same lines -------------------------

_R = "(seq % 24)"
ELEMENT_COLUMNS = {
    "Path": f"""CASE WHEN {_R} BETWEEN 4 AND 15 AND doc_id % 3 <> 1 THEN concat('//Document/Table[',
  CAST(CAST(floor(seq / 24) AS INT) + CASE WHEN doc_id % 5 = 2 AND {_R} > 9 THEN 2 ELSE 1 END AS STRING), ']/TR[',
  CAST(CAST(floor(({_R} - 4) / 3) AS INT) + 1 AS STRING), ']/', CASE WHEN {_R} < 7 AND doc_id % 4 = 0 THEN 'TH'
  WHEN {_R} % 3 = 1 AND doc_id % 4 = 2 THEN 'TH' ELSE 'TD' END,
  CASE WHEN doc_id % 7 = 0 AND {_R} < 7 THEN '[1]' ELSE concat('[', CAST(1 + {_R} % 3 AS STRING), ']') END)
 WHEN h % 9 = 0 THEN concat('//Document/H', CAST(1 + h % 3 AS STRING)) WHEN h % 9 = 1 THEN '//Document/Figure'
 WHEN h % 9 = 2 THEN '//Document/L/LI/LBody' WHEN h % 27 = 3 THEN '//Document/L/LI/Lbl'
 WHEN h % 23 = 4 THEN '//Document/Artifact/P' WHEN h % 29 = 5 THEN '//Document/TOC/TOCI'
 WHEN h % 31 = 6 THEN '//Document/Footnote' WHEN h % 37 = 7 THEN '//Document/Link' WHEN h % 41 = 8 THEN '//Document'
 WHEN h % 43 = 9 THEN '//Document/Table/TR/TD/Table/TR/TD/Table' ELSE '//Document/P' END""",
    "Text": f"""CASE WHEN {_R} BETWEEN 4 AND 15 AND doc_id % 3 <> 1 THEN CASE
   WHEN h % 47 = 0 THEN '[1] see above' WHEN h % 53 = 1 THEN 'Note: rounded' WHEN h % 59 = 2 THEN 'equation x'
   WHEN {_R} < 5 AND doc_id % 6 = 0 THEN 'Table 4: Fees' WHEN h % 4 = 3 THEN '$12.50' ELSE line END
 WHEN h % 61 = 0 THEN '' WHEN h % 5 = 3 AND seq % 3 <> 0 THEN 'I' WHEN h % 7 = 3 THEN concat('• ', line)
 WHEN h % 7 = 5 THEN concat('1) ', line) WHEN h % 67 = 6 THEN '12'
 WHEN h % 10 = 7 THEN concat('Figure 2 ', line)
 WHEN h % 11 = 4 THEN concat('I N F R A, JANU ARY. FOO BAR, NEW S; PROGR E S. (<>) ', line)
 WHEN h % 13 = 5 THEN concat(line, ' 1/2/2024 10:30 AM Page 3 of 10') WHEN h % 17 = 4 THEN
  CASE h % 4 WHEN 0 THEN '1. Scope' WHEN 1 THEN '1.2.3 Scope' WHEN 2 THEN 'A.1 Scope' ELSE '(a) scope' END
 ELSE line END""",
    "Page": "CAST(floor(seq / 8) AS INT)",
    "TextSize": "CAST(CASE WHEN h % 8 <> 0 THEN 10 + (h % 9) * 1.25 END AS DOUBLE)",
    "weight": "CAST(400 + (h % 2) * 300 AS DOUBLE)",
    "family": "CASE WHEN h % 3 = 0 THEN 'Arial' WHEN h % 3 = 1 THEN '' END",
    "italic": "h % 5 = 0",
    "role": "CASE WHEN h % 10 = 9 THEN 'Artifact' END",
    "alt_attr": "CASE WHEN h % 18 = 1 THEN 'A map of the district' END",
    "align_attr": "CASE h % 4 WHEN 0 THEN 'Center' WHEN 1 THEN 'Start' WHEN 2 THEN 'Odd' END",
}


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = lines(spark, sf_dir).selectExpr(
        "doc_id", "seq", "line", "h", *[f"{_spark(e)} AS {n}" for n, e in ELEMENT_COLUMNS.items()]
    )
    return flat.selectExpr(
        "doc_id", "seq", "Path", "Text", "Page", "TextSize",
        "named_struct('weight', weight, 'alt_family_name', CASE WHEN seq % 11 = 3 THEN 'Times' END, 'family_name', family, 'name', 'Plain', 'italic', italic) AS Font",
        """map_filter(map('role', CASE WHEN role IS NOT NULL AND Path = '//Document/P' THEN role END, 'Alt', alt_attr,
         'TextAlign', align_attr), (k, v) -> v IS NOT NULL) AS attributes""",
    )


SQL_ELEMENT = f"""WITH {SQL_LINES},
el0 AS (SELECT doc_id, seq, line, h, {", ".join(f"{_duck(e)} AS {n}" for n, e in ELEMENT_COLUMNS.items())} FROM lines),
el AS (SELECT doc_id, seq, h, line, Path, Text, Page, TextSize, weight, family, italic, alt_attr, align_attr,
 CASE WHEN Path = '//Document/P' THEN role END AS role FROM el0)
"""
