"""Extraction elements: scan, classification, cleanup and reconstruction into blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.functions import scan, text
from pagelight.functions.text import q, q_blank, q_strip

# Path patterns and text shapes of extraction output.
HEADING_PATH = r"/H(\d)(?:\[\d+\])?(?:/|$)"
FIGURE_PATH = r"/Figure(?:\[\d+\])?(?:/|$)"
LIST_PATH = r"/L(?:\[\d+\])?(?:/|$)"
LABEL_PATH = r"/Lbl(?:\[\d+\])?(?:/|$)"
TOC_PATH = r"/TOC(?:\[\d+\])?(?:/|$)"
FOOTNOTE_PATH = r"/Footnote(?:\[\d+\])?(?:/|$)"
TABLE_BASE = r"^(.*?/Table(?:\[\d+\])?)(?:/|$)"
TABLE_CELL = r"/TR(?:\[(\d+)\])?/(TH|TD)(?:\[(\d+)\])?"
BULLET = r"^[•‣◦▪●○–—‐•·\-\*]\s+"
NUMBERED = r"^(?:\d{1,3}[.)]\s+|\([a-zA-Z0-9]+\)\s+|[a-zA-Z][.)]\s+)"
FIGURE_CAPTION = r"(?i)^(?:FIGURE|Fig\.?)\s+\d+"
WORD_SUFFIXES = (
    "AL", "AN", "AR", "ARY", "ATE", "ATED", "ATION", "ATIONS", "C", "CE", "CES", "CTION", "CTURE", "D", "ED",
    "ENCE", "ENT", "ER", "ERN", "ERS", "ES", "FUL", "GE", "IC", "ICS", "IDE", "IES", "ILY", "ING", "ION",
    "IONS", "ISH", "ISM", "IST", "ITY", "IVE", "LY", "MENT", "MENTS", "NESS", "ON", "ORS", "OUS", "OWN", "RY",
    "S", "SE", "SES", "SION", "SIONS", "TION", "TIONS", "TH", "TURE", "TURES", "TY", "URE", "URES", "US", "Y",
)
PAIR_SUFFIXES = (
    "ES", "ED", "ER", "LY", "AL", "IC", "ON", "RY", "TH", "LE", "RE", "TS", "NS",
)
CRITERION_OF = {"image": "1.1.1", "table": "1.3.1", "heading": "2.4.6", "link": "2.4.4", "list": "1.3.1",
                "paragraph": "1.3.2"}

RAW_ELEMENT = (
    "elements array<struct<Path:string,Text:string,Page:int,TextSize:double,Bounds:array<double>,"
    "filePaths:array<string>,attributes:map<string,string>,"
    "Font:struct<weight:double,alt_family_name:string,family_name:string,name:string,italic:boolean>>>"
)


def scan_extraction(raw: DataFrame) -> DataFrame:
    """(doc_id, json) -> one row per element object, keeping its array position.

    A blank document id or an unreadable body gives no rows here; see ``rejected_extractions``.
    """
    parsed = raw.filter(f"NOT {q_blank('CAST(doc_id AS STRING)')}").withColumn(
        "body", F.from_json("json", RAW_ELEMENT)
    )
    return parsed.select("doc_id", F.posexplode("body.elements").alias("seq", "e")).filter("e IS NOT NULL").select(
        "doc_id", "seq", "e.*"
    )


def rejected_extractions(raw: DataFrame) -> DataFrame:
    """Inputs without a document id or without an element list, and why."""
    return raw.selectExpr(
        "doc_id",
        f"""CASE WHEN {q_blank('CAST(doc_id AS STRING)')} THEN 'blank_document_id'
         WHEN {q_blank('json')} THEN 'empty'
         WHEN try_parse_json(json) IS NULL THEN 'not_json' END AS reason""",
    ).filter("reason IS NOT NULL")


def _in_path(*names: str) -> str:
    return text.q_like("coalesce(Path, '')", rf"(?i)//(?:[^/]+/)*(?:{'|'.join(names)})(?:/|$)")


ELEMENT_TYPE = f"""CASE WHEN {_in_path('Figure')} THEN 'image' WHEN {_in_path('Table')} THEN 'table'
 WHEN {_in_path('H[1-6]?', 'Title')} THEN 'heading' WHEN {_in_path('Link', 'Reference')} THEN 'link'
 WHEN {_in_path('L', 'LI', 'LBody')} THEN 'list' ELSE 'paragraph' END"""

TABLES_IN_PATH = "regexp_count(upper(coalesce(Path, '')), 'TABLE')"
COMPLEXITY = f"""CASE element_type
 WHEN 'image' THEN CASE WHEN {q_blank("coalesce(nullif(attributes['Alt'], ''), '')")} THEN 'review' ELSE 'simple' END
 WHEN 'table' THEN CASE WHEN {TABLES_IN_PATH} > 2 THEN 'manual' ELSE 'review' END
 WHEN 'heading' THEN CASE WHEN {q_blank('Text')} THEN 'review' ELSE 'simple' END
 WHEN 'link' THEN CASE WHEN {q_blank('Text')} THEN 'review' ELSE 'simple' END ELSE 'simple' END"""
SEVERITY = """CASE element_type WHEN 'image' THEN 'critical'
 WHEN 'table' THEN CASE WHEN complexity = 'manual' THEN 'critical' ELSE 'serious' END
 WHEN 'link' THEN 'serious' WHEN 'heading' THEN 'moderate' ELSE 'minor' END"""
WANTS_FINDING = f"""NOT (coalesce(attributes['role'], '') = 'Artifact')
 AND NOT {text.q_like(q_strip("coalesce(Path, '')"), r'^//(Document|Sect|Part|Art|Div|Span)$')}
 AND CASE WHEN element_type IN ('image', 'table', 'link', 'heading') THEN true
  WHEN element_type = 'list' THEN NOT (contains(Path, '//LI') OR contains(Path, '//LBody'))
  ELSE {q_blank('Text')} END"""
_PREVIEW = q_strip("substr(coalesce(Text, ''), 1, 80)")
_SHOWN = f"CASE WHEN {_PREVIEW} <> '' THEN concat(' (text: \\'', {_PREVIEW}, '\\')') ELSE '' END"
_AT = "coalesce(Path, '(unknown path)')"
# Sentences of element findings.
DESCRIPTION = f"""CASE
 WHEN element_type = 'image' THEN concat('Image element at ', {_AT}, ' is missing descriptive alt text (WCAG 1.1.1 Level A)', {_SHOWN}, '.')
 WHEN element_type = 'table' AND complexity = 'manual' THEN concat('Deeply nested table (>2 levels) at ', {_AT}, ' requires manual remediation to establish proper header associations (WCAG 1.3.1 Level A).')
 WHEN element_type = 'table' THEN concat('Table at ', {_AT}, ' requires header associations and semantic HTML structure (WCAG 1.3.1 Level A)', {_SHOWN}, '.')
 WHEN element_type = 'heading' THEN concat('Heading element at ', {_AT}, ' needs verified hierarchy and descriptive label (WCAG 2.4.6 Level AA)', {_SHOWN}, '.')
 WHEN element_type = 'link' THEN concat('Link element at ', {_AT}, ' requires meaningful link text for context (WCAG 2.4.4 Level A)', {_SHOWN}, '.')
 WHEN element_type = 'list' THEN concat('List element at ', {_AT}, ' requires proper semantic list structure (WCAG 1.3.1 Level A)', {_SHOWN}, '.')
 ELSE concat('Content element at ', {_AT}, ' must have correct reading order in the tag tree (WCAG 1.3.2 Level A)', {_SHOWN}, '.') END"""
FIX = f"""CASE element_type WHEN 'heading' THEN concat('Verify that \\'', substr(coalesce(Text, ''), 1, 60),
 '\\' uses the correct heading level in the document hierarchy and has a meaningful, descriptive label.') END"""


def classify(element: DataFrame) -> DataFrame:
    typed = element.withColumn("element_type", F.expr(ELEMENT_TYPE))
    typed = typed.withColumn("complexity", F.expr(COMPLEXITY))
    return typed.withColumn("severity", F.expr(SEVERITY))


def with_criterion(typed: DataFrame, dimension: DataFrame) -> DataFrame:
    """Dimension lookup of the success criterion; unknown types read in order (1.3.2)."""
    return typed.join(dimension, "element_type", "left").withColumn(
        "criterion", F.coalesce("criterion", F.lit("1.3.2"))
    )


def criterion_dimension(spark) -> DataFrame:
    return spark.createDataFrame(list(CRITERION_OF.items()), "element_type string, criterion string")


def element_findings(element: DataFrame, dimension: DataFrame) -> DataFrame:
    found = with_criterion(classify(element).filter(WANTS_FINDING), dimension)
    return found.selectExpr(
        "doc_id", "seq", "concat(Path, ':', seq) AS element_id", "element_type", "complexity", "severity", "criterion",
        f"{DESCRIPTION} AS description", f"{FIX} AS suggested_fix",
    )


# Depth of an element path below the document, used by the drafting rules.
NESTING_DEPTH = "CASE WHEN coalesce(Path, '') = '' THEN 0 ELSE regexp_count(Path, '/') - 1 END"
DRAFT_COMPLEXITY = """CASE element_type WHEN 'table' THEN CASE WHEN nesting_depth >= 2 THEN 'manual' ELSE 'review' END
 WHEN 'figure' THEN 'review' WHEN 'heading' THEN 'simple' WHEN 'link' THEN 'simple' ELSE 'review' END"""


def heading_correction_findings(correction: DataFrame, element: DataFrame) -> DataFrame:
    """Heading corrections other than OK as findings, with the text of the element they correct."""
    source = element.selectExpr("doc_id", "concat(Path, ':', seq) AS element_id", "Text AS source_text")
    return correction.filter("flag <> 'OK'").join(source, ["doc_id", "element_id"], "left").selectExpr(
        "doc_id", "element_id", "original", "corrected", "flag",
        "CASE WHEN flag IN ('LEVEL_CORRECTED', 'NEEDS_REVIEW') THEN 'moderate' ELSE 'minor' END AS severity",
        "CASE flag WHEN 'MANUAL' THEN 'manual' WHEN 'NEEDS_REVIEW' THEN 'review' ELSE 'simple' END AS complexity",
        "coalesce(source_text, original) AS source_text",
    )


def artifact(footers: tuple[str, ...] = ()) -> str:
    """Tagged running content; ``footers`` are whole upper-case lines known to repeat."""
    roles = "('pagination', 'artifact', 'header', 'footer')"
    norm = f"regexp_replace(upper({q_strip('coalesce(Text, chr(32))')}), r'\\s+', ' ')"
    known = f"{norm} IN ({', '.join(q(f) for f in footers)})" if footers else "false"
    return f"""({text.q_like("coalesce(Path, '')", "/Artifact|/Header|/Footer|/Pagination")}
 OR lower(coalesce(attributes['TextType'], '')) IN {roles} OR lower(coalesce(attributes['Role'], '')) IN {roles}
 OR {known} OR {text.q_like(q_strip("coalesce(Text, '')"), r'^[0-9]{1,3}$')})"""


def _clean_text(x: str) -> str:
    suffixes = "|".join(sorted(WORD_SUFFIXES, key=len, reverse=True))
    pairs = "|".join(rf"{a}\s{b}" for a, b in PAIR_SUFFIXES)
    steps = [
        (r"\s*\(<>\)\s*", ""),
        (r"(?U)(?<=\b[A-Z]\s[A-Z]) (?=[A-Z]\b)|(?<=\b[A-Z]) (?=[A-Z]\s[A-Z]\b)", ""),
        (rf"(?U)\b([A-Z]{{2,}})(?:\s+({suffixes})\b|(\s+[A-Z]{{1,6}}\b))", "$1$2$3"),
        (rf"(?U)\b([A-Z]{{3,}})\s([A-Z])\s([A-Z])\b(?<=(?:{pairs}))", "$1$2$3"),
        (r"(?iU)\b\d{1,2}/\d{1,2}/\d{2,4}\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?\b", ""),
        (r"[A-Z]:\\[^\s]+", ""),
        (r"(?iU)\bPage\s+\d+\s+of\s+\d+\b", ""),
        ("�", ""),
        (r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""),
    ]
    for pattern, by in steps:
        x = f"regexp_replace({x}, {q(pattern)}, {q(by)})"
    return q_strip(x)


CLEAN_TEXT = _clean_text("coalesce(Text, '')")


def cleaned(element: DataFrame, name: str = "clean") -> DataFrame:
    """Adds the cleaned text, computed once.

    A one-element generator keeps later filters and projections from each copying the
    whole chain of replacements.
    """
    return element.select("*", F.explode(F.array(F.expr(CLEAN_TEXT))).alias(name))

NUMBERING_DEPTH = r"""CASE
 WHEN Text rlike r'^\d+\.(?:\d+\.?)*\s' THEN size(split(rtrim('.', regexp_extract(Text, r'^(\d+\.(?:\d+\.?)*)\s', 1)), r'\.'))
 WHEN Text rlike r'^[A-Z]\.(?:\d+\.?)*\s'
  THEN size(split(rtrim('.', regexp_extract(Text, r'^([A-Z]\.(?:\d+\.?)*)\s', 1)), r'\.'))
 WHEN Text rlike r'^\(\d+\)\s' THEN 1 WHEN Text rlike r'^\([a-z]\)\s' THEN 2 ELSE 0 END"""

STYLE = """named_struct('font_family', coalesce(nullif(Font.alt_family_name, ''), nullif(Font.family_name, ''), nullif(Font.name, '')),
 'bold', coalesce(Font.weight, 400) >= 600, 'italic', coalesce(Font.italic, false), 'size', bround(TextSize, 1),
 'align', CASE WHEN align IN ('left', 'right', 'center', 'justify') THEN align END)"""
ALIGN = """CASE coalesce(nullif(attributes['InlineAlign'], ''), attributes['TextAlign']) WHEN 'Start' THEN 'left'
 WHEN 'End' THEN 'right' WHEN 'Center' THEN 'center' WHEN 'Justify' THEN 'justify'
 ELSE lower(coalesce(nullif(attributes['InlineAlign'], ''), attributes['TextAlign'])) END"""
STYLE_CSS = """concat_ws('; ', concat('font-family: ', style.font_family), concat('font-size: ', style.size, 'pt'),
 CASE WHEN style.bold THEN 'font-weight: bold' END, CASE WHEN style.italic THEN 'font-style: italic' END,
 concat('text-align: ', style.align))"""


def with_style(element: DataFrame) -> DataFrame:
    return element.withColumn("align", F.expr(ALIGN)).withColumn("style", F.expr(STYLE)).drop("align")


_ALT = "coalesce(nullif(alternate_text, ''), nullif(Alt, ''), nullif(attributes['Alt'], ''))"
ALT_TEXT = f"coalesce({_ALT}, concat('[Figure on page ', coalesce(CAST(Page AS STRING), '?'), ' — alt text requires review]'))"
ALT_NEEDS_REVIEW = f"{_ALT} IS NULL"


# --- ordered reconstruction --------------------------------------------------


def merge_fragments(element: DataFrame) -> DataFrame:
    """Prefix one- or two-letter capital fragments to the element that continues them.

    In a run of eligible elements only every other pair merges, because the
    absorbed element is used up; the parity inside the run decides.
    """
    plain = f"""NOT {text.q_like("coalesce(Path, '')", HEADING_PATH)} AND NOT {text.q_like("coalesce(Path, '')", FIGURE_PATH)}
     AND NOT contains(coalesce(Path, ''), '/Table')"""
    t = q_strip("coalesce(Text, '')")
    marked = element.withColumns({
        "__t": F.expr(t),
        "__fragment": F.expr(f"length({t}) <= 2 AND {t} rlike r'(?U)\\p{{Lu}}' AND upper({t}) = {t} AND {plain}"),
        "__receives": F.expr(f"{t} rlike r'^\\p{{Lu}}' AND {plain}"),
    })
    ahead = scan.neighbours(
        marked, ["doc_id"], "seq",
        {"__next": (1, F.col("__receives")), "__above": (-1, F.struct("__t", "__fragment"))},
    ).withColumns({
        "__pair": F.expr("__fragment AND coalesce(__next, false)"),
        "__pair_above": F.expr("coalesce(__above.__fragment, false) AND __receives"),
    })
    stop = F.expr("CASE WHEN NOT __pair THEN seq END")
    runs = scan.running(
        ahead, ["doc_id"], ["seq"],
        {"__stop": scan.last_value(stop), "__stop_above": scan.last_value(stop, exclusive=True)},
    )
    out = runs.selectExpr(
        "*", "__pair AND (seq - coalesce(__stop, -1)) % 2 = 1 AS __merge",
        "CASE WHEN __pair_above AND (seq - 1 - coalesce(__stop_above, -1)) % 2 = 1 THEN __above.__t END AS __prefix",
    ).filter("NOT __merge")
    merged = out.withColumn("Text", F.expr("CASE WHEN __prefix IS NOT NULL THEN concat(__prefix, __t) ELSE Text END"))
    return merged.select(*element.columns)


def infer_heading_levels(element: DataFrame) -> DataFrame:
    """(doc_id, size, level): larger type ranks higher, at most six levels."""
    sized = element.filter(f"{text.q_like('Path', HEADING_PATH)} AND TextSize IS NOT NULL")
    sizes = sized.groupBy("doc_id", F.expr("bround(TextSize, 1) AS size")).agg(
        F.expr("max(coalesce(Font.weight, 400.0D)) AS weight")
    )
    from pyspark.sql import Window

    # One row per distinct type size of a document.
    order = Window.partitionBy("doc_id").orderBy(F.col("size").desc(), F.col("weight").desc())
    return sizes.select("doc_id", "size", F.least(F.row_number().over(order), F.lit(6)).alias("level"))


def table_ranges(element: DataFrame) -> DataFrame:
    """Table elements with the number of the run of equal table paths they belong to.

    A run ends where the table path changes.  (Comparing by prefix, as extraction
    tools do, would also absorb a neighbour whose path merely starts the same.)
    """
    based = element.withColumn("base", F.expr(f"nullif(regexp_extract(coalesce(Path, ''), {q(TABLE_BASE)}, 1), '')"))
    seen = scan.neighbours(based, ["doc_id"], "seq", {"__before": (-1, F.col("base"))})
    starts = seen.withColumn(
        "__start", F.expr("CASE WHEN base IS NOT NULL AND NOT coalesce(__before = base, false) THEN 1 ELSE 0 END"))
    numbered = scan.running(starts, ["doc_id"], ["seq"], {"table_no": scan.running_sum(F.col("__start"))})
    return numbered.filter("base IS NOT NULL").drop("__before", "__start")


def table_cells(element: DataFrame) -> DataFrame:
    """Cells of each table and page; text fragments of one cell joined in order."""
    cells = cleaned(table_ranges(element)).selectExpr(
        "doc_id", "table_no", "coalesce(Page, 0) AS page", "seq", "clean AS text",
        f"regexp_extract(Path, {q(TABLE_CELL)}, 0) AS at",
        f"coalesce(try_cast(regexp_extract(Path, {q(TABLE_CELL)}, 1) AS INT), 0) AS row",
        f"regexp_extract(Path, {q(TABLE_CELL)}, 2) AS cell_type",
        f"coalesce(try_cast(regexp_extract(Path, {q(TABLE_CELL)}, 3) AS INT), 0) AS col",
    ).filter("text <> '' AND at <> ''")
    keyed = cells.withColumn("sort_key", F.expr("col * 2 + CASE WHEN cell_type = 'TH' THEN 0 ELSE 1 END"))
    # One shuffle by table page serves the cells, the rows and the header choice.
    return keyed.repartition(*TABLE_KEYS).groupBy("doc_id", "table_no", "page", "row", "sort_key").agg(
        F.expr("min_by(cell_type, seq) AS cell_type"),
        F.expr("array_join(transform(array_sort(collect_list(struct(seq, text))), x -> x.text), ' ') AS text"),
    )


TABLE_KEYS = ["doc_id", "table_no", "page"]
CURRENCY = r"^[\$\€\£]?\s*[\d,]+\.?\d*\s*%?$"


def table_rows(cells: DataFrame) -> DataFrame:
    """One row per table row with its cells in column order."""
    return cells.groupBy(*TABLE_KEYS, "row").agg(
        F.expr("array_sort(collect_list(struct(sort_key, cell_type, text))) AS cells")
    ).selectExpr(
        *TABLE_KEYS, "row", "transform(cells, c -> c.text) AS texts", "transform(cells, c -> c.cell_type) AS types"
    )


def header_rows(rows: DataFrame) -> DataFrame:
    """The header row of each table, by a falling list of rules."""
    th, td = "array_contains(types, 'TH')", "array_contains(types, 'TD')"
    numeric = f"size(filter(texts, t -> t rlike {q(CURRENCY)}))"
    return rows.groupBy(*TABLE_KEYS).agg(
        F.expr(f"""coalesce(min(CASE WHEN {th} AND NOT {td} AND size(texts) >= 2 THEN row END),
         min(CASE WHEN {th} AND {td} THEN row END),
         min(CASE WHEN size(texts) >= 2 AND NOT {numeric} > size(texts) / 2 THEN row END),
         min(CASE WHEN size(texts) >= 2 THEN row END), min(row)) AS header_row""")
    )


def split_tables(rows: DataFrame) -> DataFrame:
    """Rows with their part in the table: caption, heading, header, extra_header, data,
    paragraph, footnote or dropped.

    Rows above the header are captions or headings, except a row with plain cells
    directly above it, which extends it.  The first footnote row turns everything
    below it into footnotes.
    """
    page = "PARTITION BY doc_id, table_no, page"
    running = f"({page} ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    th, td = "array_contains(types, 'TH')", "array_contains(types, 'TD')"
    numeric = f"size(filter(texts, t -> t rlike {q(CURRENCY)}))"
    rules = [f"{th} AND NOT {td} AND size(texts) >= 2", f"{th} AND {td}",
             f"size(texts) >= 2 AND NOT {numeric} > size(texts) / 2", "size(texts) >= 2", "true"]
    header = ", ".join(f"min(CASE WHEN {r} THEN row END) OVER ({page})" for r in rules)
    headed = rows.selectExpr("*", f"coalesce({header}) AS header_row")
    above = headed.selectExpr("*", f"max(CASE WHEN row < header_row THEN row END) OVER ({page}) AS above_row")
    extra = above.selectExpr("*", f"max(CASE WHEN row = above_row AND {td} THEN row END) OVER ({page}) AS extra_row")
    marked = extra.selectExpr(
        "*",
        "array_join(filter(texts, t -> trim(t) <> ''), ' — ') AS joined",
        "row > header_row AND size(texts) = 1 AND startswith(lower(texts[0]), 'equation') AS dropped",
        r"""row > header_row AND (texts[0] rlike r'^\[\d+\]' OR (size(texts) = 1
         AND texts[0] rlike r'(?i)^(?:Source|Note|Notes)\s*:')) AS opens_notes""",
        "row < header_row AND NOT coalesce(row = extra_row, false) AS lead",
    ).withColumn("captions", F.expr(r"lead AND joined rlike r'(?i)^Table\s+\d+[A-Za-z]?\s*[-:.]\s*.+$'"))
    noted = marked.selectExpr(
        "*", f"coalesce(bool_or(opens_notes AND NOT dropped) OVER {running}, false) AS notes",
        f"count_if(captions) OVER {running} AS n_caption",
    ).withColumn("candidate", F.expr("row > header_row AND NOT dropped AND NOT notes"))
    counted = noted.selectExpr(
        "*",
        f"coalesce(bool_or(candidate AND size(texts) >= 2) OVER {running}, false) AS seen",
        f"count_if(candidate AND size(texts) >= 2) OVER ({page}) AS n_multi",
        f"count_if(candidate AND size(texts) = 1) OVER ({page}) AS n_single",
        f"""max(CASE WHEN row = header_row THEN size(texts) END) OVER ({page})
         + coalesce(max(CASE WHEN row = extra_row THEN size(filter(types, t -> t = 'TD')) END) OVER ({page}), 0)
         AS n_head""",
    )
    return counted.selectExpr(
        *TABLE_KEYS, "row", "texts", "types", "joined",
        """CASE WHEN row = header_row THEN 'header' WHEN coalesce(row = extra_row, false) THEN 'extra_header'
         WHEN lead THEN CASE WHEN captions AND n_caption = 1 THEN 'caption' WHEN trim(joined) = '' THEN 'dropped'
          ELSE 'heading' END
         WHEN dropped THEN 'dropped' WHEN notes THEN 'footnote'
         WHEN n_head >= 2 AND n_multi = 0 AND n_single > 0 THEN 'data'
         WHEN n_head >= 2 AND size(texts) = 1 THEN CASE WHEN seen THEN 'footnote' ELSE 'paragraph' END
         ELSE 'data' END AS part""",
    )


def assemble_tables(split: DataFrame) -> DataFrame:
    """(doc_id, table_no, page, caption, headers, rows)."""
    return split.groupBy(*TABLE_KEYS).agg(
        F.expr("max(CASE WHEN part = 'caption' THEN joined END) AS caption"),
        F.expr("""flatten(transform(array_sort(collect_list(CASE WHEN part = 'header' THEN struct(0 AS k, texts)
         WHEN part = 'extra_header' THEN struct(1 AS k,
          transform(filter(arrays_zip(texts, types), z -> z.types = 'TD'), z -> z.texts) AS texts) END)),
         s -> s.texts)) AS headers"""),
        F.expr("""transform(array_sort(collect_list(CASE WHEN part = 'data' THEN struct(row, texts) END)),
         s -> s.texts) AS rows"""),
    )


def list_items(element: DataFrame) -> DataFrame:
    """List items with the list they belong to: consecutive items of one kind; skipped rows do not end a list."""
    rows = cleaned(element).selectExpr(
        "doc_id", "seq", "coalesce(Page, 0) AS page", "Path", "clean AS text", f"{artifact()} AS artifact",
        f"{text.q_like('Path', TOC_PATH)} AS toc", f"{text.q_like('Path', LABEL_PATH)} AS label",
        f"{text.q_like('Path', LIST_PATH)} AS in_list",
        f"{text.q_like('Path', HEADING_PATH)} OR {text.q_like('Path', FOOTNOTE_PATH)} AS titled",
        f"{text.q_like('Path', FIGURE_PATH)} AS figure", "contains(Path, '/Table') AS tabular",
    )
    live = rows.filter("NOT toc AND NOT artifact AND (figure OR (text <> '' AND (titled OR NOT label))) OR tabular")
    kinds = live.selectExpr(
        "doc_id", "seq", "page",
        f"""CASE WHEN tabular OR figure OR titled THEN NULL WHEN {text.q_like('text', BULLET)} THEN 'bullet'
         WHEN {text.q_like('text', NUMBERED)} THEN 'number' WHEN in_list THEN 'bullet' END AS kind""",
        q_strip(f"regexp_replace(text, {q('(?:' + BULLET + ')|(?:' + NUMBERED + ')')}, '')") + " AS item",
    ).filter("kind IS NULL OR item <> ''")
    seen = scan.running(kinds, ["doc_id"], ["seq"], {"__before": scan.previous(F.col("kind"))})
    breaks = seen.withColumn("__break", F.expr("CASE WHEN kind IS NOT NULL AND NOT coalesce(__before = kind, false) THEN 1 ELSE 0 END"))
    numbered = scan.running(breaks, ["doc_id"], ["seq"], {"list_no": scan.running_sum(F.col("__break"))})
    return numbered.filter("kind IS NOT NULL").selectExpr(
        "doc_id", "list_no", "seq", "page", "kind = 'number' AS ordered", "item")


def list_blocks(items: DataFrame) -> DataFrame:
    """One row per list with its items in order."""
    return items.groupBy("doc_id", "list_no").agg(
        F.expr("min(seq) AS first_seq"), F.expr("min_by(page, seq) AS page"), F.expr("bool_and(ordered) AS ordered"),
        F.expr("transform(array_sort(collect_list(struct(seq, item))), x -> x.item) AS items"),
    )


def figure_captions(element: DataFrame) -> DataFrame:
    """Figures with the caption that directly follows them; that element is used up."""
    marked = cleaned(element).selectExpr("doc_id", "seq", "Page", "Path", "clean AS text",
                                f"{text.q_like('Path', FIGURE_PATH)} AS figure")
    seen = scan.neighbours(marked, ["doc_id"], "seq", {"__next": (1, F.struct("seq", "text"))})
    return seen.filter("figure").selectExpr(
        "doc_id", "seq", "Page",
        f"CASE WHEN {text.q_like('__next.text', FIGURE_CAPTION)} THEN __next.text END AS caption",
        f"CASE WHEN {text.q_like('__next.text', FIGURE_CAPTION)} THEN __next.seq END AS consumed_seq",
    )


def elements_to_blocks(typed: DataFrame, raw: DataFrame, doc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reconstructed elements -> (document, block); a document without blocks gets one empty page.

    The page count reads the raw elements, so pages whose elements were dropped still count.
    """
    known = "('heading', 'paragraph', 'table', 'image', 'list', 'form_field')"
    block = typed.selectExpr(
        "doc_id", "seq", "coalesce(page, 0) AS page_num",
        f"CASE WHEN type IN {known} THEN type ELSE 'paragraph' END AS block_type", "coalesce(content, '') AS content",
    )
    counts = raw.groupBy("doc_id").agg(F.expr("max(coalesce(Page, 0)) + 1 AS page_count"))
    docs = doc.select("doc_id").join(counts, "doc_id", "left").selectExpr(
        "doc_id", "coalesce(page_count, 1) AS page_count")
    return docs, block


def heading_guess(pages: DataFrame) -> DataFrame:
    """Plain page text -> elements, guessing headings from capitals.

    ``istitle`` needs an upper-case letter first in every word and lower case after it.
    """
    paras = pages.select("doc_id", "page_num", F.posexplode(F.split("text", "\n\n")).alias("ord", "raw")).withColumn(
        "Text", F.expr(q_strip("raw"))).filter("Text <> ''")
    caps = r"Text rlike r'\p{L}' AND upper(Text) = Text AND lower(Text) <> Text"
    title = r"Text rlike r'\p{Lu}' AND NOT Text rlike r'(?<!\p{L})\p{Ll}|(?<=\p{L})\p{Lu}'"
    return paras.selectExpr(
        "doc_id", "page_num AS Page", "ord", "Text",
        f"""CASE WHEN {caps} AND length(Text) < 60 THEN '//Document/H1' WHEN {caps} AND length(Text) < 120
         THEN '//Document/H2' WHEN {title} AND length(Text) < 80 AND NOT contains(Text, '\\n') THEN '//Document/H3'
         ELSE '//Document/P' END AS Path""",
    )
