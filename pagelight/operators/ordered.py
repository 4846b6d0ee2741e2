"""Operators over the order of blocks: hierarchy, outline, anchors, reading order, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelight.functions import scan, text
from pagelight.functions.text import q, q_blank, q_empty, q_like, q_strip

HEADING = "block_type = 'heading'"
# Patterns of captions, figures and contents headings.
TABLE_CAPTION = r"(?i)^(?:TABLE|FIGURE|CHART|EXHIBIT)\s+\d+[A-Za-z]?\s*[:.\-–—]?\s*(.*)"
IMAGE_CAPTION = r"(?i)^\s*(?:figure\s*\d+[.:]\s*|fig\.\s*\d+[.:]\s*|caption[.:]\s*|source[.:]\s*)"
COMPLEX_WORDS = r"(?i)\b(?:chart|graph|map|diagram|figure\s*\d+)\b"
FIGURE_REFERENCE = r"(?i)\b(?:see\s+figure|as\s+shown\s+in|figure\s+\d+|fig\.\s*\d+)\b"
CONTENTS = r"(?i)^\s*(table\s+of\s+contents|contents)\s*$"
NUMERIC_CELL = r"^[\s$€£]*([\d,]+\.?\d*)\s*%?\s*$"

IS_TABLE_CAPTION = f"""coalesce({q_like('content', TABLE_CAPTION)}
 OR (length(content) < 120 AND startswith(lower(content), 'table')), false)"""


def clamp_levels(heading: DataFrame, level: str, out: str) -> DataFrame:
    """Never more than one level below the previous corrected heading.

    With position p the corrected level is p plus the least (level - p) seen so far,
    so a running minimum replaces the sequential rule.
    """
    placed = scan.running(heading, ["doc_id"], ["seq"], {"__p": scan.row_position()})
    low = scan.running(placed, ["doc_id"], ["seq"], {"__low": scan.running_min(F.expr(f"{level} - __p"))})
    return low.withColumn(out, F.expr("CAST(__p + __low AS INT)")).drop("__p", "__low")


def smooth_levels(block: DataFrame) -> DataFrame:
    """Headings with a level, demoted where they jump; the first is taken as it is."""
    heads = block.filter(f"{HEADING} AND level IS NOT NULL").select("doc_id", "seq", "block_id", "level")
    return clamp_levels(heads, "level", "smoothed")


def enforce_hierarchy(block: DataFrame) -> DataFrame:
    """One title, no jumps, no unused levels.

    A run of level 1 headings that opens the document becomes one heading; later
    level 1 headings drop to 2; jumps are clamped; used levels are numbered densely.
    """
    order = block.select("doc_id", "seq", "block_id", "block_type", "content",
                         F.expr("coalesce(level, 1)").alias("level"))
    opened = scan.running(
        order, ["doc_id"], ["seq"],
        {"__left": scan.running_max(F.expr(f"CASE WHEN {HEADING} AND level = 1 THEN 0 ELSE 1 END"))},
    )
    title = opened.filter("__left = 0").groupBy("doc_id").agg(
        F.expr("min(seq) AS seq"), F.expr("count(*) AS n"),
        F.expr("array_join(transform(array_sort(collect_list(struct(seq, content))), x -> x.content), ' -- ') AS title"),
    )
    heads = opened.filter(HEADING).join(title, ["doc_id", "seq"], "left").filter("__left = 1 OR title IS NOT NULL")
    ones = scan.running(
        heads, ["doc_id"], ["seq"], {"__ones": scan.running_sum(F.expr("CASE WHEN level = 1 THEN 1 ELSE 0 END"))}
    ).selectExpr("doc_id", "seq", "block_id", "coalesce(title, content) AS content",
                 "CASE WHEN level = 1 AND __ones > 1 THEN 2 ELSE level END AS level")
    clamped = clamp_levels(ones, "level", "level2")
    # A level becomes its number among the levels used, 6 at most, so the five smallest of a document are enough.
    nth = Window.partitionBy("doc_id").orderBy("level2")
    used = clamped.select("doc_id", "level2").distinct().withColumn("n", F.row_number().over(nth)).filter("n <= 5")
    lowest = used.groupBy("doc_id").agg(*[F.max(F.when(F.col("n") == n, F.col("level2"))).alias(f"__{n}") for n in range(1, 6)])
    number = " ".join(f"WHEN level2 = __{n} THEN {n}" for n in range(1, 6))
    return clamped.join(lowest, "doc_id").selectExpr("doc_id", "seq", "block_id", "content", f"CASE {number} ELSE 6 END AS level")


def heading_skip_pairs(block: DataFrame) -> DataFrame:
    """Headings more than one level below the previous raw level."""
    heads = block.filter(f"{HEADING} AND level IS NOT NULL").select("doc_id", "seq", "block_id", "level")
    seen = scan.running(heads, ["doc_id"], ["seq"], {"prev_level": scan.previous(F.col("level"))})
    return seen.filter("level > prev_level + 1")


def reading_order(block: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block with page position, fix rows): pages read by 5-unit rows, then left to right."""
    has_box = block.groupBy("doc_id", "page_num").agg(
        F.expr("count(*) AS n"), F.expr("bool_or(y1 > 0 OR x1 > 0) AS boxed")).filter("n >= 2 AND boxed")
    paged = block.join(has_box.select("doc_id", "page_num"), ["doc_id", "page_num"], "left_semi").withColumn(
        "__band", F.expr("bround(y1 / 5.0, 0) * 5"))
    new = scan.running(
        paged, ["doc_id", "page_num"], ["__band", "x1", "seq"], {"new_pos": scan.row_position()},
        segment=[F.floor(F.col("__band") / 100)],
    )
    old = scan.running(new, ["doc_id", "page_num"], ["seq"], {"old_pos": scan.row_position()})
    # Displaced positions are those where the identifiers of the two orders differ.
    at_old = old.select("doc_id", "page_num", F.col("old_pos").alias("pos"), F.col("block_id").alias("old_id"))
    at_new = old.select("doc_id", "page_num", F.col("new_pos").alias("pos"), F.col("block_id").alias("new_id"))
    moved = at_old.join(at_new, ["doc_id", "page_num", "pos"]).filter("old_id <> new_id")
    fixes = moved.groupBy("doc_id", "page_num").agg(F.expr("count(*) AS blocks_reordered"))
    return old.drop("__band"), fixes


def short_runs(paragraph: DataFrame, limit: int = 60) -> DataFrame:
    """Longest run of short paragraphs per document; paragraphs carry a dense ``ord``."""
    marked = paragraph.withColumn("__short", F.expr(f"n_chars < {limit}"))
    runs = scan.running(
        marked, ["doc_id"], ["ord"], {"__stop": scan.last_value(F.expr("CASE WHEN NOT __short THEN ord END"))}
    )
    return runs.groupBy("doc_id").agg(
        F.expr("max(CASE WHEN __short THEN ord - coalesce(__stop, -1) ELSE 0 END) AS longest"))


SLUG = r"""coalesce(nullif(trim('-', regexp_replace(replace(lower(trim(content)), ' ', '-'), r'[^a-z0-9\-]', '')), ''),
 'section')"""


def anchors(heading: DataFrame) -> DataFrame:
    """Anchor id per heading; repeats of a slug are numbered from 2."""
    based = heading.withColumn("base", F.expr(f"substr(concat('sec-', {SLUG}), 1, 50)"))
    counted = scan.running(based, ["doc_id", "base"], ["seq"], {"__n": scan.row_position()})
    return counted.withColumn(
        "anchor", F.expr("CASE WHEN __n = 1 THEN base ELSE concat(base, '-', __n) END")).drop("__n", "base")


def contents_table(heading: DataFrame) -> DataFrame:
    """Entries of the table of contents with the level 2 entry above them; none below three entries."""
    entries = anchors(heading).filter(f"level >= 2 AND NOT {q_like('content', CONTENTS)}")
    enough = entries.groupBy("doc_id").agg(F.expr("count(*) AS n")).filter("n >= 3").select("doc_id")
    kept = entries.join(enough, "doc_id", "left_semi")
    return scan.running(
        kept, ["doc_id"], ["seq"], {"parent_seq": scan.last_value(F.expr("CASE WHEN level = 2 THEN seq END"))}
    ).selectExpr("doc_id", "seq", "level", "anchor", "content",
                 "CASE WHEN level > 2 THEN parent_seq END AS parent_seq")


def table_grid(block: DataFrame) -> DataFrame:
    """Cells of every table; a short row lets its last cell span the missing columns."""
    wide = block.filter("block_type = 'table'").selectExpr(
        "doc_id", "seq", "coalesce(headers, array()) AS headers", "coalesce(rows, array()) AS rows")
    sized = wide.selectExpr(
        "doc_id", "seq",
        "greatest(size(headers), coalesce(array_max(transform(rows, r -> size(r))), 0), 1) AS n_cols",
        "concat(CASE WHEN size(headers) > 0 THEN array(headers) ELSE array() END, rows) AS grid",
        "size(headers) > 0 AS has_head",
    )
    lined = sized.select("doc_id", "seq", "n_cols", "has_head", F.posexplode("grid").alias("row_no", "cells"))
    return lined.select("*", F.posexplode("cells").alias("col_no", "cell")).selectExpr(
        "doc_id", "seq", "row_no", "col_no", "cell", "has_head AND row_no = 0 AS is_header",
        "CASE WHEN col_no = size(cells) - 1 THEN n_cols - size(cells) + 1 ELSE 1 END AS colspan",
        f"(row_no > 0 OR NOT has_head) AND col_no = 0 AND size(cells) >= 2 AND {ROW_HEADER_CELL} AS row_header",
    )


def row_header_cell(x: str) -> str:
    return f"(trim({x}) <> '' AND NOT {q_like(f'trim({x})', NUMERIC_CELL)})"


ROW_HEADER_CELL = row_header_cell("cell")


LAST = 2**31 - 1  # position of the end of a document


def html_escape(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), '\\'', '&#x27;')")


# Cells of a row; a row that is short of ``__cols`` lets its last cell span what is missing.
_SPAN = "CASE WHEN i = size(r) - 1 AND size(r) < __cols THEN concat(' colspan=\"', __cols - size(r) + 1, '\"') ELSE '' END"
_HEAD_CELLS = f"transform(headers, (c, i) -> concat('<th scope=\"col\"', {_SPAN.replace('size(r)', 'size(headers)')}, '>', {html_escape('c')}, '</th>'))"
_ROW_CELLS = f"""transform(r, (c, i) -> CASE WHEN i = 0 AND size(r) >= 2 AND {row_header_cell('c')} THEN concat('<th scope="row">', {html_escape('c')}, '</th>')
  ELSE concat('<td', {_SPAN}, '>', {html_escape('c')}, '</td>') END)"""
FRAGMENT = f"""CASE block_type
 WHEN 'heading' THEN concat('<h', greatest(1, least(6, coalesce(level, 2))), ' id="', anchor, '">', {html_escape('content')}, '</h', greatest(1, least(6, coalesce(level, 2))), '>')
 WHEN 'image' THEN concat('<figure><img src="', {html_escape("coalesce(src, '')")}, '" alt="', {html_escape("coalesce(alt, '')")}, '"></figure>')
 WHEN 'list' THEN concat(CASE WHEN ordered THEN '<ol>' ELSE '<ul>' END, array_join(transform(coalesce(items, array()), i -> concat('<li>', {html_escape('i')}, '</li>')), ''), CASE WHEN ordered THEN '</ol>' ELSE '</ul>' END)
 WHEN 'table' THEN concat('<table>', CASE WHEN coalesce(caption, '') <> '' THEN concat('<caption>', {html_escape('caption')}, '</caption>') ELSE '' END,
  CASE WHEN size(headers) > 0 THEN concat('<thead><tr>', array_join({_HEAD_CELLS}, ''), '</tr></thead>') ELSE '' END,
  CASE WHEN size(rows) > 0 THEN concat('<tbody>', array_join(transform(rows, r -> concat('<tr>', array_join({_ROW_CELLS}, ''), '</tr>')), ''), '</tbody>') ELSE '' END, '</table>')
 ELSE concat('<p>', {html_escape('content')}, '</p>') END"""


def html_fragments(block: DataFrame) -> DataFrame:
    """HTML of every block in order."""
    heads = anchors(block.filter(HEADING)).select("doc_id", "seq", "anchor")
    rest = block.filter(f"NOT coalesce({HEADING}, false)").withColumn("anchor", F.lit(None).cast("string"))
    headed = block.filter(HEADING).join(heads, ["doc_id", "seq"])
    columns = "greatest(size(coalesce(headers, array())), coalesce(array_max(transform(rows, r -> size(r))), 0), 1)"
    return headed.unionByName(rest).withColumn("__cols", F.expr(columns)).selectExpr("doc_id", "seq", f"{FRAGMENT} AS html")


def contents_list(heading: DataFrame) -> DataFrame:
    """(doc_id, seq, part, item, html) of the contents of documents with at least three entries.

    The list stands right after the first heading that says so, else on top (``seq`` -1).  Entries of level 2
    are the outer list, deeper ones the inner list of the entry above.
    """
    entry = scan.running(contents_table(heading), ["doc_id"], ["seq"], {
        "__before": scan.previous(F.col("level")), "__after": scan.following(F.col("level"))})
    items = entry.selectExpr("doc_id", "seq AS item", f"""concat(
     CASE WHEN level > 2 AND __before IS NULL THEN '<li><ol>' ELSE '' END,
     '<li><a href="#', anchor, '">', {html_escape('trim(content)')}, '</a>',
     CASE WHEN level > 2 THEN '</li>' WHEN __after > 2 THEN '<ol>' ELSE '</li>' END,
     CASE WHEN level > 2 AND (__after IS NULL OR __after = 2) THEN '</ol></li>' ELSE '' END) AS html""")
    titled = heading.filter(q_like("content", CONTENTS)).groupBy("doc_id").agg(F.min("seq").alias("at"))
    frame = items.select("doc_id").distinct().selectExpr(
        "doc_id", """inline(array(named_struct('part', 1, 'item', 0, 'html', '<nav aria-label="Table of Contents" id="toc"><h2>Contents</h2><ol>'),
         named_struct('part', 3, 'item', 0, 'html', '</ol></nav>')))""")
    listed = items.selectExpr("doc_id", "2 AS part", "item", "html").unionByName(frame)
    return listed.join(titled, "doc_id", "left").selectExpr("doc_id", "coalesce(at, -1) AS seq", "part", "item", "html")


def html_documents(block: DataFrame, doc: DataFrame) -> DataFrame:
    """(doc_id, seq, part, item, html): the pieces of every HTML document, in the order of these columns.

    A document of any length is rows, never one string: its opening, its contents list, its blocks and its end.
    """
    shell = doc.selectExpr("doc_id", f"""inline(array(
     named_struct('seq', -2, 'part', 0, 'item', 0, 'html', concat('<!DOCTYPE html><html lang="', coalesce(nullif(language, ''), 'en'),
      '"><head><title>', {html_escape("coalesce(metadata['title'], filename)")},
      '</title></head><body><a href="#main-content">Skip to main content</a><main id="main-content">')),
     named_struct('seq', {LAST}, 'part', 0, 'item', 0, 'html', '</main></body></html>')))""")
    body = html_fragments(block).selectExpr("doc_id", "seq", "0 AS part", "0 AS item", "html")
    return shell.unionByName(body).unionByName(contents_list(block.filter(HEADING).select("doc_id", "seq", "level", "content")))


# --- context around images ---------------------------------------------------

_TEXT = "block_type IN ('paragraph', 'heading')"


def image_context(block: DataFrame, each_side: int = 3, reach: int = 6) -> DataFrame:
    """Images with nearby text, the heading above, the caption below and their class."""
    slim = block.selectExpr(
        "doc_id", "seq", "block_id", "block_type", "page_num", "alt", "src", f"{q_strip('content')} AS t")
    spread = scan.with_halo(slim, ["doc_id"], "seq", 9, 6)
    w = "OVER (PARTITION BY doc_id, __segment ORDER BY seq ROWS BETWEEN {} AND {})"
    texts = f"collect_list(CASE WHEN {_TEXT} AND t <> '' THEN t END) "
    looked = spread.selectExpr(
        "*",
        texts + w.format(f"{reach} PRECEDING", "1 PRECEDING") + " AS above",
        texts + w.format("1 FOLLOWING", f"{reach} FOLLOWING") + " AS below",
        texts + w.format("5 PRECEDING", "1 PRECEDING") + " AS above5",
        texts + w.format("1 FOLLOWING", "5 FOLLOWING") + " AS below5",
        "last(CASE WHEN block_type = 'heading' AND t <> '' THEN t END) IGNORE NULLS "
        + w.format("9 PRECEDING", "1 PRECEDING") + " AS heading",
        "lead(struct(block_type, t), 1) OVER (PARTITION BY doc_id, __segment ORDER BY seq) AS n1",
        "lead(struct(block_type, t), 2) OVER (PARTITION BY doc_id, __segment ORDER BY seq) AS n2",
    )

    def is_caption(n: str) -> str:
        return f"({n}.block_type = 'paragraph' AND {q_like(n + '.t', IMAGE_CAPTION)})"

    around = "array_join(concat(above5, below5), ' ')"
    return looked.filter("__core AND block_type = 'image'").selectExpr(
        "doc_id", "seq", "block_id", "page_num", "alt", "src",
        f"array_join(concat(slice(above, greatest(size(above) - {each_side - 1}, 1), {each_side}), "
        f"slice(below, 1, {each_side})), ' ') AS nearby",
        "heading",
        f"""CASE WHEN n1.block_type = 'image' THEN NULL WHEN {is_caption('n1')} THEN n1.t
         WHEN n2.block_type = 'image' THEN NULL WHEN {is_caption('n2')} THEN n2.t END AS caption""",
        f"""CASE WHEN coalesce(alt, '') = '' AND coalesce(src, '') = '' THEN 'decorative'
         WHEN regexp_count({around}, {q(COMPLEX_WORDS)}) > 0 OR regexp_count({around}, {q(FIGURE_REFERENCE)}) >= 2
         THEN 'complex' ELSE 'informative' END AS image_class""",
    )


def attach_table_captions(block: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(caption per table, consumed caption blocks).

    A caption-like paragraph or heading belongs to the first table in the next three
    blocks; a table that has text of its own keeps it, the caption block goes either way.
    """
    slim = block.selectExpr("doc_id", "seq", "block_type", f"{q_strip('content')} AS content")
    near = scan.neighbours(
        slim, ["doc_id"], "seq", {f"n{i}": (i, F.col("block_type")) for i in (1, 2, 3)}
    ).filter(f"block_type IN ('paragraph', 'heading') AND {IS_TABLE_CAPTION}")
    hit = near.selectExpr(
        "doc_id", "seq", "content",
        "seq + CASE WHEN n1 = 'table' THEN 1 WHEN n2 = 'table' THEN 2 WHEN n3 = 'table' THEN 3 END AS table_seq",
    ).filter("table_seq IS NOT NULL")
    first = hit.groupBy("doc_id", "table_seq").agg(F.expr("min_by(content, seq) AS found"))
    tables = slim.filter("block_type = 'table'").selectExpr("doc_id", "seq AS table_seq", "content").join(
        first, ["doc_id", "table_seq"]).selectExpr(
        "doc_id", "table_seq", "coalesce(nullif(content, ''), found) AS caption")
    return tables, hit.select("doc_id", "seq")


def heading_outline(block: DataFrame, page_count: DataFrame) -> DataFrame:
    """Parent of each heading: the nearest earlier heading of a smaller level, whatever the levels are.

    A heading stands once for each larger level of its document, so the scan is one running maximum per level.
    """
    heads = block.filter(f"{HEADING} AND NOT {q_blank('content')}").selectExpr(
        "doc_id", "seq", "coalesce(level, 2) AS level", "page_num")
    levels = heads.groupBy("doc_id").agg(F.collect_set("level").alias("levels"))
    under = heads.join(levels, "doc_id").selectExpr(
        "doc_id", "seq", "level", "page_num", "explode(filter(levels, x -> x >= level)) AS target")
    seen = scan.running(
        under, ["doc_id", "target"], ["seq"],
        {"parent_seq": scan.running_max(F.expr("CASE WHEN level < target THEN seq END"), True)},
    ).filter("level = target")
    return seen.join(page_count.select("doc_id", "page_count"), "doc_id").selectExpr(
        "doc_id", "seq", "level", "parent_seq",
        "greatest(0, least(page_num, page_count - 1)) AS page")


def page_text_spans(block: DataFrame) -> DataFrame:
    """The text of each page as rows: (doc_id, page_num, seq, start, end, content) of every block with content.

    ``start`` and ``end`` count characters of the page's text, in which blocks stand by seq with a space between two.
    The text of a page is never one value, however long it is.
    """
    part = block.filter("content <> ''").select("doc_id", "page_num", "seq", "content", F.length("content").cast("bigint").alias("n"))
    seen = scan.running(part, ["doc_id", "page_num"], ["seq"], {"__before": scan.running_sum(F.col("n") + 1, True)})
    return seen.selectExpr("doc_id", "page_num", "seq", "__before AS start", "__before + n AS end", "content")


def image_text_references(block: DataFrame) -> DataFrame:
    """(doc_id, seq, page_num, at, n_chars) of every image: its place in the text of its page and the length of that text.

    ``at`` is where the text before the image ends, so a reader takes what it needs around it from ``page_text_spans``;
    no text is copied to an image.
    """
    parts = block.select(
        "doc_id", "page_num", "seq", (F.col("block_type") == "image").alias("is_image"),
        F.when(F.col("content") != "", F.length("content").cast("bigint") + 1).otherwise(F.lit(0)).alias("n"))
    seen = scan.running(parts, ["doc_id", "page_num"], ["seq"], {"__before": scan.running_sum(F.col("n"), True)})
    total = parts.groupBy("doc_id", "page_num").agg(F.expr("greatest(sum(n) - 1, 0) AS n_chars"))
    return seen.filter("is_image").join(total, ["doc_id", "page_num"]).selectExpr(
        "doc_id", "seq", "page_num", "greatest(__before - 1, 0) AS at", "n_chars")


def page_text(block: DataFrame) -> DataFrame:
    """All text of a page on every image of that page, as one value each; ``page_text_spans`` and
    ``image_text_references`` say the same without copies."""
    texts = block.filter(f"content <> ''").groupBy("doc_id", "page_num").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(seq, content))), x -> x.content), ' ') AS context"))
    images = block.filter("block_type = 'image'").select("doc_id", "page_num", "seq")
    return images.join(texts, ["doc_id", "page_num"], "left").selectExpr(
        "doc_id", "seq", "page_num", "coalesce(context, '') AS context")


# --- alternative text --------------------------------------------------------

# Shapes of unusable descriptions.
_BAD_PREFIX = r"(?i)^(?:image of|picture of|photo of|photograph of|graphic of|icon of|screenshot of)\b"
_USELESS = (r"(?i)^(?:an? (?:image|picture|photo|graphic|icon|figure|illustration)|image|picture|photo|graphic|figure|"
            r"illustration|untitled|placeholder|a document page|a page from|this is an? )$")
_S = q_strip("alt")
_LOGO = f"(startswith(lower({_S}), 'logo:') OR startswith(lower({_S}), 'seal:'))"
ALT_QUALITY = f"""CASE WHEN {q_like('alt', _BAD_PREFIX)} THEN 'forbidden_prefix'
 WHEN {q_like(f"rtrim('.', {_S})", _USELESS)} THEN 'generic'
 WHEN length({_S}) < 10 AND NOT {_LOGO} THEN 'too_short'
 WHEN {q_like(_S, '^[a-zA-Z]+$')} AND NOT {_LOGO} AND length({_S}) < 50 THEN 'single_word'
 WHEN {q_strip('context')} <> '' AND length({_S}) > 20 AND contains(lower({q_strip('context')}), lower({_S}))
  THEN 'repeats_context' END"""


def draft_eligibility(context: DataFrame) -> DataFrame:
    """Why an image gets a drafted description or not."""
    generic = q_like("alt", r"^\[Figure on page .+ — alt text requires review\]$")
    return context.selectExpr(
        "*",
        f"""CASE WHEN coalesce(alt, '') <> '' AND NOT {generic} THEN 'has_alt'
         WHEN image_class = 'decorative' THEN 'decorative'
         WHEN NOT startswith(coalesce(src, ''), 'data:') THEN 'no_src' ELSE 'eligible' END AS outcome""",
    )


def eligibility_counts(outcome: DataFrame) -> DataFrame:
    kinds = ("has_alt", "decorative", "no_src", "eligible")
    return outcome.groupBy("doc_id").agg(
        F.expr("count(*) AS images"), *[F.expr(f"count_if(outcome = '{k}') AS {k}") for k in kinds])


def alt_text_proposals(image: DataFrame) -> DataFrame:
    """Description proposals of visible images; ``hidden`` marks decorative ones."""
    generic = f"(coalesce(alt, '') = '' OR {q_like('alt', r'^\[Figure on page .+ — alt text requires review\]$')})"
    return image.filter("NOT hidden").selectExpr(
        "doc_id", "block_id", "image_id", "page_num", f"CASE WHEN {generic} THEN '' ELSE alt END AS original_alt",
        f"CASE WHEN {generic} THEN '' ELSE alt END AS proposed_alt", "image_class",
        f"CASE WHEN {generic} THEN 0.0D ELSE 0.8D END AS confidence")


def revert_unapproved(block: DataFrame, approved: DataFrame) -> DataFrame:
    """Images whose identifier was not approved go back to the placeholder text."""
    ok = approved.select("doc_id", "image_id", F.lit(True).alias("ok"))
    return block.filter("block_type = 'image'").join(ok, ["doc_id", "image_id"], "left").selectExpr(
        "doc_id", "block_id", "image_id",
        """CASE WHEN coalesce(image_id, '') <> '' AND ok IS NULL
         THEN concat('[Figure on page ', page_num + 1, ' — alt text requires review]') ELSE alt END AS alt""",
        "coalesce(image_id, '') <> '' AND ok IS NULL AS needs_review",
    )
