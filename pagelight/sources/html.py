"""HTML as a token table, and the text fragments the checks read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.functions.text import q

# Fixed value: elements without an end tag.
VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()
HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>"
TOKEN = r"(?s)<[^>]+>|[^<]+"
CONTAINERS = ("table", "thead", "tbody", "tr", "td", "th", "p", "main", "nav", "article")


def visible(x: str = "html") -> str:
    return f"regexp_replace({x}, {q(HIDDEN)}, '')"


def attr(x: str, name: str) -> str:
    """Value of an attribute in a start tag; null when it is absent."""
    pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    return (f"CASE WHEN {x} rlike {q(pattern)} THEN concat(regexp_extract({x}, {q(pattern)}, 1), "
            f"regexp_extract({x}, {q(pattern)}, 2)) END")


def has_attr(x: str, name: str) -> str:
    return f"({x} rlike {q(rf'(?i)\s{name}(\s|=|>|/)')})"


def all_of(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def tokens(html: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, tag, raw, text) with the containment depth of the usual containers.

    Pages are shuffled before they are split, so the shuffle moves each page once
    and the ordered pass needs no other.
    """
    split = html.repartition("doc_id").select("doc_id", F.posexplode(F.expr(all_of(visible(), TOKEN))).alias("pos", "raw"))
    kinds = split.selectExpr(
        "doc_id", "pos", "raw",
        "CASE WHEN startswith(raw, '</') THEN 'close' WHEN startswith(raw, '<!') THEN 'decl' "
        "WHEN startswith(raw, '<') THEN 'open' ELSE 'text' END AS kind",
        r"lower(regexp_extract(raw, r'^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag",
    ).selectExpr("*", "CASE WHEN kind = 'text' THEN raw END AS text")
    w = "OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    depth = [
        f"CAST(sum(CASE WHEN tag <> '{t}' THEN 0 WHEN kind = 'open' THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END) {w} AS INT) "
        f"AS in_{t}" for t in CONTAINERS
    ]
    count = [f"count_if(kind = 'open' AND tag = '{t}') {w} AS nth_{t}" for t in ("table", "tr")]
    return kinds.selectExpr("doc_id", "pos", "kind", "tag", "raw", "text", *depth, *count)


def table_statistics(token: DataFrame) -> DataFrame:
    """Rows, widest row and header cells per table."""
    cells = token.filter("in_table > 0 AND kind = 'open'").groupBy("doc_id", "nth_table", "nth_tr").agg(
        F.expr("count_if(tag IN ('td', 'th')) AS n_cells"), F.expr("count_if(tag = 'th') AS n_th"),
        F.expr("count_if(tag = 'tr') AS n_tr"))
    return cells.groupBy("doc_id", "nth_table").agg(
        F.expr("sum(n_tr) AS n_rows"), F.expr("max(n_cells) AS n_columns"), F.expr("sum(n_th) AS n_headers"))
