"""One registered query per operator over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelight.llm import decontaminate, exact, language, mixing, near, pages, periodic, personal, substrings, tokens, toxicity, trie, vectors

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
COMPARISONS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan: Plan) -> Plan:
        PLANS[name] = plan
        if sql is not None:
            COMPARISONS[name] = sql
        return plan

    return register


def blocks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """``documents`` as text blocks, one per document."""
    return as_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def as_blocks(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id", F.col("text").alias("content"), F.col("lang").alias("language"), "source")


def remainder(n: int) -> Column:
    """Remainder of the CRC of doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@query("op5_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = blocks(spark, sf_dir)
    model = language.fit(block.filter(remainder(5) != 0))
    found = language.identify(block, model)
    return found.select(
        "doc_id", (remainder(5) == 0).alias("held_out"), F.col("language_pred").alias("lang_pred"), "score", "rejected")


@query("op8_exact_dedup", r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(blocks(spark, sf_dir), earlier_half(blocks(spark, sf_dir)))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def earlier_half(block: DataFrame) -> Column:
    """The lower half of the range of ids stands for the content of earlier runs."""
    low, high = block.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.col("doc_id") < ((low or 0) + (high or 0)) // 2


@query("op6_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(blocks(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op4_ngram_jaccard", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS i FROM w)),
c AS (SELECT min(doc_id) OVER (PARTITION BY shingles) AS class_id, doc_id, n
      FROM (SELECT doc_id, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS shingles, count(*) AS n FROM s GROUP BY doc_id)),
r AS (SELECT shingle, class_id, n FROM s JOIN c USING (doc_id) WHERE doc_id = class_id),
l AS (SELECT a.class_id AS a, b.class_id AS b FROM r a JOIN r b USING (shingle) WHERE a.class_id <> b.class_id
      GROUP BY a.class_id, b.class_id HAVING count(*) * 5 >= 4 * (any_value(a.n) + any_value(b.n) - count(*))),
g(id, root) AS (SELECT a, b FROM l UNION SELECT g.id, l.b FROM g JOIN l ON g.root = l.a),
m AS (SELECT id, least(id, min(root)) AS group_id FROM g GROUP BY id),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links,
       coalesce(group_id, class_id, doc_id) AS group_id, coalesce(n, 0) AS n_shingles
FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN k ON k.a = class_id LEFT JOIN m ON m.id = class_id""")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(blocks(spark, sf_dir))


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` as golden passages."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("content"))


@query("op2_decontamination", r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS words FROM t),
i AS (SELECT id, least(5, len(words)) AS width, words FROM w WHERE kind = 'i' AND len(words) > 0),
s AS (SELECT DISTINCT id AS item_id, array_to_string(list_slice(words, k, k + width - 1), ' ') AS shingle, width
      FROM (SELECT *, unnest(range(1, len(words) - width + 2)) AS k FROM i)),
d AS (SELECT DISTINCT id AS doc_id, width, array_to_string(list_slice(words, k, k + width - 1), ' ') AS shingle
      FROM (SELECT *, unnest(range(1, greatest(len(words) - width + 2, 1))) AS k
            FROM (SELECT w.id, w.words, x.width FROM w, (SELECT DISTINCT width FROM i) x WHERE kind = 'd'))),
n AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM d JOIN s USING (shingle, width) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) * 5 >= 4 * n_shingles""")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_passages(blocks(spark, sf_dir), golden(spark, sf_dir))


@query("op3_substring_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 49), ' ')) AS h
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 48, 1))) AS i FROM w)),
f AS (SELECT h, min(doc_id) AS first FROM p GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i FROM p JOIN f USING (h) WHERE doc_id > first), range(50) r(k)),
n AS (SELECT w.doc_id, i, words[i] AS word, len(words) AS n_words
      FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM w) w),
k AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept FROM n ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)""")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeated_passages(blocks(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("content", 256).alias("kept_sha256"))


@query("op1_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumnRenamed("page_id", "doc_id")
    found = pages.main_text(page)
    return found.select(
        F.col("doc_id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "lines_deleted")


@query("op7_toxicity")
def score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = blocks(spark, sf_dir)
    status = F.when(F.col("toxic") == 1, toxicity.FLAGGED).when(F.col("toxic") == 0, toxicity.APPROVED)
    review = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", status.alias("status"))
    model = toxicity.fit(block, review.filter(remainder(3) != 1))
    return toxicity.toxicity(block, model).select(
        "doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op9_personal_data")
def find_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.personal_data(blocks(spark, sf_dir))
    return found.select(
        "doc_id", *[personal.counted(kind) for kind in personal.BASE_KINDS],
        F.expr(f"sha2({personal.listed('spans', *personal.BASE_KINDS)}, 256)").alias("base_sha256"),
        F.expr(personal.listed("spans")).alias("spans"))


@query("op10_token_counts")
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.token_counts(blocks(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("over_limit", F.col("n_tokens") > 4096)


#: DuckDB: unsigned CRC-32 of a number as decimal text.
CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({}::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda e, i: xor(e >> 1, 3988292384 * (e & 1)))), 4294967295)"""


@query("op12_periodic_runs", rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, {CRC.format("doc_id")} AS h FROM documents),
a AS (SELECT *, len(words) AS n, (h // 10) % greatest(len(words), 1) AS a, 3 + (h // 10) % 8 AS parts FROM w),
x AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN
        list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END])
        ELSE words END AS words FROM a),
s AS (SELECT doc_id, n, i, md5(array_to_string(list_slice(words, i + 1, i + 6), ' ')) AS h
      FROM (SELECT *, unnest(range(greatest(n - 5, 0))) AS i FROM x)),
e AS (SELECT s.doc_id, s.i, t.i - s.i AS period FROM s JOIN s t USING (doc_id, h) WHERE t.i > s.i AND 2 * (t.i - s.i) <= s.n),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS island FROM e),
m AS (SELECT doc_id, min(i) AS start, max(i) - min(i) + 6 + period AS length, period FROM g GROUP BY doc_id, period, island),
r AS (SELECT * FROM m WHERE length >= greatest(12, 2 * period)
      QUALIFY row_number() OVER (PARTITION BY doc_id, start, length ORDER BY period) = 1),
d AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period)) AS runs_sha256
      FROM r GROUP BY doc_id),
b AS (SELECT *, 1000 * length // period AS exponent_milli FROM r
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
o AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256
      FROM (SELECT doc_id, unnest(words) AS word, unnest(range(n)) AS i FROM x) ANTI JOIN o USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256,
       coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM x LEFT JOIN d USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)""")
def find_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document, by the CRC of its id, has its words from one place on repeated with one period."""
    given = blocks(spark, sf_dir).select("doc_id", "content", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    cut_up = F.filter(F.split(F.col("content"), r"[\x20\x09-\x0D]+"), lambda word: word != "")
    repeated = F.expr("""array_join(transform(words, (word, i) -> get(words, cast(
        if(i < a, i, a + (i - a) % (1 + (size(words) - a) div (3 + g % 8))) AS int))), ' ')""")
    block = (
        given.withColumn("words", F.when(F.expr("h % 10 = 0"), cut_up)).withColumn("g", F.expr("h div 10"))
        .withColumn("a", F.expr("g % nullif(size(words), 0)"))
        .select("doc_id", F.when(F.expr("size(words) > 0"), repeated).otherwise(F.col("content")).alias("content"))
    )
    found = periodic.periodic_runs(block).withColumn("best", periodic.longest_run("runs"))
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("content", 256).alias("collapsed_sha256"))


@query("op13_conversation_trie", f"""
WITH n AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {CRC.format("conv_id")} % 6 AS h FROM n),
t AS (SELECT c.conv_id, pos, role, text FROM c JOIN n ON n.conv_id = base AND pos < h
      UNION ALL SELECT conv_id, pos, role, text FROM c JOIN n USING (conv_id) WHERE pos >= h),
s AS (SELECT conv_id, coalesce(list(md5(concat(length(role), ':', role, text)) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS codes,
             coalesce(list(length(text) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS sizes
      FROM c LEFT JOIN t USING (conv_id) GROUP BY conv_id),
p AS (SELECT conv_id, depth, array_to_string(list_slice(codes, 1, depth), ' ') AS k, CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS size,
             depth = len(codes) AS ends
      FROM (SELECT *, unnest(range(len(codes) + 1)) AS depth FROM s)),
v AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
      FROM p GROUP BY k, depth),
u AS (SELECT v.k, q.k AS parent FROM v JOIN p q ON q.conv_id = v.conv_id AND q.depth = v.depth - 1),
e AS (SELECT parent AS k, count(*) AS n_children FROM u GROUP BY parent),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN e USING (k)),
b AS (SELECT q.k, sum((n_convs - 1) * w.size)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
      FROM w JOIN p q ON q.conv_id = w.conv_id AND q.depth <= w.depth GROUP BY q.k)
SELECT w.conv_id, w.depth, x.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM w JOIN b USING (k) LEFT JOIN u USING (k) LEFT JOIN v x ON x.k = u.parent""")
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as audit trails; each begins with turns of the conversation whose id ends its hundred."""
    turn = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("action"), F.coalesce("text", F.lit("")).alias("new_value"))
    order = Window.partitionBy("conv_id").orderBy("turn", "action", "new_value")
    turn = turn.withColumn("id", F.row_number().over(order) - 1)
    h = F.expr("crc32(cast(conv_id AS string)) % 6")
    conv = turn.select("conv_id").distinct()
    head = turn.filter("conv_id % 100 = 0 AND id < 5").drop("turn").withColumnRenamed("conv_id", "base")
    given = conv.withColumn("base", F.expr("conv_id - conv_id % 100")).join(head, "base").filter(F.col("id") < h)
    kept = turn.filter(F.col("id") >= h)
    columns = [F.col("conv_id").alias("entity_id"), "id", "action", "new_value"]
    audit = given.select(*columns).unionByName(kept.select(*columns))
    found = trie.prefix_trie(audit, conv.withColumnRenamed("conv_id", "entity_id"))
    return found.select(
        F.col("entity_id").alias("conv_id"), "depth", F.col("parent_entity_id").alias("parent_conv_id"), F.col("n_entities").alias("n_convs"),
        "n_children", "n_leaves", F.col("saved_chars").alias("saved_tokens"), "ends_sha256")


@query("op11_exact_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, (row_number() OVER w)::INTEGER AS rank, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_inner_product(q.vec, c.vec) DESC, c.vec_id)
QUALIFY row_number() OVER w <= 5""")
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    return vectors.top_k(given, given.filter("vec_id % 50 = 0"))
