"""Filling a missing language reads only the documents that need it, and only their opening text."""

import random

from pagelight.operators import fixes

LETTERS = {"de": "Über Größe und Maß ", "fr": "Ça où élève ", "es": "¿Qué año? ", "ja": "ひらがな ", "en": "plain words "}


def test_fill(spark, tiny_segments):
    rng = random.Random(4)
    docs, blocks, want = [], [], {}
    for d in range(60):
        lang = rng.choice(list(LETTERS))
        named, meta = rng.choice([None, "", " ", "sv"]), rng.choice([None, "", "pt"])
        docs.append((d, named, {"lang": meta}))
        # Enough English first, and what follows it is no longer read.
        far = rng.random() < 0.3
        parts = (["x" * 300, "", "y" * 300] if far else []) + rng.choice([[], [""], ["some words"]]) + [LETTERS[lang] * 3]
        blocks += [(d, k, t) for k, t in enumerate(parts)]
        if named != "sv":
            want[d] = meta or ("en" if far else lang)
    doc = spark.createDataFrame(docs, "doc_id bigint, language string, metadata map<string,string>")
    block = spark.createDataFrame(blocks, "doc_id bigint, seq int, content string").repartition(5)
    fixed, log = fixes.fix_language(doc, block)
    assert {r.doc_id: r.after for r in log.collect()} == want
    assert {r.doc_id: r.language for r in fixed.collect()} == {d: want.get(d, "sv") for d in range(60)}


def test_limit(spark):
    doc = spark.createDataFrame([(1, None, None)], "doc_id bigint, language string, metadata map<string,string>")
    block = spark.createDataFrame([(1, 0, "z" * 30), (1, 1, LETTERS["es"])], "doc_id bigint, seq int, content string")
    assert fixes.fix_language(doc, block, limit=20)[1].first().after == "en"
    assert fixes.fix_language(doc, block, limit=100)[1].first().after == "es"


def test_documents_are_chosen_before_the_scan(spark):
    doc = spark.createDataFrame([(1, None, None)], "doc_id bigint, language string, metadata map<string,string>")
    block = spark.createDataFrame([(1, 0, "text")], "doc_id bigint, seq int, content string")
    plan = fixes.fix_language(doc, block)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Window") < plan.index("LeftSemi")
