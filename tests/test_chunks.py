"""Chunk boundaries against looking at every page."""

import random

from pagelight.operators import dedupe


def test_boundaries_shift_without_broadcast_pages(spark):
    rng = random.Random(5)
    docs = [(d, rng.choice([3, 11, 12, 40, 77, 300])) for d in range(30)]
    doc = spark.createDataFrame(docs, "doc_id bigint, page_count int")
    # Few documents explode into many pages, which the size estimate does not see.
    size = "CAST((doc_id * 31 + page_num * 17) % 7 * 100 AS INT)"
    page_bytes = doc.selectExpr("doc_id", "explode(sequence(0, page_count - 1)) AS page_num").selectExpr("*", f"{size} AS n_bytes")
    plan = dedupe.chunk_plan(doc, max_pages=10, overlap=2)
    out = dedupe.shift_boundaries(plan, page_bytes)
    want = set()
    for r in plan.collect():
        end = r.split_page
        if end < r.page_count:
            near = range(end, min(end + 2, r.page_count))
            end = next((p for p in near if (r.doc_id * 31 + p * 17) % 7 * 100 > 500), end)
        want.add((r.doc_id, r.chunk, r.start_page, min(end + r.overlap_end, r.page_count)))
    assert {tuple(r) for r in out.collect()} == want and len(want) > 100
    text = out._jdf.queryExecution().sparkPlan().toString()
    assert text.count("BroadcastHashJoin") == 1 and "LeftSemi, BuildRight" in text and text.count("SortMergeJoin") == 2
