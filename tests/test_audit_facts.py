"""Facts of a document from one pass against the operators that compute each on its own."""

import random

import pytest
from pyspark.sql import functions as F

from pagelight.operators import checks

SCHEMA = """doc_id bigint, seq int, page_num int, block_id string, block_type string, content string, x1 double, y1 double, x2 double, y2 double,
 level int, alt string, caption string, headers array<string>, rows array<array<string>>, items array<string>, image_id string, name string, label string, tooltip string"""


def some(rng, docs):
    rows = []
    for d in range(docs):
        page = 0
        for seq in range(rng.choice([1, 2, 3, 4, 9, 30])):
            page += rng.choice([0, 0, 0, 1, 1, -1])
            kind = rng.choice(["heading", "heading", "paragraph", "image", "odd"])
            rows.append((d, seq, page, rng.choice([None, "", "a", "b", f"b{seq}"]), kind, rng.choice(["", "text", "see https://example.org/x"]),
                         float(rng.choice([0, 60, 300, 500])), float(rng.choice([10, 20, 35, 60])), 600.0, 90.0,
                         rng.choice([None, 1, 2, 4, 6]) if kind == "heading" else None, rng.choice([None, "a chart"]), *[None] * 8))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_block_facts(spark, tiny_segments, seed):
    block = spark.createDataFrame(some(random.Random(seed), 40), SCHEMA)
    names = ["n_heading", "n_image", "n_link", "n_chart", "n_column", "bad_1_1_1", "bad_2_4_6", "bad_4_1_1", "bad_1_3_2", "bad_1_4_1"]
    base = [n for n in names if n not in ("bad_1_3_2", "bad_1_4_1", "n_column")]
    pages = checks.page_counters(block, [*base, "n_column"])
    want = pages.groupBy("doc_id").agg(*[F.sum(n).alias(n) for n in base], F.expr("count_if(n_column >= 3) AS bad_1_3_2"), F.expr("count_if(n_chart > 0) AS bad_1_4_1"))
    for part in (checks.order_breaks(block), checks.heading_skips(block).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_skip")),
                 checks.duplicate_ids(block).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_duplicate"))):
        want = want.join(part, "doc_id", "left")
    columns = ["doc_id", *base, "bad_1_3_2", "bad_1_4_1", *checks.ORDERED]
    got = checks.block_facts(block, [n for n in names if n != "n_column"])
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.fillna(0).select(columns).collect()))
    assert got.filter("n_duplicate > 0 AND n_skip > 0 AND order_breaks > 0").count() > 3
