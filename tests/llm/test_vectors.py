"""Exact top-k search against all inner products."""

import math

import numpy as np
import pytest

from pagelight.llm import vectors

SCHEMA = "vec_id bigint, vector array<double>"


def brute(rows, queries, k, scale=256.0):
    def whole(v):
        ok = v is not None and all(x is not None and math.isfinite(x) for x in v)
        return [math.floor(scale * x) for x in v] if ok else None

    given = [(i, whole(v)) for i, v in rows]
    given = [(i, v) for i, v in given if i is not None and v is not None]
    out = []
    for i, v in dict.fromkeys((i, None if v is None else tuple(v)) for i, v in queries):
        if i is not None and whole(v) is not None:
            best = sorted((-sum(a * b for a, b in zip(whole(v), w)), j) for j, w in given if j != i and len(w) == len(v))[:k]
            out += [(i, rank + 1, j, -score) for rank, (score, j) in enumerate(best)]
    return sorted(out)


def found(spark, rows, queries, parts=3, **kwargs):
    frames = [spark.createDataFrame(x, SCHEMA).repartition(parts).selectExpr("*", "1 AS block", "'x' AS size", "2 AS least", "3 AS rank") for x in (rows, queries)]
    return sorted(tuple(r) for r in vectors.top_k(*frames, **kwargs).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("size, n, k", [(64, 300, 5), (37, 150, 3), (3, 100, 7), (16, 4, 5)])
def test_random_vectors(spark, size, n, k):
    rng = np.random.default_rng(size)
    centre = rng.normal(size=(5, size))
    x = centre[rng.integers(0, 5, n)] + rng.normal(size=(n, size)) * 0.1
    rows = [(i * 7 % 1000, v.tolist()) for i, v in enumerate(x)]
    queries = [r for r in rows if r[0] % 5 == 0]
    assert found(spark, rows, queries, k=k) == brute(rows, queries, k)


def test_ties_and_one_vector_of_many(spark):
    rows = [(i, [0.5, 0.25, -1.0]) for i in range(200)] + [(500 + i, [float(i % 3), 1.0, 0.0]) for i in range(30)]
    queries = [rows[0], rows[77], rows[205]]
    assert found(spark, rows, queries, parts=8) == brute(rows, queries, 5)


def test_values_that_take_no_part(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0]), (None, [1.0, 2.0]),
            (7, []), (8, []), (9, [3.0]), (6, [1.0, 1.0]), (6, [2.0, 1.0]), (10, [-1.0, 1e-9])]
    assert found(spark, rows, rows) == brute(rows, rows, 5)
    assert found(spark, rows, [(1, None)]) == []
    assert found(spark, [], rows) == [] and found(spark, rows, []) == [] and found(spark, [], []) == []


def test_large_components_stay_exact(spark):
    rows = [(1, [3e6, 1.0, 2.0]), (2, [3e6 + 0.01, 1.0, 0.0]), (3, [3e6 - 0.01, 7.0, 0.0]), (4, [3e6, 1.0, 1.0])]
    assert found(spark, rows, rows) == brute(rows, rows, 5)
    huge = [(1, [1e200, 1.0]), (2, [1e200, 0.0]), (3, [-1e200, 0.0])]
    assert found(spark, huge, huge[:1]) == [(1, 1, 2, 2**63 - 1), (1, 2, 3, -(2**63))]


def test_statistics_bound_the_inner_product():
    rng = np.random.default_rng(1)
    for size in (1, 5, 16, 40):
        a, b = rng.normal(size=(20, size)), rng.normal(size=(30, size))
        for width in (1, 2, 4, 16):
            assert (vectors.statistics(a, width) @ vectors.statistics(b, width).T >= a @ b.T - 1e-9).all()


def test_blocks_that_cannot_matter_are_left_out():
    boxes = vectors.Boxes([(2, 0, [1.0, 0.0], [2.0, 0.5]), (2, 1, [-2.0, 0.0], [-1.0, 0.5])])
    block, bound = boxes.bounds(np.array([[1.0, 1.0]]))
    assert block.tolist() == [0, 1] and bound[0, 0] > 2 and bound[0, 1] < 0
