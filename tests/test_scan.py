"""Segmented scans equal one plain pass, whatever the segment size."""

import random

from pyspark.sql import functions as F

from pagelight.functions import scan


def rows(seed, keys=3, n=40):
    r = random.Random(seed)
    return [(k, i, r.choice([None, *range(-5, 6)])) for k in range(keys) for i in sorted(r.sample(range(3 * n), n))]


def collect(df, name):
    out = {}
    for r in df.orderBy("k", "i").collect():
        out.setdefault(r["k"], []).append(r[name])
    return out


def plain(data, step):
    out = {}
    for k in sorted({d[0] for d in data}):
        out[k] = step([d[2] for d in data if d[0] == k])
    return out


def test_running_kinds(spark, tiny_segments):
    data = rows(1)
    df = spark.createDataFrame(data, "k int, i int, v int")
    v = F.col("v")
    got = scan.running(df, ["k"], ["i"], {
        "total": scan.running_sum(v), "low": scan.running_min(v), "high": scan.running_max(v, True),
        "last": scan.last_value(v), "prev": scan.previous(v), "next": scan.following(v), "pos": scan.row_position(),
        "later": scan.next_value(v),
    }).cache()

    def total(vs):
        s, out = 0, []
        for x in vs:
            s += x or 0
            out.append(s)
        return out

    def low(vs):
        return [min([x for x in vs[: j + 1] if x is not None], default=None) for j in range(len(vs))]

    def high(vs):
        return [max([x for x in vs[:j] if x is not None], default=None) for j in range(len(vs))]

    def last(vs):
        return [next((x for x in reversed(vs[: j + 1]) if x is not None), None) for j in range(len(vs))]

    def later(vs):
        return [next((x for x in vs[j + 1:] if x is not None), None) for j in range(len(vs))]

    assert collect(got, "total") == plain(data, total)
    assert collect(got, "low") == plain(data, low)
    assert collect(got, "high") == plain(data, high)
    assert collect(got, "last") == plain(data, last)
    assert collect(got, "later") == plain(data, later)
    assert collect(got, "prev") == plain(data, lambda vs: [None, *vs[:-1]])
    assert collect(got, "next") == plain(data, lambda vs: [*vs[1:], None])
    assert collect(got, "pos") == plain(data, lambda vs: list(range(1, len(vs) + 1)))


def test_neighbours_cross_segments(spark, tiny_segments):
    data = [(k, i, i * 10 + k) for k in range(2) for i in range(11)]
    df = spark.createDataFrame(data, "k int, i int, v int")
    got = scan.neighbours(df, ["k"], "i", {"a": (-2, F.col("v")), "b": (3, F.col("v"))})
    assert got.count() == len(data)
    assert collect(got, "a") == plain(data, lambda vs: [None, None, *vs[:-2]])
    assert collect(got, "b") == plain(data, lambda vs: [*vs[3:], None, None, None])


def test_one_exchange_serves_both_branches(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS i", "id AS v")
    out = scan.running(df, ["k"], ["i"], {"s": scan.running_sum(F.col("v"))}, segment=[F.floor(F.col("i") / 50)])
    assert out.count() == 1000
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("== Initial Plan ==")[0]
