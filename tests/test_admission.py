"""Admission against walking over all requests, and of one client that never stops."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelight.operators import events

SCHEMA = "client string, bucket string, id long, t double"


def walk(rows, limits, window):
    memory, out = {}, {}
    for client, bucket, i, t in sorted(rows, key=lambda r: (r[3], r[2])):
        held = memory.setdefault((client, bucket), deque())
        while held and t - held[0] >= window:
            held.popleft()
        if len(held) < limits[bucket]:
            held.append(t)
            out[i] = (True, 0)
        else:
            out[i] = (False, int(window - (t - held[0])) + 1)
    return out


@pytest.mark.parametrize("seed, window, limits, spread", [
    (0, 60.0, {"a": 3, "b": 1}, 4000), (1, 0.1, {"a": 2, "b": 7}, 30), (2, 10.0, {"a": 5, "b": 60}, 900), (3, 1.0, {"a": 1, "b": 2}, 40)])
def test_random_requests(spark, seed, window, limits, spread):
    rng = random.Random(seed)
    rows, i = [], 0
    for client in "xyz":
        t = rng.uniform(-100, 100)
        while i < 700 * ("xyz".index(client) + 1):
            burst = rng.random() < 0.3
            t += rng.choice([0.0, window, window / limits["a"], rng.expovariate(spread / window), 5 * window * (rng.random() < 0.05)]) * (0.1 if burst else 1)
            rows.append((client, rng.choice("ab"), i, round(t, 3)))
            i += 1
    got = events.admission(spark.createDataFrame(rows, SCHEMA).repartition(3), limits, window).collect()
    assert {r.id: (r.admitted, r.retry_after) for r in got} == walk(rows, limits, window) and len(got) == len(rows)


def test_a_million_requests_of_one_client(spark):
    n = 1_000_000
    request = spark.range(n, numPartitions=8).select(
        F.lit("c").alias("client"), F.lit("a").alias("bucket"), "id", (F.col("id") * 0.011 + F.pmod(F.xxhash64("id"), F.lit(7)) * 0.001).alias("t"))
    t = np.arange(n) * 0.011 + np.array([r.m for r in request.selectExpr("CAST(pmod(xxhash64(id), 7) AS INT) AS m", "id").orderBy("id").collect()]) * 0.001
    want = walk([("c", "a", i, x) for i, x in enumerate(t.tolist())], {"a": 60}, 60.0)
    found = events.admission(request, {"a": 60}).filter("admitted").select("id").collect()
    assert sorted(r.id for r in found) == [i for i, (ok, _) in sorted(want.items()) if ok]


def test_no_walk_where_the_limit_cannot_bind(spark):
    request = spark.range(1000).select(F.lit("c").alias("client"), F.lit("a").alias("bucket"), "id", (F.col("id") * 30.0).alias("t"))
    flagged = events._pressure(request, {"a": 3}, 60.0)
    assert flagged.count() == 1000 and flagged.filter("busy OR unsure").count() == 0


def test_null_and_unknown_buckets_and_nothing(spark):
    rows = [(None, "a", 1, 0.0), (None, "a", 2, 1.0), ("c", None, 3, 0.0), ("c", None, 4, 0.5), ("c", "other", 5, 0.0)]
    got = events.admission(spark.createDataFrame(rows, SCHEMA), {"a": 1}).collect()
    assert {r.id: r.admitted for r in got} == {1: True, 2: False, 3: True, 4: True, 5: True}
    assert events.admission(spark.createDataFrame([], SCHEMA), {"a": 1}).collect() == []
