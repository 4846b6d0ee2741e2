"""The prefix trie against grouping by every prefix."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from pagelight.llm import trie

SCHEMA = "entity_id bigint, id bigint, action string, new_value string"
COLUMNS = ("entity_id", "depth", "parent_entity_id", "n_entities", "n_children", "n_leaves", "saved_chars", "ends_sha256")


def brute(trails):
    """From {entity: [(action, value)]}."""
    members = defaultdict(list)
    for i in sorted(trails):
        for d in range(len(trails[i]) + 1):
            members[tuple(trails[i][:d])].append(i)
    children = defaultdict(set)
    for k in members:
        if k:
            children[k[:-1]].add(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, ids in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(ids) - 1) * len(k[-1][1]) if k else 0
    ends = {k: ",".join(str(i) for i in ids if len(trails[i]) == len(k)) for k, ids in members.items()}
    return sorted((ids[0], len(k), members[k[:-1]][0] if k else None, len(ids), len(children[k]), leaves[k], saved[k],
                   hashlib.sha256(ends[k].encode()).hexdigest()) for k, ids in members.items())


def found(audit, *more, **kwargs):
    return sorted(tuple(r) for r in trie.prefix_trie(audit, *more, **kwargs).select(*COLUMNS).collect())


def some_trails(rng, n):
    trails = {}
    for i in rng.sample(range(-50, 5 * n), n):
        start = rng.choice(list(trails.values()))[: rng.randrange(6)] if trails and rng.random() < 0.8 else []
        trails[i] = start + [(rng.choice("uva"), rng.choice(["", "é", "yes", "no 🙂"])) for _ in range(rng.choice([0, 0, 1, 1, 2, 5]))]
    return trails


def rows_of(trails, rng):
    rows = [(i, d * 3 - 7, a, v) for i, t in trails.items() for d, (a, v) in enumerate(t)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, block, parts", [(0, 5, 3), (1, 1, 2), (2, 40, 4), (3, 1 << 16, 4), (4, 9, 1)])
def test_random_trails(spark, seed, block, parts):
    rng = random.Random(seed)
    trails = some_trails(rng, 150)
    audit = spark.createDataFrame(rows_of(trails, rng), SCHEMA).repartition(parts)
    entity = spark.createDataFrame([(i,) for i in trails], "entity_id bigint")
    assert found(audit, entity, block=block) == brute(trails)


def test_one_trail_of_all_and_a_long_one(spark):
    same = [("create", "x" * 10), ("approve", "y")]
    trails = {i: list(same) for i in range(300)} | {1000: [("create", "x" * 10)] + [("edit", str(k)) for k in range(250)], 1001: same[:1]}
    audit = spark.createDataFrame(rows_of(trails, random.Random(0)), SCHEMA)
    assert found(audit, block=50) == brute(trails)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(1, None, None, None), (1, 1, "a", "x"), (2, None, "", ""), (2, 2, "a", "x"), (None, 1, "a", "x"), (3, 1, "a", "x"), (3, 1, "a", "x")]
    audit = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "sizes", "block", "home", "depth", "lcp"):
        audit = audit.selectExpr("*", f"7 AS {name}")
    assert found(audit) == brute({1: [("", ""), ("a", "x")], 2: [("", ""), ("a", "x")], 3: [("a", "x"), ("a", "x")]})
    tied = spark.createDataFrame([(1, 1, "b", "x"), (1, 1, "a", "y"), (2, 1, "a", "y"), (2, 1, "b", "x")], SCHEMA)
    assert [r[3] for r in found(tied)] == [2, 2, 2]  # entries of one id go by digest, whatever their row order


def test_nothing_and_text_ids(spark):
    audit = spark.createDataFrame([], SCHEMA)
    assert found(audit) == []
    entity = spark.createDataFrame([(4,), (9,), (None,)], "entity_id bigint")
    assert found(audit, entity) == brute({4: [], 9: []})
    named = spark.createDataFrame([("b", 1, "a", "x"), ("a", 1, "a", "x")], "entity_id string, id bigint, action string, new_value string")
    assert found(named) == brute({"a": [("a", "x")], "b": [("a", "x")]})


def test_range_minimum():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 9, 200)
    table = trie.RangeMinimum(values)
    for at in range(200):
        for least in range(10):
            right = left = at
            while right + 1 < 200 and values[right + 1] >= least:
                right += 1
            while left > 0 and values[left] >= least:
                left -= 1
            assert table.right(np.array([at]), np.array([least]))[0] == right
            assert table.left(np.array([at]), np.array([least]))[0] == left
        assert table.least(np.array([at // 2]), np.array([at]))[0] == values[at // 2 : at + 1].min()
