"""Periodic runs against comparison of every pair of places."""

import random

import pyarrow as pa
import pytest

from pagelight.llm import periodic

from .test_dedup import key, split

SCHEMA = "doc_id bigint, content string"


def brute(words, min_length=12):
    """(start, length, period): for every distance the maximal stretches that agree, the smallest distance of each."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(2 * p, min_length):
                best.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((start, length, p) for (start, length), p in best.items())


def collapsed(words, runs):
    gone = {i for start, length, p in runs for i in range(start + p, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found(texts, min_length=12):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "content"])
    out = [row for part in periodic._finder(min_length)([batch]) for row in part.to_pylist()]
    return [([tuple(r.values()) for r in row["runs"]], row["content"]) for row in out]


def some_words(rng):
    letters, n = rng.choice([1, 2, 2, 3, 5, 50, 5000]), rng.choice([0, 1, 5, 13, 40, 100, 300, 500])
    if rng.random() < 0.3:
        return [f"w{rng.randrange(letters)}" for _ in range(n)]
    out = []
    while len(out) < n:
        root = [f"w{rng.randrange(letters)}" for _ in range(rng.choice([1, 2, 3, 7, 10, 30, 90]))]
        for times in (rng.choice([1, 2, 2.3, 3, 5, 11]), rng.choice([1, 1, 2, 2.2, 3])):
            root = [root[i % len(root)] for i in range(int(len(root) * times))]
        out += root
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(seed):
    rng = random.Random(seed)
    texts = [some_words(rng) for _ in range(60)]
    for words, (runs, content) in zip(texts, found([" ".join(w) for w in texts])):
        assert runs == brute(words)
        assert content == collapsed(words, runs)


@pytest.mark.parametrize("q, k, tail, turn, more", [(3, 40, 1, 0, 40), (2, 50, 1, 0, 50), (5, 40, 3, 2, 44), (1, 60, 0, 0, 60), (7, 30, 3, 0, 30)])
def test_a_period_that_is_itself_highly_periodic(q, k, tail, turn, more):
    root = [f"r{i}" for i in range(q)]
    words = ["x"] + root * k + root[:tail] + (root[turn:] + root[:turn]) * more + ["y"] + root * 3
    (runs, _), = found([" ".join(words)])
    assert runs == brute(words)


def test_hashes_that_agree_by_chance(monkeypatch):
    monkeypatch.setattr(periodic._Extender, "_same", lambda self, a, b, size: a == a)
    words = "a b c d e f g h i j k l m n o p a b c d e f g h i j k l m n o p q".split()
    (runs, _), = found([" ".join(words)])
    assert runs == brute(words)


def test_minimum_length():
    (runs, content), = found(["a b a b c c c"], 3)
    assert runs == [(0, 4, 2), (4, 3, 1)] and content == "a b c"
    assert found(["a b a b c c c"])[0] == ([], "a b a b c c c")


def test_rows(spark, block, rows):
    got = periodic.periodic_runs(block).collect()
    want = [(i, len(split(t)), str(brute(split(t)) if len(split(t)) < 1000 else []), " ".join(split(t))) for i, t, *_ in rows]
    assert sorted(((r.doc_id, r.n_words, str([tuple(x) for x in r.runs]), r.content) for r in got), key=key) == sorted(want, key=key)


def test_a_very_long_text_and_white_space(spark):
    unit = [f"u{i}" for i in range(50_000)]
    text = "\t\n ".join(unit * 3) + " \x0b end"
    row, = periodic.periodic_runs(spark.createDataFrame([(1, text)], SCHEMA)).withColumn("best", periodic.longest_run("runs")).collect()
    assert tuple(row.best) == (0, 150_000, 50_000) and row.content == " ".join(unit + ["end"])


def test_longest_run_and_nothing(spark, nothing):
    two = "a b c d e f a b c d e f x " + "g h i j k l g h i j k l y"
    row, = periodic.periodic_runs(spark.createDataFrame([(1, two)], SCHEMA)).withColumn("best", periodic.longest_run("runs")).collect()
    assert [tuple(r) for r in row.runs] == [(0, 12, 6), (13, 12, 6)] and tuple(row.best) == (0, 12, 6)
    assert periodic.periodic_runs(nothing).collect() == []
