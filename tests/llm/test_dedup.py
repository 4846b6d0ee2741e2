"""Exact duplicates, the Jaccard join, repeated passages, test passages and components against brute force."""

import hashlib
import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelight.llm import components, decontaminate, exact, near, substrings

from .conftest import text

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def split(t):
    return [w for w in SPACES.split(t or "") if w]


def key(r):
    return tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("historical", ["doc_id < 20", "true", "false", "null"])
def test_exact_duplicates(block, rows, historical):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[SPACES.sub(" ", t or "")].append(i)
    want = []
    for i, t, *_ in rows:
        t = SPACES.sub(" ", t or "")
        keep = min((x for x in groups[t] if x is not None), default=None)
        want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = exact.exact_duplicates(block, F.expr(historical)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3000):
        keys = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
        table = exact.MinimalPerfectHash(keys)
        assert sorted(table.slots(keys)) == list(range(n))


def brute_jaccard(rows, size=5, similarity=0.8):
    sets = []
    for _, t, *_ in rows:
        w = split(t)
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    rep = {}
    for (i, *_), s in zip(rows, sets):
        if s and i is not None:
            rep[s] = min(i, rep.get(s, i))
    links = {s: {o for o in rep if o != s and len(s & o) >= similarity * len(s | o)} for s in rep}
    group = {}
    for s in rep:
        seen, todo = {s}, [s]
        while todo:
            for o in links[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        group[s] = min(rep[o] for o in seen)
    return [(i, rep.get(s, i), len(links.get(s, ())), group.get(s, i), len(s)) for (i, *_), s in zip(rows, sets)]


def test_near_duplicates(block, rows):
    got = near.near_duplicates(block).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_jaccard(rows), key=key)


def test_near_duplicates_of_repeated_rows_and_shared_ids(spark):
    rng = random.Random(9)
    a = text(rng, 100)
    b = " ".join([*split(a)[:-1], "changed"])
    rows = [(1, a), (1, a), (2, b), (2, b), (1, text(rng, 50)), (2, a), (3, a.replace(" ", "  ")), (None, b), (3, None), (3, b)]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, content string")).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_jaccard(rows), key=key)
    assert {r.n_links for r in got} == {0, 1}


def test_near_duplicates_of_a_chain_of_templates(spark):
    """Texts that share a template link into long chains without being copies."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 120])) for i in range(60)] + [(100 + i, " ".join([*words[:60], *split(text(rng, 60))])) for i in range(40)]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, content string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_jaccard(rows))


def test_near_duplicates_in_tiles(spark, monkeypatch):
    """A group that is cut in many tiles, with every member's links and one group id."""
    monkeypatch.setattr(near, "TILE_SHINGLES", 1500)
    rng = random.Random(3)
    base = split(text(rng, 150))
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, text(rng, 40)) for i in range(40)]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, content string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_jaccard(rows))


def test_prefix_length():
    length = near.prefix_length(0.8, 0.999)
    assert 1 - (1 - 0.8**length) ** near.TREES >= 0.999 > 1 - (1 - 0.8 ** (length + 1)) ** near.TREES


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["id"]: r["root"] for r in got} | {x: x for x in want if want[x] == x} == {x: find(x) for x in want}
    assert len(got) == len({r["id"] for r in got})


def brute_passages(rows, window):
    first = defaultdict(set)
    for i, t in rows:
        w = split(t)
        if i is not None:
            for k in range(len(w) - window + 1):
                first[tuple(w[k : k + window])].add(i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and min(first[tuple(w[k : k + window])]) < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("window,vocabulary", [(8, 2), (7, 3), (2, 40), (50, 2)])
def test_repeated_passages(spark, window, vocabulary):
    """Few different words: windows overlap, tie and repeat within a document."""
    rng = random.Random(window)
    texts = [" ".join(rng.choice("abé…"[:vocabulary] if vocabulary < 5 else [f"w{k}" for k in range(vocabulary)])
                      for _ in range(rng.choice([0, 5, 30, 90]))) for _ in range(40)]
    for k in range(20):  # passages of other texts, at a changed place
        a, b = rng.choice(texts).split(), rng.choice(texts).split()
        cut = rng.randrange(len(a) + 1)
        texts.append("\n ".join(a[:cut] + b + a[cut:]))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = substrings.remove_repeated_passages(spark.createDataFrame(rows, "doc_id bigint, content string"), window).collect()
    assert sorted(map(tuple, got)) == sorted(brute_passages(rows, window))


def test_repeated_passages_of_given_rows(block, rows):
    alone = [r for r in rows if r[0] != 41]
    got = substrings.remove_repeated_passages(block.filter("doc_id IS NULL OR doc_id <> 41")).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_passages([r[:2] for r in alone], 50), key=key)
    # A repeated id only may not break anything.
    assert substrings.remove_repeated_passages(block).count() == len(rows)


def test_repeated_passages_of_a_repeated_id(spark, block, rows):
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(60))
    more = [(60, passage), (61, text(rng, 20) + " " + passage), (61, text(rng, 100)), (61, passage + " " + text(rng, 9)), (61, passage),
            (62, text(rng, 70)), (62, passage[:200] + text(rng, 80) + " " + passage)]
    given = [r[:2] for r in rows] + more
    frame = block.select("doc_id", "content").union(spark.createDataFrame(more, "doc_id bigint, content string"))
    got = substrings.remove_repeated_passages(frame).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_passages(given, 50), key=key)


@pytest.mark.parametrize("form", ["\u201c{}\u201d", "{}\u2014end", "{}", "\u00ab{}\u00bb"])
def test_passages_between_signs_that_are_no_words(spark, form):
    passage = text(random.Random(2), 40)
    given = form.format(passage.replace(" ", "\u00a0" if form == "{}" else " "))
    block = spark.createDataFrame([(1, "before " + given + " after"), (2, "none of it")], "doc_id bigint, content string")
    golden = spark.createDataFrame([(5, passage.replace("the", "th\u00e9"))], "item_id bigint, content string")
    assert decontaminate.contained_passages(block, golden.limit(0)).count() == 0
    golden = spark.createDataFrame([(5, "\u2018" + passage + "\u2019")], "item_id bigint, content string")
    assert [(r.doc_id, r.item_id, r.containment) for r in decontaminate.contained_passages(block, golden).collect()] == [(1, 5, 1.0)]


def brute_contained(rows, golden):
    def parts(t):
        return "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in (t or "").lower()).split(" ")

    def parts_of(t):
        return [w for w in parts(t) if w]

    want = set()
    for item, passage in golden:
        w = parts_of(passage)
        n = min(5, len(w))
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for i, t, *_ in rows:
            d = parts_of(t)
            held = {tuple(d[k : k + n]) for k in range(len(d) - n + 1)} & s
            if s and len(held) >= 0.8 * len(s):
                want.add((i, item, len(s), len(held)))
    return want


def test_contained_passages(spark, block, rows):
    long = dict((r[0], r[1]) for r in rows if r[1])[40].split()
    partly = long[100:140]
    partly[3] = "altered"
    mostly_not = long[300:310] + ["x1", "x2", "x3", "x4", "x5", "x6"]
    golden = [(1, " ".join(long[5000:5020])), (2, " ".join(partly).upper()), (3, " ".join(mostly_not)), (4, "one"), (5, None), (6, " "),
              (7, "short, text."), (8, "absent words only here now"), (9, " ".join(long[9000:9300])), (None, "null item text here now")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in golden], "item_id bigint, content string, hash int, width int")
    got = decontaminate.contained_passages(block, frame).collect()
    usual = {r[:4] for r in map(tuple, got)}
    assert usual == brute_contained(rows, golden)
    assert len(got) == len(usual)


def test_full_filter_changes_nothing(spark, block, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 64)
    golden = [(1, rows[0][1][:200]), (2, rows[3][1])]
    got = decontaminate.contained_passages(block, spark.createDataFrame(golden, "item_id bigint, content string")).collect()
    assert {tuple(r)[:4] for r in got} == brute_contained(rows, golden)


def test_empty_tables(spark, block, nothing):
    assert exact.exact_duplicates(nothing, F.lit(True)).count() == 0
    assert near.near_duplicates(nothing).count() == 0
    assert substrings.remove_repeated_passages(nothing).count() == 0
    golden = spark.createDataFrame([], "item_id bigint, content string")
    assert decontaminate.contained_passages(block, golden).count() == 0
