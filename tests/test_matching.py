"""Figures and images against looking at all pairs."""

import random

import pytest

from pagelight.operators import matching

SCHEMA = "doc_id bigint, page int, ord bigint, x0 double, y0 double, x1 double, y1 double"


def area(f, i):
    if any(v is None or abs(v) == float("inf") or v != v for v in (*f[3:], *i[3:])):
        return 0.0
    w, h = min(f[5], i[5]) - max(f[3], i[3]), min(f[6], i[6]) - max(f[4], i[4])
    return w * h if w > 0 and h > 0 else 0.0


def brute(figures, images):
    best, taken, used = set(), set(), set()
    for f in sorted(figures, key=lambda b: b[2]):
        own = sorted((i for i in images if i[:2] == f[:2]), key=lambda i: (-area(f, i), i[2]))
        if own:
            best.add((*f[:3], own[0][2], area(f, own[0])))
        for i in own:
            if i[:3] not in used:
                used.add(i[:3])
                taken.add((*f[:3], i[2], area(f, i)))
                break
    return best, taken


def some(rng, n, pages, reach):
    def box():
        if rng.random() < 0.1:
            return rng.choice([(None, 0.0, 1.0, 1.0), (5.0, 5.0, 2.0, 9.0), (float("nan"), 0.0, 9.0, 9.0), (0.0, 0.0, float("inf"), 3.0), (1.0, 1.0, 1.0, 1.0)])
        x, y, w = rng.randrange(-reach, reach), rng.randrange(-reach, reach), rng.choice([1, 3, 10, reach // 2])
        return float(x), float(y), x + w * rng.random() + 0.5, y + w * rng.random() + 0.5

    return [[(p // 2 if p else None, p % 2, k * 3, *box()) for p in range(pages) for k in rng.sample(range(100), rng.randrange(n))] for _ in range(2)]


@pytest.mark.parametrize("seed, n, pages, reach", [(0, 4, 20, 20), (1, 60, 5, 50), (2, 90, 3, 4), (3, 40, 4, 1000)])
def test_random_pages(spark, seed, n, pages, reach):
    figures, images = some(random.Random(seed), n, pages, reach)
    frames = [spark.createDataFrame(x, SCHEMA).repartition(3) for x in (figures, images)]
    best, taken = brute(figures, images)
    assert {tuple(r) for r in matching.best_overlap(*frames).collect()} == best
    assert {tuple(r) for r in matching.assign_images(*frames).collect()} == taken


def test_a_page_of_many_boxes(spark):
    n = 20_000
    grid = [(1, 0, k, float(k % 200 * 10), float(k // 200 * 10), k % 200 * 10 + 8.0, k // 200 * 10 + 8.0) for k in range(n)]
    cover = [(1, 0, n + k, -5.0, -5.0, 3000.0, 3000.0) for k in range(3)]
    shifted = [(d, p, n - 1 - o, a + 1, b + 1, c + 1, e + 1) for d, p, o, a, b, c, e in grid]
    figures, images = (spark.createDataFrame(x, SCHEMA).repartition(8) for x in (grid + cover, shifted))
    overlaps = matching._overlaps(matching._boxes(figures, images))
    assert overlaps.count() == 4 * n  # the neighbour of the same place, and the three that cover all
    got = {r.figure_ord: r.image_ord for r in matching.assign_images(figures, images).collect()}
    assert got == {k: n - 1 - k for k in range(n)}
    assert matching.best_overlap(figures, images).filter("figure_ord >= 20000 AND area = 49").count() == 0


def test_nothing(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 1.0, 1.0)], SCHEMA)
    for figures, images in ((none, none), (one, none), (none, one)):
        assert matching.best_overlap(figures, images).collect() == [] == matching.assign_images(figures, images).collect()
