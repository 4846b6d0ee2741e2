"""Gate facts of a document from one pass against the gates that compute each on its own."""

import random

import pytest
from pyspark.sql import functions as F

from pagelight.operators import gates
from pagelight.sources.schemas import BLOCK, DOC, PAGE, Corpus

NULLS = dict.fromkeys((f.split()[0] for f in BLOCK.split(", ")))


def corpus(spark, rng, docs):
    block, page = [], []
    for d in range(docs):
        page += [(d, p, None, None, None, None) for p in range(rng.choice([0, 1, 3, 5])) for _ in range(rng.choice([1, 1, 1, 2]))]
        if rng.random() < 0.2:
            page.append((d, None, None, None, None, None))
        for seq in range(rng.choice([0, 1, 2, 4, 9, 30])):
            left = float(rng.choice([0, 10, 40, 60, 90, 300]))
            block.append({**NULLS, "doc_id": d, "seq": seq, "page_num": rng.choice([None, 0, 0, 1, 2, 3, 9]),
                          "block_id": rng.choice([None, "", "a", "b", *[f"b{seq}"] * 6]), "block_type": rng.choice(["heading", "paragraph", "odd", None]),
                          "content": rng.choice([None, "", "  ", "text"]), "x1": left, "x2": left + rng.choice([-left, 0.0, 40.0, 100.0, 100.0, 350.0])})
    names = list(NULLS)
    return Corpus(spark.createDataFrame([(d, f"f{d}", None, None, None) for d in range(docs + 2)], DOC),
                  spark.createDataFrame(page, PAGE), spark.createDataFrame([tuple(b[n] for n in names) for b in block], BLOCK))


@pytest.mark.parametrize("seed", range(3))
def test_structure_checks(spark, tiny_segments, seed):
    given = corpus(spark, random.Random(seed), 40)
    want = gates.g1(given).unionByName(gates.g2(given).filter("check_name <> 'page_order'"))
    got = gates.structure_checks(given)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.filter("status <> 'pass'").select("check_name").distinct().count() > 5


def columns_by_pairs(rows):
    found = set()
    for d, p, a1, a2 in rows:
        for e, o, b1, b2 in rows:
            if (d, p) == (e, o) and (a1, a2) != (b1, b2) and a2 > a1 and b2 > b1 and (a1 or a2) and (b1 or b2):
                if (a1 + a2) / 2 <= b1 and a2 <= (b1 + b2) / 2:
                    found.add((d, p))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_multi_column_pages(spark, seed):
    """Pages that lie apart, that allow no pair, and pages that only the scan can tell."""
    rng = random.Random(seed)
    rows = []
    for d in range(60):
        spread = rng.choice([20, 60, 200])
        for _ in range(rng.randrange(1, 7)):
            left = float(rng.randrange(spread))
            rows.append((d, rng.choice([None, 1]), left, left + rng.choice([0, 40, 90, 110])))
    block = spark.createDataFrame(rows, "doc_id bigint, page_num int, x1 double, x2 double")
    got = [tuple(r) for r in gates.multi_column_pages(block).collect()]
    assert len(got) == len(set(got)) and set(got) == columns_by_pairs(rows)
    undecided = block.filter(gates.BOX).groupBy("doc_id", "page_num").agg(
        *[F.expr(f"{e.format(box='true')} AS {n}") for n, e in gates.EXTREMES.items()]).filter(gates.UNDECIDED)
    assert 0 < undecided.count() < len({r[:2] for r in rows})


def test_publishable_names(spark):
    rows = [(1, "G1", "b", "hard_fail", "P0"), (1, "G1", "a", "hard_fail", "P0"), (1, "G2", "a", "hard_fail", "P0"), (1, "G2", "c", "soft_fail", "P1"),
            (2, "G4", "adobe_checker_pass", "pass", "P2"), (2, gates.PDFUA, "verapdf_available", "soft_fail", "P1"), (2, "G2", "c", "soft_fail", "P1"),
            (3, gates.PDFUA, "verapdf_available", "soft_fail", "P1"), (4, "G1", "a", "pass", "P0"), (5, "G4", "adobe_checker_pass", "pass", "P2"),
            (5, gates.PDFUA, "verapdf_available", "soft_fail", "P1")]
    check = spark.createDataFrame(rows, "doc_id bigint, gate_id string, check_name string, status string, priority string")
    got = {r.doc_id: (r.publishable, r.reason) for r in gates.publishable(check).collect()}
    clear = (True, "No P0 or P1 issues — document is publishable")
    assert got == {
        1: (False, "Document blocked by 3 P0 issue(s): a, b"), 2: (False, "Document has 1 P1 issue(s) requiring HITL sign-off: c"),
        3: (False, "Document has 1 P1 issue(s) requiring HITL sign-off: verapdf_available"), 4: clear, 5: clear}
