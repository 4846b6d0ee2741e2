"""The compiled rules against walking over them one by one."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelight.operators import rules

ELEMENT = ("doc_id int, seq int, type string, content string, alt string, headers array<string>, level int, prev_level int, "
           "scope string, removed boolean")
RULE = "id string, trigger_pattern string, action struct<type:string,value:string>, confidence double, version int"


def blank(x):
    return not (x or "").strip()


def walk(el, chain):
    _, _, kind, content, alt, headers, level, above, scope, removed = el
    hits = []
    for _, pattern, (act, value), _, _ in chain:
        want, condition = pattern.split(":")
        hit = want == kind and {
            "missing_headers": kind == "table" and not headers, "no_alt": blank(alt), "empty": blank(content),
            "skip_level": level is not None and above is not None and level - above > 1}[condition]
        hits.append(hit)
        if hit and act == "set_alt":
            alt = value or ""
        elif hit and act == "set_heading" and (value or "").strip().lstrip("+").isdigit() and 1 <= int(value) <= 6:
            level = int(value)
        elif hit and act == "add_scope":
            scope = value or ""
        elif hit and act == "remove_element":
            removed = True
    return (alt, level, scope, removed), hits


def some(rng, n_elements, n_rules):
    kinds = [*rules.ELEMENT_TYPES, "list", None]
    elements = [(i % 5, i, rng.choice(kinds), rng.choice([None, "", " ", "x"]), rng.choice([None, " ", "a"]), rng.choice([None, [], ["h"]]),
                 rng.choice([None, -3, 1, 2, 4, 6, 9]), rng.choice([None, -5, -1, 0, 1, 3, 4, 5, 7]), rng.choice([None, "old"]), rng.random() < 0.1)
                for i in range(n_elements)]
    chain = [(f"r{i:05}", f"{rng.choice(rules.ELEMENT_TYPES)}:{rng.choice(rules.CONDITIONS)}",
              (rng.choice(["set_alt", "set_heading", "add_scope", "remove_element", "other"]), rng.choice([None, "", " ", "text", "0", "1", " 2", "+3", "6", "7"])),
              0.9, rng.randrange(50)) for i in range(n_rules)]
    return elements, chain


@pytest.mark.parametrize("seed, n_rules", [(0, 1), (1, 40), (2, 10_000)])
def test_rules_in_version_order(spark, seed, n_rules):
    rng = random.Random(seed)
    elements, chain = some(rng, 120, n_rules)
    element, rule = spark.createDataFrame(elements, ELEMENT), rules.valid_rules(spark.createDataFrame(chain, RULE))
    chain.sort(key=lambda r: (r[4], r[0]))
    want = {e[1]: walk(e, chain) for e in elements}
    out, log = rules.apply_rules(element, rule)
    assert {r.seq: (r.alt, r.level, r.scope, r.removed) for r in out.collect()} == {seq: state for seq, (state, _) in want.items()}
    counts, totals = Counter(), Counter(e[0] for e in elements)
    for e in elements:
        for r, hit in zip(chain, want[e[1]][1]):
            counts[e[0], r[0]] += hit
    got = rules.execution_counts(element, rule).collect()
    assert {(r.doc_id, r.rule_id): (r.n, r.matched) for r in got} == {k: (totals[k[0]], n) for k, n in counts.items()}
    if n_rules < 100:
        assert sorted((r.seq, r.rule_id, r.matched) for r in log.collect()) == sorted(
            (seq, r[0], hit) for seq, (_, hits) in want.items() for r, hit in zip(chain, hits))
    else:
        assert log.count() == 120 * n_rules and log.filter("matched").count() == sum(counts.values())


def test_no_rules(spark):
    elements, _ = some(random.Random(3), 20, 0)
    out, log = rules.apply_rules(spark.createDataFrame(elements, ELEMENT), rules.valid_rules(spark.createDataFrame([], RULE)))
    assert sorted((r.seq, r.alt, r.level) for r in out.collect()) == sorted((e[1], e[4], e[6]) for e in elements)
    assert log.count() == 0


def test_rules_of_a_kind_are_one_entry_of_an_outcome(spark):
    chain = [(f"r{i:05}", f"{kind}:{condition}", ("set_alt", "x"), 0.9, i) for i, (kind, condition) in enumerate(
        [(k, c) for k in ("image", "table") for c in ("no_alt", "empty", "empty", "missing_headers")] * 50)]
    outcome, ids = rules.compile_rules(rules.valid_rules(spark.createDataFrame(chain, RULE)))
    # 400 rules, of at most four kinds a type: no alt and the rest of them, empty content, empty headers of a table.
    assert max(len(r.matched) for r in outcome.collect()) <= 4
    rows = ids.collect()
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in chain) and len({r[1] for r in rows}) <= 8


def test_matches_are_dealt_out(spark):
    """Elements that one task read meet their rules in several, and the pairs are those of testing each rule."""
    elements, chain = some(random.Random(4), 150, 60)
    rule = rules.valid_rules(spark.createDataFrame(chain, RULE))
    out = rules.match_rules(spark.createDataFrame(elements, ELEMENT).coalesce(1), rule)
    assert out.columns == [*(c.split()[0] for c in ELEMENT.split(", ")), *rule.columns]
    got = out.select("seq", "id", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.seq, r.id) for r in got) == sorted((e[1], r[0]) for e in elements for r in chain if walk(e, [r])[1][0])
    assert len({r.task for r in got}) > 1


def test_counts_of_many_rules_are_stored_in_little(spark, tmp_path):
    """Rules repeat in neighbouring rows, so a written row takes a fraction of a byte and not its rule's whole id."""
    elements, chain = some(random.Random(5), 400, 20_000)
    elements = [(i % 200, *e[1:]) for i, e in enumerate(elements)]
    counts = rules.execution_counts(spark.createDataFrame(elements, ELEMENT), rules.valid_rules(spark.createDataFrame(chain, RULE)))
    counts.write.parquet(str(tmp_path / "counts"))
    written = spark.read.parquet(str(tmp_path / "counts"))
    assert written.groupBy("doc_id").agg(F.countDistinct("rule_id").alias("rules"), F.count("*").alias("rows")).filter(
        "rules = 20000 AND rows = 20000").count() == 200
    assert sum(p.stat().st_size for p in (tmp_path / "counts").glob("*.parquet")) < 0.5 * 200 * 20_000


def test_no_rules_no_counts(spark):
    elements, _ = some(random.Random(6), 20, 0)
    counts = rules.execution_counts(spark.createDataFrame(elements, ELEMENT), rules.valid_rules(spark.createDataFrame([], RULE)))
    assert counts.columns == ["doc_id", "rule_id", "n", "matched"] and counts.collect() == []
