"""The ledger record against its literal, and how often it reads the checks."""

from pagelight.operators import gates

CHECK = "doc_id bigint, gate_id string, check_name string, status string, severity string, priority string, next_action string, n bigint"


def test_ledger_reads_the_checks_once(spark):
    rows = [(1, "G2", "b", *gates.SOFT, 2), (1, "G1", "z", *gates.PASS, 0), (1, "G1", "a", *gates.HARD, 1), (2, "G1", "a", *gates.PASS, 0),
            (2, gates.PDFUA, "c", *gates.SOFT_MODERATE, 1), (4, "G1", "a", *gates.PASS, 0)]
    check = spark.createDataFrame(rows, CHECK)
    out = gates.ledger(check, spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "doc_id bigint, filename string"))
    got = {r.doc_id: r for r in out.collect()}
    assert {d: (r.filename, [(g.gate_id, g.passed, [(c.check_name, c.n) for c in g.checks]) for g in r.gates]) for d, r in got.items()} == {
        1: ("x", [("G1", False, [("a", 1), ("z", 0)]), ("G2", True, [("b", 2)])]),
        2: ("y", [("G1", True, [("a", 0)]), (gates.PDFUA, True, [("c", 1)])])}
    want = {r.doc_id: r.asDict() for r in gates.ledger_summary(check).collect()}
    assert {d: {"doc_id": d, **r.summary.asDict()} for d, r in got.items()} == {d: want[d] for d in (1, 2)}
    # One leaf for the checks and one for the documents.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
