"""Small literal tables with known answers."""

import pytest
from pyspark.sql import functions as F

from pagelight.operators import checks, dedupe, elements, events, gates, html_checks, ordered, reports, rules, workflow
from pagelight.sources import dimensions, reports as scans, schemas, sinks

ELEMENT = "doc_id int, seq int, Path string, Text string, Page int, attributes map<string,string>"


def test_element_findings(spark):
    rows = [
        (1, 0, "//Document/Figure", "", 1, {}), (1, 1, "//Document/Figure", "", 1, {"Alt": "A map"}),
        (1, 2, "//Document/Table", "Department Budget Table", 2, {}),
        (1, 3, "//Document/Table/TR/TD/Table/TR/TD/Table", "", 2, {}), (1, 4, "//Document/H2", "Executive Summary", 1, {}),
        (1, 5, "//Document/Link", "Here", 1, {}), (1, 6, "//Document/P", "Text", 1, {}),
        (1, 7, "//Document/Figure", "", 1, {"role": "Artifact"}), (1, 8, "//Document", "", 0, {}), (1, 9, "//Document/P", " ", 0, {}),
    ]
    df = spark.createDataFrame(rows, ELEMENT)
    got = {r["seq"]: (r["element_type"], r["complexity"], r["severity"], r["criterion"])
           for r in elements.element_findings(df, elements.criterion_dimension(spark)).collect()}
    assert got == {
        0: ("image", "review", "critical", "1.1.1"), 1: ("image", "simple", "critical", "1.1.1"),
        2: ("table", "review", "serious", "1.3.1"), 3: ("table", "manual", "critical", "1.3.1"),
        4: ("heading", "simple", "moderate", "2.4.6"), 5: ("link", "simple", "serious", "2.4.4"),
        9: ("paragraph", "simple", "minor", "1.3.2"),
    }


def test_extraction_scan_skips_bad_entries(spark):
    raw = spark.createDataFrame(
        [("a", '{"elements":[{"Path":"//P","Text":"x"},null,{"Path":"//Q"}]}'), ("b", "{}"), ("", "{}"), ("c", "nope")],
        "doc_id string, json string")
    assert [(r["doc_id"], r["seq"]) for r in elements.scan_extraction(raw).orderBy("doc_id", "seq").collect()] == [("a", 0), ("a", 2)]
    assert {(r["doc_id"], r["reason"]) for r in elements.rejected_extractions(raw).collect()} == {
        ("", "blank_document_id"), ("c", "not_json")}


def corpus(spark, pages, blocks, meta=None, language="en"):
    full = [{"doc_id": 1, "headers": None, "rows": None, "items": None, "content": "", "x1": 0.0, "y1": 0.0, "x2": 0.0, "y2": 0.0,
             "confidence": 1.0, "source": "adobe", "status": "raw", "level": None, "alt": None, "src": None, "image_id": None,
             "caption": None, "ordered": None, "name": None, "label": None, "tooltip": None, "page_num": 0,
             "seq": i, "block_id": f"b{i}", **b} for i, b in enumerate(blocks)]
    names = [c.split()[0] for c in schemas.BLOCK.split(", ")]
    block = spark.createDataFrame([tuple(b[n] for n in names) for b in full], schemas.BLOCK)
    doc = spark.createDataFrame([(1, "Budget plan.pdf", len(pages), language, meta or {"title": "Budget", "language": "en"})], schemas.DOC)
    page = spark.createDataFrame([(1, p, 612.0, 792.0, t, None) for p, t in pages], schemas.PAGE)
    return schemas.Corpus(doc, page, block)


def test_empty_document_has_fifty_results(spark):
    c = corpus(spark, [(0, True)], [])
    assert checks.audit_findings(c).select("criterion").distinct().count() == 50
    r = checks.audit_documents(c).collect()[0]
    assert r["rules_checked"] == 50 and r["rules_errored"] == 0


def test_rich_document(spark):
    c = corpus(spark, [(0, True), (1, True)], [
        {"block_type": "heading", "content": "Title", "level": 1},
        {"block_type": "paragraph", "content": "more info https://example.org/a"},
        {"block_type": "image", "alt": "A lake"}, {"block_type": "heading", "content": "Part", "level": 2, "page_num": 1},
        {"block_type": "image", "alt": "", "page_num": 1},
    ])
    fails = {(r["criterion"], r["page"]) for r in checks.audit_findings(c, ["1.1.1", "2.4.4"]).filter("status = 'fail'").collect()}
    assert fails == {("1.1.1", 1), ("2.4.4", 0)}
    found = checks.audit_findings(c)
    a = {r["doc_id"]: r.asDict() for r in reports.audit_result(found).collect()}
    b = {r["doc_id"]: r.asDict() for r in checks.audit_documents(c).collect()}
    assert a == b


def test_registered_check_failure_becomes_error(spark):
    def broken(c):
        raise ValueError("no such column")

    checks.register_check("own.1", broken)
    try:
        c = corpus(spark, [(0, True)], [])
        assert checks.audit_findings(c).filter("status = 'error'").select("criterion").collect()[0][0] == "own.1"
    finally:
        checks._EXTRA_CHECKS.clear()


def test_gates_on_documents(spark):
    def statuses(c, gate):
        return {r["check_name"]: r["status"] for r in gate(c).collect()}

    text = {"block_type": "paragraph", "content": "words"}
    assert statuses(corpus(spark, [(0, True)], [text]), gates.g1)["has_text_content"] == "pass"
    assert statuses(corpus(spark, [], []), gates.g1)["has_pages"] == "hard_fail"
    assert statuses(corpus(spark, [(0, True), (1, True)], [text]), gates.g1)["non_empty_pages"] == "soft_fail"
    twice = corpus(spark, [(0, True)], [dict(text, block_id="x"), dict(text, block_id="x")])
    assert statuses(twice, gates.g2)["unique_block_ids"] == "hard_fail"


HTML_OK = ('<html lang="en"><head><title>T</title></head><body><main><h1>A</h1><h2>B</h2><img src="a" alt="b">'
           '<table><tr><th scope="col">x</th></tr></table></main></body></html>')


@pytest.mark.parametrize("html,check,status", [
    (HTML_OK.replace(' lang="en"', ""), "html_lang", "hard_fail"), (HTML_OK.replace(' alt="b"', ""), "img_alt", "hard_fail"),
    (HTML_OK.replace("h2", "h4"), "heading_hierarchy", "soft_fail"), (HTML_OK.replace('src="a"', 'src=""'), "img_src", "hard_fail"),
    (HTML_OK.replace('src="a"', "src=''"), "img_src", "hard_fail"), (HTML_OK.replace(' scope="col"', ""), "table_headers", "hard_fail"),
])
def test_html_gate(spark, html, check, status):
    df = spark.createDataFrame([(1, html)], "doc_id int, html string")
    assert {r["check_name"]: r["status"] for r in gates.g3_structural(df).collect()}[check] == status


def test_html_gate_clean_and_without_table(spark):
    df = spark.createDataFrame([(1, HTML_OK), (2, "<html lang=\"en\"><main><p>x</p></main></html>")], "doc_id int, html string")
    rows = gates.g3_structural(df).collect()
    assert not [r for r in rows if r["status"] == "hard_fail"]
    assert not [r for r in rows if r["doc_id"] == 2 and r["check_name"] == "table_headers"]


def test_html_scores(spark):
    df = spark.createDataFrame([(1, HTML_OK.replace("<table>", "<table><thead>").replace("</table>", "</thead></table>"))], "doc_id int, html string")
    assert html_checks.html_scores(df).collect()[0]["score"] == 100.0


def test_votes(spark):
    rows = [("all", "pass", "pass", "pass"), ("none", "fail", "fail", "fail"), ("most", "pass", "pass", "fail"),
            ("tie", "pass", "fail", "skip"), ("one", "pass", "skip", "skip"), ("zero", "skip", "skip", "skip")]
    df = spark.createDataFrame([(1, *r) for r in rows], "doc_id int, rule_id string, internal string, pdfua string, matterhorn string")
    got = {r["rule_id"]: (r["confidence"], r["needs_review"]) for r in reports.vote_confidence(df).collect()}
    assert got == {"all": ("high", False), "none": ("high", False), "most": ("medium", False), "tie": ("low", True),
                   "one": ("low", False), "zero": ("low", True)}


def test_pdfua_reports(spark):
    direct = '{"compliant":false,"ruleSummaries":[{"clause":"7.4","failedChecks":0},{"clause":"7.4","failedChecks":3},{"clause":"7.18.1","failedChecks":1},{"clause":"7.1","failedChecks":0}]}'
    nested = '{"report":{"jobs":[{"validationResult":{"compliant":false,"details":{"rules":[{"status":"failed","clause":"7.1","ruleId":{"id":"R9"},"failedChecks":5},{"status":"passed"}]}}}]}}'
    df = spark.createDataFrame([(1, direct), (2, nested)], "doc_id int, body string")
    got = {r["doc_id"]: r for r in scans.scan_pdfua(df).collect()}
    assert (got[1]["error_count"], got[1]["clauses"], got[1]["passed"]) == (4, ["7.18.1", "7.4"], 2)
    assert (got[2]["error_count"], got[2]["failed_rules"][0]["rule_id"]) == (5, "R9")


def test_publishable_exemption(spark):
    schema = "doc_id int, gate_id string, check_name string, status string, severity string, priority string, next_action string, n bigint"
    off = (gates.PDFUA, "verapdf_available", "soft_fail", "moderate", "P1", "flag_hitl", 0)
    ok = ("G4", "adobe_checker_pass", "pass", "minor", "P2", "proceed", 0)
    bad = (gates.PDFUA, "clause_7.1", "soft_fail", "serious", "P1", "flag_hitl", 1)
    df = spark.createDataFrame([(1, *off), (1, *ok), (2, *off), (3, *off), (3, *ok), (3, *bad)], schema)
    assert {r["doc_id"]: r["publishable"] for r in gates.publishable(df).collect()} == {1: True, 2: False, 3: False}


def test_rules(spark):
    el = spark.createDataFrame(
        [(1, 0, "table", "", None, None, None, None), (1, 1, "heading", "x", None, None, 4, 2), (1, 2, "image", "", " ", None, None, None)],
        "doc_id int, seq int, type string, content string, alt string, headers array<string>, level int, prev_level int",
    ).selectExpr("*", "CAST(NULL AS STRING) AS scope", "false AS removed")
    schema = "id string, trigger_pattern string, action struct<type:string,value:string>, confidence double, version int"
    chain = [
        ("1", "image:no_alt", ("set_alt", "it's"), 0.9, 1), ("2", "image:no_alt", ("remove_element", ""), 0.9, 2),
        ("3", "heading:skip_level", ("set_heading", "3"), 0.9, 3), ("4", "table:missing_headers", ("add_scope", "col"), 0.9, 4),
        ("5", "image:no_alt", ("set_alt", "too unsure"), 0.6, 0)]
    out, log = rules.apply_rules(el, rules.valid_rules(spark.createDataFrame(chain, schema)))
    got = {r["seq"]: (r["alt"], r["level"], r["scope"], r["removed"]) for r in out.collect()}
    assert got == {0: (None, None, "col", False), 1: (None, 3, None, False), 2: ("it's", None, None, False)}
    assert log.count() == 12 and log.filter("matched").count() == 3
    # Six hundred rules, applied from the highest version back to the first by their order alone.
    many = [(f"m{i}", "heading:skip_level", ("set_heading", "9" if i else "2"), 0.9, 600 - i) for i in range(600)]
    out, log = rules.apply_rules(el, rules.valid_rules(spark.createDataFrame(many, schema)))
    assert {r["seq"]: r["level"] for r in out.collect()} == {0: None, 1: 2, 2: None}
    assert log.count() == 1800 and log.filter("matched").count() == 600


@pytest.mark.parametrize("row,impact,risk,scope", [
    (("Always do", "image", "critical", "1.1.1", None), "positive", "high", "global_rule"),
    (("fix", "table", "minor", "", None), "neutral", "high", "single_doc"),
    (("fix", "image", "serious", "1.1.1", "approve"), "negative", "low", "single_doc"),
    ((" ", "heading", "serious", "1.1.1", None), "neutral", "medium", "single_doc"),
])
def test_change_evaluation(spark, row, impact, risk, scope):
    df = spark.createDataFrame([row], "human_comment string, element_type string, finding_severity string, finding_criterion string, reviewer_decision string")
    r = workflow.evaluate(df).collect()[0]
    assert (r["compliance_impact"], r["risk"], r["scope"]) == (impact, risk, scope)


def test_dimensions(spark):
    rule, xref, tech = dimensions.rules(spark), dimensions.bridge(spark), dimensions.techniques(spark)
    assert dimensions.ledger_violations(rule, xref).count() == 0
    assert dimensions.bridge_violations(tech, xref).count() == 0
    assert dimensions.ledger_violations(rule.filter("criterion <> '1.1.1'"), xref).count() > 2
    assert dimensions.bridge_violations(tech.filter("technique_id <> 'F25'"), xref).count() >= 2
    refs = {r["criterion"]: r["technique_refs"] for r in dimensions.technique_refs(rule, xref).collect()}
    assert refs["1.1.1"] == "PDF1, PDF4; Failures: F30, F38, F39, F65" and refs["2.4.3"] == "PDF3" and refs["1.2.1"] == ""
    assert rule.filter("principle = 'perceivable'").count() == 20


def test_text_cleanup(spark):
    cases = {"I N F R A plan": "INFRA plan", "JANU ARY report": "JANUARY report", "COUNTY ROAD": "COUNTY ROAD", "x (<>) y": "xy",
             "PROGRAMM E S": "PROGRAMMES", "a Page 3 of 9 b": "a  b", "C:\\a\\b.doc x": "x", "FOO BAR S": "FOO BAR S"}
    df = spark.createDataFrame([(k,) for k in cases], "Text string")
    assert {r["Text"]: r["t"] for r in df.selectExpr("Text", f"{elements.CLEAN_TEXT} AS t").collect()} == cases


def test_filename_and_colour(spark):
    df = spark.createDataFrame([("a/b\\c?.pdf",), ("__",), ("x" * 300 + ".pdf",)], "n string")
    got = [r[0] for r in df.selectExpr(f"{scans.sanitize_filename('n')}").collect()]
    assert got[0] == "a_b_c_.pdf" and got[1] == "document.pdf" and len(got[2]) == 255 and got[2].endswith(".pdf")
    rgb = spark.createDataFrame([([0.435, 0.184, 0.623],), ([1.0],)], "rgb array<double>")
    assert [r[0] for r in rgb.selectExpr(scans.RGB_HEX).collect()] == ["#6e2e9e", None]


def test_duplicate_table_kept_once(spark):
    t = {"block_type": "table", "content": "Primary  Factor", "headers": ["a"], "rows": [["1"]]}
    c = corpus(spark, [(0, True)], [t, dict(t, content="primary factor"), dict(t, page_num=1)])
    assert [r["seq"] for r in dedupe.drop_duplicate_tables(c.block).orderBy("seq").collect()] == [0, 2]


def test_sinks(spark, tmp_path):
    schema = "item_id int, document_id int, element_type string, finding_id string, ai_suggestion string, reviewer_decision string, reviewer_edit string, reviewed_by string, reviewed_at timestamp"
    rows = workflow.manual_review_rows(spark.createDataFrame([], schema))
    sinks.write_manual_review(rows, str(tmp_path / "review"))
    text = "".join(p.read_text() for p in (tmp_path / "review").glob("part-*"))
    assert text.strip() == "" or text.startswith("item_id,document_id")
    assert rows.columns[-1] == "reason_for_manual_review" and len(rows.columns) == 10
    check = "doc_id int, gate_id string, check_name string, status string, severity string, priority string, next_action string, n bigint"
    led = gates.ledger(spark.createDataFrame([(1, "G1", "has_pages", "pass", "minor", "P2", "proceed", 0)], check),
                       spark.createDataFrame([(1, "a.pdf")], "doc_id int, filename string"))
    sinks.write_ledger(led, str(tmp_path / "ledger"))
    back = spark.read.json(str(tmp_path / "ledger")).collect()[0]
    assert back["summary"]["decision"] == "proceed" and back["gates"][0]["checks"][0]["check_name"] == "has_pages"
    out = spark.createDataFrame([(1, "html", "<p>"), (2, "html", "<b>")], "doc_id int, kind string, body string")
    sinks.write_documents(out, str(tmp_path / "docs"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "docs")).count() == 2
    sinks.append_table(out, str(tmp_path / "t"))
    sinks.append_table(out, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_html_pieces(spark, tmp_path):
    schema = ("doc_id int, seq int, block_type string, content string, level int, src string, alt string, items array<string>, "
              "ordered boolean, caption string, headers array<string>, rows array<array<string>>")
    blank = (None,) * 7
    block = [(1, 0, "heading", "Deep", 3, *blank), (1, 1, "heading", "Contents", 2, *blank), (1, 2, "heading", "A & B", 2, *blank),
             (1, 3, "heading", "Inner", 4, *blank), (1, 4, "heading", "Last", 2, *blank),
             (1, 5, "table", "", None, None, None, None, None, None, ["H", "V"], [["Fee", "5"], ["7", "8"], ["all"]]),
             (2, 0, "paragraph", "x", None, *blank)]
    doc = spark.createDataFrame([(1, "a.pdf", "en", {}), (2, "b.pdf", None, {"title": "<t>"}), (3, "c.pdf", "de", {})],
                                "doc_id int, filename string, language string, metadata map<string,string>")
    pieces = ordered.html_documents(spark.createDataFrame(block, schema), doc)
    sinks.write_html(pieces, str(tmp_path / "html"), buckets=2)
    text = {}
    for r in spark.read.parquet(str(tmp_path / "html")).orderBy("doc_id", "seq", "part", "item").collect():
        text[r["doc_id"]] = text.get(r["doc_id"], "") + r["html"]
    assert text[2].startswith('<!DOCTYPE html><html lang="en"><head><title>&lt;t&gt;</title>') and "<p>x</p></main>" in text[2]
    assert text[3].endswith('<main id="main-content"></main></body></html>')
    assert ('id="sec-contents">Contents</h2><nav aria-label="Table of Contents" id="toc"><h2>Contents</h2><ol>'
            '<li><ol><li><a href="#sec-deep">Deep</a></li></ol></li>'
            '<li><a href="#sec-a--b">A &amp; B</a><ol><li><a href="#sec-inner">Inner</a></li></ol></li>'
            '<li><a href="#sec-last">Last</a></li></ol></nav>') in text[1]
    assert ('<tr><th scope="row">Fee</th><td>5</td></tr><tr><td>7</td><td>8</td></tr><tr><td colspan="2">all</td></tr>') in text[1]


def test_stage_runs_pair_in_order(spark):
    rows = [(1, "start", 0), (2, "end", 5), (3, "end", 6), (4, "start", 25), (5, "start", 30), (6, "end", 31)]
    event = spark.createDataFrame([("r", "a", p, t, i) for i, p, t in rows] + [("r", "b", "failed", 3, 9)],
                                  "run_id string, stage string, phase string, t int, event_id int").selectExpr("*", "timestamp_seconds(t) AS ts")
    got = {r["stage"]: (r["duration_s"], r["n_runs"]) for r in events.stage_durations(event).collect()}
    assert got == {"a": (1.0, 2), "b": (None, 0)}
