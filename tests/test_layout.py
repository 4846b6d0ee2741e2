"""The OCR scan over whole texts."""

from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_layout_reads_whole_texts(spark):
    name = "ocr_layout_scan"
    _, _, problem = compare(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None, problem
    found = {}
    for r in entry.queries()[name](spark, SF).collect():
        found.setdefault((r["doc_id"], r["block_type"]), {})[r["ord"]] = r["content"] + r["headers"] + r["rows"]
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for kind in ("paragraph", "table")[: 2 - doc_id % 2]:
            got = "".join(x for _, x in sorted(found.get((doc_id, kind), {}).items()))
            assert "".join(got.replace("|", "").split()) == "".join((text or "").replace("|", "").split()), (doc_id, kind)
