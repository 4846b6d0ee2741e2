"""Writers: ledger, review file, gap report and per-document outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """One nested JSON record per document."""
    ledger.write.mode("overwrite").json(path)


def write_manual_review(rows: DataFrame, path: str) -> None:
    """CSV with a header line even when there is nothing to review."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def gap_report(score: DataFrame, gap: DataFrame) -> DataFrame:
    """Per document: status, score, colour and its gaps in one nested record."""
    gaps = gap.groupBy("doc_id").agg(
        F.expr("array_sort(collect_list(struct(ord, check_id, severity, classification))) AS gaps"))
    return score.join(gaps, "doc_id", "left").selectExpr(
        "doc_id", "score",
        "CASE WHEN score IS NULL THEN 'UNKNOWN' WHEN score >= 90 THEN 'GREEN' WHEN score >= 70 THEN 'YELLOW' ELSE 'RED' END AS colour",
        "coalesce(gaps, array()) AS gaps")


def write_gap_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_documents(outputs: DataFrame, path: str, buckets: int = 256) -> None:
    """(doc_id, kind, body) grouped in a bounded number of folders; a folder per document would not scale."""
    outputs.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).repartition("bucket", "kind").write.mode(
        "overwrite").partitionBy("bucket", "kind").parquet(path)


def write_html(pieces: DataFrame, path: str, buckets: int = 256) -> None:
    """Pieces of HTML documents, each document in order within one of a bounded number of folders."""
    placed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    placed.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "seq", "part", "item").write.mode(
        "overwrite").partitionBy("bucket").parquet(path)
