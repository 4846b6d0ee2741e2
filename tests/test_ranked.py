"""The review ranking reads its findings once."""

from pyspark.sql import functions as F

from pagelight.operators import reports


def test_ranking_shares_its_exchange(spark):
    rows = spark.range(40).selectExpr(
        "id % 3 AS doc_id", "'1.1.1' AS criterion", "1 AS ord", "CAST(id % 4 AS INT) AS page", "CAST(id AS STRING) AS proposal_id", "'x' AS issue",
        "'serious' AS severity", "id % 2 = 0 AS auto_fixable", "'ai_draft' AS action_type")
    out = reports.ranked(rows, ["ord", "page", "proposal_id", "issue"], keep=["criterion"]).select("doc_id", "criterion", "page", "issue", "priority", "proposal_id", "review_rank")
    assert out.groupBy("doc_id").agg(F.max("review_rank").alias("m")).agg(F.sum("m")).collect()[0][0] == 40
    assert "ReusedExchange" in (out.collect() and out._jdf.queryExecution().executedPlan().toString())
