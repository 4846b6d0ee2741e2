"""Name -> plan and name -> comparison SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
COMPARISONS: dict[str, str] = {}

MODULES = (
    "fixes", "scans", "elements", "ordered", "dedupe", "joins", "checks", "reports", "gates", "html", "rules",
    "workflow", "profiling", "events",
)


def prepare(spark: SparkSession) -> None:
    """Session setting the plans rely on.

    Spark 4.1 reports a union of equally partitioned inputs as partitioned itself, and a
    join on top of such a union can then miss its matches; without the setting the
    union is shuffled like any other input.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def _prepared(plan: Plan) -> Plan:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return plan(spark, sf_dir)

    run.__doc__ = plan.__doc__
    return run


def query(name: str, sql: str | None = None):
    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = _prepared(plan)
        if sql is not None:
            COMPARISONS[name] = sql
        return plan

    return register


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"pagelight.plans.{module}")
