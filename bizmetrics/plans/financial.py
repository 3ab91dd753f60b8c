"""Billing, collection and receivables over cleaned work orders.

Totals that the same report needs share one scan: they are conditional sums of a single
aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizmetrics import config
from bizmetrics.functions.numbers import exact_sum, percent


def _positive(column: str) -> str:
    return exact_sum(column, f"{column} > 0")


BILLED = _positive("billed_value")
COLLECTED = _positive("collected_amount")
RECEIVABLE = _positive("amount_receivable")
COLLECTION_RATE = percent(COLLECTED, BILLED)
OUTSTANDING_RATIO = percent(RECEIVABLE, BILLED)


def total_billed(work_orders: DataFrame) -> DataFrame:
    return work_orders.filter("billed_value > 0").selectExpr(f"{BILLED} AS total_billed")


def total_collected(work_orders: DataFrame) -> DataFrame:
    return work_orders.filter("collected_amount > 0").selectExpr(
        f"{COLLECTED} AS total_collected"
    )


def total_receivable(work_orders: DataFrame) -> DataFrame:
    return work_orders.filter("amount_receivable > 0").selectExpr(
        f"{RECEIVABLE} AS total_receivable"
    )


def collection_rate(work_orders: DataFrame) -> DataFrame:
    return work_orders.selectExpr(f"{COLLECTION_RATE} AS collection_rate")


def financial_summary(work_orders: DataFrame) -> DataFrame:
    return work_orders.selectExpr(
        f"{BILLED} AS total_billed",
        f"{COLLECTED} AS total_collected",
        f"{RECEIVABLE} AS total_receivable",
        f"{COLLECTION_RATE} AS collection_rate",
        f"{OUTSTANDING_RATIO} AS outstanding_ratio",
    )


def billing_vs_collection(work_orders: DataFrame) -> DataFrame:
    totals = {
        "billed": "billed_value",
        "collected": "collected_amount",
        "receivable": "amount_receivable",
        "to_be_billed": "amount_to_be_billed",
    }
    return (
        work_orders.filter(F.col("sector") != config.UNKNOWN)
        .groupBy("sector")
        .agg(*[F.expr(f"{exact_sum(c)} AS {name}") for name, c in totals.items()])
        .orderBy(F.desc("billed"), "sector")
    )


def billing_series_long(work_orders: DataFrame) -> DataFrame:
    """Grouped-bar data: one row per sector and series."""
    return (
        billing_vs_collection(work_orders)
        .unpivot("sector", ["billed", "collected", "receivable"], "series", "amount")
        .withColumn("series", F.initcap("series"))
    )


def receivables_by_sector(work_orders: DataFrame) -> DataFrame:
    """Unknown sectors included."""
    return (
        work_orders.filter("amount_receivable > 0")
        .groupBy("sector")
        .agg(
            F.expr(f"{exact_sum('amount_receivable')} AS receivable_amount"),
            F.expr("count(*) AS wo_count"),
        )
        .orderBy(F.desc("receivable_amount"), "sector")
    )
