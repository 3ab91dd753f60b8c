"""Sales-pipeline metrics over cleaned deals.

Every result is a DataFrame; a scalar metric is a one-row aggregate. Ordered results
break ties by the group key. ``status=None`` means no status filter.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizmetrics import config
from bizmetrics.functions import dates
from bizmetrics.functions.numbers import exact_average, exact_sum

OPEN = "Open"
CLOSING_COLUMNS = [
    "deal_name", "sector", "deal_value", "deal_stage", "closure_probability",
    "tentative_close_date",
]
_TOTAL = f"{exact_sum('deal_value')} AS total_value"


def _valued(deals: DataFrame, status: str | None) -> DataFrame:
    df = deals.filter("deal_value > 0")
    return df.filter(F.col("deal_status") == status) if status else df


def pipeline_by_sector(deals: DataFrame, status: str | None = OPEN) -> DataFrame:
    return (
        _valued(deals, status)
        .groupBy("sector")
        .agg(
            F.expr("count(*) AS deal_count"),
            F.expr(_TOTAL),
            F.expr(f"{exact_average('deal_value')} AS avg_value"),
        )
        .orderBy(F.desc("total_value"), "sector")
    )


def top_sector(deals: DataFrame, status: str | None = OPEN) -> DataFrame:
    return pipeline_by_sector(deals, status).select("sector", "total_value").limit(1)


def pipeline_by_stage(deals: DataFrame, status: str | None = OPEN) -> DataFrame:
    return (
        _valued(deals, status)
        .groupBy("deal_stage")
        .agg(F.expr("count(*) AS deal_count"), F.expr(_TOTAL))
        .orderBy(F.desc("total_value"), "deal_stage")
    )


def average_deal_size(deals: DataFrame, status: str | None = None) -> DataFrame:
    """All statuses unless one is given, although dashboards label it as open deals."""
    return _valued(deals, status).selectExpr(
        f"CASE WHEN count(*) > 0 THEN {exact_average('deal_value')} ELSE 0D END"
        " AS average_deal_size"
    )


def total_pipeline_value(deals: DataFrame, status: str | None = OPEN) -> DataFrame:
    return _valued(deals, status).selectExpr(f"{exact_sum('deal_value')} AS total_pipeline")


def active_deals(deals: DataFrame) -> DataFrame:
    """Open deals, those without a value included."""
    return deals.filter(F.col("deal_status") == OPEN).selectExpr(
        "count(*) AS active_deals"
    )


def _closing(deals: DataFrame, window: str) -> DataFrame:
    return deals.filter(F.col("deal_status") == OPEN).filter(window)


def _in_order(df: DataFrame, order_by: list[str] | None) -> DataFrame:
    """In source order, by the position columns that cleaning has kept; they are dropped.
    Only the listed rows are sorted, by ranges."""
    return df.orderBy(*order_by).drop(*order_by) if order_by else df


def closing_this_month(
    deals: DataFrame, as_of: dt.date | None = None, order_by: list[str] | None = None
) -> DataFrame:
    """Open deals with a tentative close date in the month of ``as_of`` (today if None).

    In the order of the source if ``order_by`` names its position columns, else unordered.
    """
    window = dates.in_month("tentative_close_date", as_of or dt.date.today())
    kept = [c for c in CLOSING_COLUMNS if c not in (order_by or [])]
    return _in_order(_closing(deals, window).select(*(order_by or []), *kept), order_by)


def closing_this_quarter(
    deals: DataFrame, as_of: dt.date | None = None, sector: str | None = None,
    order_by: list[str] | None = None,
) -> DataFrame:
    """Same for the calendar quarter, all columns. The sector argument is lower-cased
    only, not looked up among the aliases."""
    window = dates.in_quarter("tentative_close_date", as_of or dt.date.today())
    df = _closing(deals, window)
    return _in_order(df.filter(F.col("sector") == sector.lower()) if sector else df, order_by)


def deal_creation_trend(deals: DataFrame, months: int = 6) -> DataFrame:
    """Deals per created month, the last ``months`` months that have any, ascending."""
    per_month = (
        deals.filter("created_date IS NOT NULL")
        .groupBy(F.expr(dates.month_label("created_date")).alias("month"))
        .agg(F.expr("count(*) AS deal_count"))
    )
    return per_month.orderBy(F.desc("month")).limit(months).orderBy("month")


def pipeline_stage_quarter(
    deals: DataFrame, as_of: dt.date | None = None, sector: str | None = None
) -> DataFrame:
    """Open, valued deals closing this quarter by stage; unnamed deals are not counted
    and deals without a stage are left out."""
    return (
        closing_this_quarter(deals, as_of, sector)
        .filter("deal_value > 0 AND deal_stage IS NOT NULL")
        .groupBy("deal_stage")
        .agg(F.expr("count(deal_name) AS deal_count"), F.expr(_TOTAL))
        .orderBy(F.desc("total_value"), "deal_stage")
    )


def deals_in_negotiation(deals: DataFrame) -> DataFrame:
    return deals.filter(
        (F.col("deal_stage") == config.NEGOTIATION_STAGE)
        & (F.col("deal_status") == OPEN)
    ).selectExpr("count(*) AS deals_in_negotiation")


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, nulls left out."""
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.expr("count(*) AS count"))
        .orderBy(F.desc("count"), column)
    )
    return counts.limit(top) if top else counts


def top_sectors(deals: DataFrame, top: int = 5) -> DataFrame:
    return value_counts(deals, "sector", top)


def status_distribution(deals: DataFrame) -> DataFrame:
    return value_counts(deals, "deal_status")
