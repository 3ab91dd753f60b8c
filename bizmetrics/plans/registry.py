"""Metric requests by name.

A request names a metric, optionally a sector and a period, and gets DataFrames back.
Nothing runs until the caller asks a frame for rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from bizmetrics import config
from bizmetrics.plans import financial, operational, pipeline, report
from bizmetrics.plans.leadership import leadership_kpis, to_long


@dataclass
class MetricResult:
    """``data`` and ``chart_data`` are frames, ``kpis`` a long KPI table. ``order`` names the
    columns the data is ordered by, and whether they descend."""

    data: DataFrame | None = None
    chart_data: DataFrame | None = None
    chart_type: str | None = None
    kpis: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)
    order: list[tuple[str, bool]] | None = None


@dataclass
class Request:
    deals: DataFrame | None
    work_orders: DataFrame | None
    as_of: dt.date
    sector: str | None = None
    period: str | None = None
    status: str | None = None


def _chart(data: DataFrame, chart_type: str, first: str | None, kpis: DataFrame | None = None):
    """``first`` is the column whose largest values come first; the key breaks ties."""
    order = ([(first, True)] if first else []) + [(data.columns[0], False)]
    return MetricResult(data=data, chart_data=data, chart_type=chart_type, kpis=kpis, order=order)


def _status(r: Request) -> str:
    return r.status or pipeline.OPEN


def _pipeline_by_sector(r: Request) -> MetricResult:
    # the sector and period of a request play no part here
    total = pipeline.total_pipeline_value(r.deals, _status(r))
    return _chart(
        pipeline.pipeline_by_sector(r.deals, _status(r)),
        "bar_sector",
        "total_value",
        to_long(total, {"total_pipeline": "money"}),
    )


def _pipeline_by_stage(r: Request) -> MetricResult:
    return _chart(pipeline.pipeline_by_stage(r.deals, _status(r)), "bar_stage", "total_value")


def _closing_soon(r: Request) -> MetricResult:
    # by month only on explicit request, and then without the sector
    if r.period == config.PERIODS[0]:
        data = pipeline.closing_this_month(r.deals, r.as_of)
    else:
        data = pipeline.closing_this_quarter(r.deals, r.as_of, r.sector)
    return MetricResult(data=data, chart_type="table")


def _average_deal_size(r: Request) -> MetricResult:
    size = pipeline.average_deal_size(r.deals, r.status)
    return MetricResult(kpis=to_long(size, {"average_deal_size": "money"}))


def _active_deals(r: Request) -> MetricResult:
    return MetricResult(
        kpis=to_long(pipeline.active_deals(r.deals), {"active_deals": "count"})
    )


def _deal_trends(r: Request) -> MetricResult:
    return _chart(pipeline.deal_creation_trend(r.deals), "line_trend", None)


def _work_orders_by_sector(r: Request) -> MetricResult:
    return _chart(operational.work_orders_by_sector(r.work_orders), "bar_sector", "order_count")


def _execution_status(r: Request) -> MetricResult:
    return _chart(operational.execution_status(r.work_orders), "pie", "count")


def _billing_completion(r: Request) -> MetricResult:
    units = {
        "total_amount": "money",
        "billed_amount": "money",
        "unbilled_amount": "money",
        "completion_rate": "percent",
    }
    return MetricResult(kpis=to_long(operational.billing_completion(r.work_orders), units))


def _total_billed(r: Request) -> MetricResult:
    return MetricResult(
        kpis=to_long(financial.total_billed(r.work_orders), {"total_billed": "money"})
    )


def _total_collected(r: Request) -> MetricResult:
    total = financial.total_collected(r.work_orders)
    return MetricResult(kpis=to_long(total, {"total_collected": "money"}))


def _receivables(r: Request) -> MetricResult:
    total = financial.total_receivable(r.work_orders)
    return _chart(
        financial.receivables_by_sector(r.work_orders),
        "bar_sector",
        "receivable_amount",
        to_long(total, {"total_receivable": "money"}),
    )


def _billing_vs_collection(r: Request) -> MetricResult:
    return _chart(financial.billing_vs_collection(r.work_orders), "grouped_bar", "billed")


def _financial_summary(r: Request) -> MetricResult:
    units = {
        "total_billed": "money",
        "total_collected": "money",
        "total_receivable": "money",
        "collection_rate": "percent",
        "outstanding_ratio": "percent",
    }
    return MetricResult(kpis=to_long(financial.financial_summary(r.work_orders), units))


def _leadership(r: Request) -> MetricResult:
    return MetricResult(chart_type="none", kpis=leadership_kpis(r.deals, r.work_orders))


def _general(r: Request) -> MetricResult:
    return MetricResult(
        data=report.context_summary(r.deals, r.work_orders), chart_type="none",
        order=[("section", False), ("count", True), ("value", False)],
    )


DEAL_METRICS: dict[str, Callable[[Request], MetricResult]] = {
    "pipeline_value": _pipeline_by_sector,
    "pipeline_by_sector": _pipeline_by_sector,
    "pipeline_by_stage": _pipeline_by_stage,
    "deals_closing_soon": _closing_soon,
    "average_deal_size": _average_deal_size,
    "active_deals": _active_deals,
    "deal_trends": _deal_trends,
    "leadership_update": _leadership,
}
WORK_ORDER_METRICS: dict[str, Callable[[Request], MetricResult]] = {
    "work_orders_by_sector": _work_orders_by_sector,
    "execution_status": _execution_status,
    "billing_completion_rate": _billing_completion,
    "total_billed": _total_billed,
    "total_collected": _total_collected,
    "receivables": _receivables,
    "billing_vs_collection": _billing_vs_collection,
    "financial_summary": _financial_summary,
}
# The other work-order metrics stay silent when the table is missing.
WARN_WITHOUT_WORK_ORDERS = {
    "work_orders_by_sector", "execution_status", "billing_completion_rate",
}


def run_metric(
    name: str,
    deals: DataFrame | None = None,
    work_orders: DataFrame | None = None,
    as_of: dt.date | None = None,
    sector: str | None = None,
    period: str | None = None,
    status: str | None = None,
) -> MetricResult:
    """Unknown names get the context summary; failures become a warning."""
    request = Request(
        deals, work_orders, as_of or dt.date.today(), sector, period, status
    )
    if name in WORK_ORDER_METRICS:
        if work_orders is None:
            warn = name in WARN_WITHOUT_WORK_ORDERS
            return MetricResult(warnings=["Work orders data not loaded."] if warn else [])
        plan = WORK_ORDER_METRICS[name]
    else:
        # this covers unknown names and the leadership update as well
        if deals is None:
            return MetricResult(warnings=["Deals data not loaded."])
        plan = DEAL_METRICS.get(name, _general)
    try:
        return plan(request)
    except PySparkException as e:
        return MetricResult(warnings=[f"Error computing analytics: {e}"])
