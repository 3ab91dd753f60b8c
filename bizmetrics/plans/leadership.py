"""Leadership KPIs as a long table ``(metric, value, unit, display)``.

One pass per table: deals are grouped by sector once, and totals, counts and the top
sector are all read off that small result; work orders are a single aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizmetrics import config
from bizmetrics.functions.display import kpi_display, kpi_label
from bizmetrics.functions.numbers import both_totals, fine_total, large_total
from bizmetrics.functions.text import find, literal
from bizmetrics.plans import financial, operational

DEAL_UNITS = {
    "total_pipeline": "money",
    "active_deals": "count",
    "avg_deal_size": "money",
    "top_sector": "text",
    "top_sector_value": "money",
    "deals_in_negotiation": "count",
}
WORK_ORDER_UNITS = {
    "active_work_orders": "count",
    "billing_completion": "percent",
    "total_receivable": "money",
    "total_billed": "money",
    "total_collected": "money",
    "collection_rate": "percent",
}
CARDS = {
    "total_pipeline": ("Pipeline Value", "Open deals"),
    "active_deals": ("Active Deals", "Status: Open"),
    "total_receivable": ("Receivables", "Outstanding"),
    # the caption says open, the number covers all deals
    "avg_deal_size": ("Avg Deal Size", "All open deals"),
}


def to_long(wide: DataFrame, units: dict[str, str]) -> DataFrame:
    """One-row frame to KPI rows. A text KPI has no value, only a display."""

    def row(name: str, unit: str) -> str:
        value, text = ("NULL", name) if unit == "text" else (name, "NULL")
        return (
            f"named_struct('metric', {literal(name)}, 'value', CAST({value} AS DOUBLE), "
            f"'unit', {literal(unit)}, 'text', CAST({text} AS STRING))"
        )

    rows = ", ".join(row(name, unit) for name, unit in units.items())
    return wide.selectExpr(f"inline(array({rows}))").selectExpr(
        "metric", "value", "unit", f"coalesce(text, {kpi_display('value', 'unit')}) AS display"
    )


def deal_kpis(deals: DataFrame) -> DataFrame:
    valued, is_open = "deal_value > 0", "deal_status = 'Open'"
    per_sector = deals.groupBy("sector").agg(
        F.expr(f"{fine_total('deal_value', f'{valued} AND {is_open}')} AS open_fine"),
        F.expr(f"{large_total('deal_value', f'{valued} AND {is_open}')} AS open_large"),
        F.expr(f"{fine_total('deal_value', valued)} AS fine"),
        F.expr(f"{large_total('deal_value', valued)} AS large"),
        F.expr(f"count_if({valued}) AS valued"),
        F.expr(f"count_if({is_open}) AS open"),
        F.expr(
            f"count_if({is_open} AND deal_stage = {literal(config.NEGOTIATION_STAGE)})"
            " AS negotiating"
        ),
    )
    per_sector = per_sector.withColumn("open_total", F.expr(both_totals("open_fine", "open_large")))
    # null for sectors without open value, so they cannot be the top one
    ranked = "CASE WHEN open_total IS NOT NULL THEN struct(-open_total, sector) END"
    wide = per_sector.selectExpr(
        f"coalesce({both_totals('sum(open_fine)', 'sum(open_large)')}, 0D) AS total_pipeline",
        "coalesce(sum(open), 0) AS active_deals",
        f"CASE WHEN sum(valued) > 0 THEN {both_totals('sum(fine)', 'sum(large)')} / sum(valued) "
        "ELSE 0D END AS avg_deal_size",
        f"min_by(sector, {ranked}) AS top_sector",
        "max(open_total) AS top_sector_value",
        "coalesce(sum(negotiating), 0) AS deals_in_negotiation",
    )
    # without any open value there is no top sector to report
    return to_long(wide, DEAL_UNITS).filter("display IS NOT NULL")


def work_order_kpis(work_orders: DataFrame) -> DataFrame:
    wide = work_orders.selectExpr(
        f"{operational.active_orders(work_orders.columns)} AS active_work_orders",
        f"{operational.COMPLETION_RATE} AS billing_completion",
        f"{financial.RECEIVABLE} AS total_receivable",
        f"{financial.BILLED} AS total_billed",
        f"{financial.COLLECTED} AS total_collected",
        f"{financial.COLLECTION_RATE} AS collection_rate",
    )
    return to_long(wide, WORK_ORDER_UNITS)


def leadership_kpis(
    deals: DataFrame | None, work_orders: DataFrame | None
) -> DataFrame | None:
    """KPIs of a table that is not loaded are absent."""
    parts = []
    if deals is not None:
        parts.append(deal_kpis(deals))
    if work_orders is not None:
        parts.append(work_order_kpis(work_orders))
    return reduce(DataFrame.unionByName, parts) if parts else None


def kpi_cards(deals: DataFrame | None, work_orders: DataFrame | None) -> DataFrame:
    """The dashboard row: label, value, display and caption of four KPIs."""
    labels = find("metric", {m: label for m, (label, _) in CARDS.items()})
    captions = find("metric", {m: caption for m, (_, caption) in CARDS.items()})
    kpis = leadership_kpis(deals, work_orders)
    return kpis.filter(F.col("metric").isin(list(CARDS))).selectExpr(
        "metric", f"{labels} AS label", "value", "display", f"{captions} AS caption"
    )


def labelled(kpis: DataFrame) -> DataFrame:
    """KPI cards for any KPI table, titled by metric name."""
    return kpis.selectExpr("metric", f"{kpi_label('metric')} AS label", "display")
