"""All metrics of a table from one pass over it.

A cleaned table is grouped once, by every key that a metric uses (grouping sets), into a small
table of counts and totals: ``kind`` names the key, ``key`` holds its value, and the kind
``all`` is the whole table. Result frames, KPIs and report lines are then picked from its rows,
so a plan that asks for all of them scans each table once. Amounts of cleaned tables are never
negative, so totals need no filter of their own.

Frames come in one long form: ``(request, row, column, value, text)``, a cell a row, numbers in
``value`` and words in ``text``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizmetrics import config
from bizmetrics.functions import dates
from bizmetrics.functions.display import kpi_display
from bizmetrics.functions.numbers import both_totals, fine_total, large_total, percent
from bizmetrics.functions.text import literal
from bizmetrics.plans import operational
from bizmetrics.plans.pipeline import OPEN

ALL = "all"
TREND_MONTHS = 6
TOP_SECTORS = 5  # of the context summary


def _grouped(df: DataFrame, keys: dict[str, str], measures: dict[str, str], totals: dict[str, str | None]) -> DataFrame:
    """``kind, key``, the counts in ``measures`` and the exact ``totals`` (column and filter)."""
    sums = {}
    for name, (column, where) in totals.items():
        sums[f"__fine_{name}"] = fine_total(column, where)
        sums[f"__large_{name}"] = large_total(column, where)
    names = [f"__key_{k}" for k in keys]
    if not names:
        keys, names = {ALL: "CAST(NULL AS STRING)"}, ["__key_none"]
    sets = [*[[F.col(n)] for n in names], []] if ALL not in keys else [[]]
    keyed = df.withColumns({n: F.expr(e) for n, e in zip(names, keys.values(), strict=True)})
    aggregates = [F.expr(f"{e} AS {n}") for n, e in {**measures, **sums}.items()]
    # A key's bit is 0 where rows are grouped by it; the first key has the highest bit.
    grouped = keyed.groupingSets(sets, *[F.col(n) for n in names]).agg(
        F.grouping_id().alias("__id"), *aggregates
    )
    every = (1 << len(names)) - 1
    kinds = " ".join(
        f"WHEN {every ^ 1 << len(names) - 1 - i} THEN {literal(k)}" for i, k in enumerate(keys)
    )
    key = f"coalesce({', '.join(names)})"
    found = grouped.selectExpr(
        f"CASE __id {kinds} ELSE '{ALL}' END AS kind", f"{key} AS key", *measures, *sums
    )
    # An empty table has no groups at all: its totals are zero nevertheless.
    kind = {f.name: f.dataType.simpleString() for f in found.schema}
    zero = found.sparkSession.range(1).selectExpr(
        f"'{ALL}' AS kind", "CAST(NULL AS STRING) AS key",
        *[f"CAST(0 AS {kind[n]}) AS {n}" for n in measures],
        *[f"CAST(NULL AS {kind[n]}) AS {n}" for n in sums],
    )
    whole = found.unionByName(zero).groupBy("kind", "key").agg(
        *[F.sum(n).alias(n) for n in (*measures, *sums)]
    )
    return whole.selectExpr(
        "kind", "key", *measures,
        *[f"coalesce({both_totals(f'__fine_{n}', f'__large_{n}')}, 0D) AS {n}" for n in totals],
    )


def deal_cube(deals: DataFrame, status: str = OPEN) -> DataFrame:
    """Counts and totals of deals by sector, stage, status and created month. ``picked`` are
    deals of ``status`` with a value, ``valued`` all with a value."""
    keys = {c: c for c in ("sector", "deal_stage", "deal_status") if c in deals.columns}
    if "created_date" in deals.columns:
        keys["month"] = dates.month_label("created_date")
    picked = f"deal_status = {literal(status)}"
    stage = f"deal_status = '{OPEN}' AND deal_stage = {literal(config.NEGOTIATION_STAGE)}"
    return _grouped(
        deals, keys,
        {
            "records": "count(*)", "open": f"count_if(deal_status = '{OPEN}')",
            "picked": f"count_if(deal_value > 0 AND {picked})", "valued": "count_if(deal_value > 0)",
            "negotiating": f"count_if({stage})",
        },
        {"picked_value": ("deal_value", picked), "value": ("deal_value", None)},
    )


def order_cube(work_orders: DataFrame) -> DataFrame:
    """Counts and totals of work orders by sector, execution status, type and billing status."""
    keys = {
        c: c for c in ("sector", "execution_status", "nature_of_work", "billing_status")
        if c in work_orders.columns
    }
    amounts = {
        "amount": "amount_total", "billed": "billed_value", "collected": "collected_amount",
        "receivable": "amount_receivable", "to_be_billed": "amount_to_be_billed",
    }
    return _grouped(
        work_orders, keys,
        {
            "records": "count(*)", "owing": "count_if(amount_receivable > 0)",
            "active": operational.active_orders(work_orders.columns),
        },
        {
            **{name: (column, None) for name, column in amounts.items()},
            "done": ("billed_value", "amount_total > 0"),
            "not_done": ("amount_to_be_billed", "amount_total > 0"),
        },
    )


@dataclass(frozen=True)
class Frame:
    """A result frame: which rows of a cube it has, in which order, and their columns.

    ``first`` orders by a number, largest first; the key breaks ties. ``last`` keeps so many
    keys from the end, in ascending order.
    """

    kind: str
    where: str
    columns: tuple[tuple[str, str], ...]
    first: str = "0D"
    last: int | None = None


_KNOWN = f"key <> {literal(config.UNKNOWN)}"
DEAL_FRAMES = {
    "pipeline_by_sector": Frame(
        "sector", "picked > 0",
        (("sector", "key"), ("deal_count", "picked"), ("total_value", "picked_value"),
         ("avg_value", "picked_value / picked")),
        "picked_value",
    ),
    "pipeline_by_stage": Frame(
        "deal_stage", "picked > 0",
        (("deal_stage", "key"), ("deal_count", "picked"), ("total_value", "picked_value")),
        "picked_value",
    ),
    "deal_trends": Frame(
        "month", "key IS NOT NULL", (("month", "key"), ("deal_count", "records")), last=TREND_MONTHS
    ),
}
DEAL_FRAMES["pipeline_value"] = DEAL_FRAMES["pipeline_by_sector"]
ORDER_FRAMES = {
    "work_orders_by_sector": Frame(
        "sector", "true", (("sector", "key"), ("order_count", "records"), ("total_value", "amount")), "records"
    ),
    "execution_status": Frame(
        "execution_status", _KNOWN, (("execution_status", "key"), ("count", "records")), "records"
    ),
    "receivables": Frame(
        "sector", "owing > 0", (("sector", "key"), ("receivable_amount", "receivable"), ("wo_count", "owing")),
        "receivable",
    ),
    "billing_vs_collection": Frame(
        "sector", _KNOWN,
        (("sector", "key"), ("billed", "billed"), ("collected", "collected"), ("receivable", "receivable"),
         ("to_be_billed", "to_be_billed")),
        "billed",
    ),
    "work_orders_by_type": Frame(
        "nature_of_work", _KNOWN, (("nature_of_work", "key"), ("count", "records"), ("total_value", "amount")),
        "records",
    ),
    "work_orders_by_status": Frame(
        "billing_status", f"{_KNOWN} AND key <> ''", (("billing_status", "key"), ("count", "records")), "records"
    ),
}
# request -> metric -> (unit, SQL over the row of the whole table)
_PIPELINE = {"total_pipeline": ("money", "picked_value")}
_AVERAGE = "CASE WHEN valued > 0 THEN value / valued ELSE 0D END"
_COMPLETION = percent("done", "amount")
_COLLECTION = percent("collected", "billed")
DEAL_KPIS = {
    "pipeline_value": _PIPELINE,
    "pipeline_by_sector": _PIPELINE,
    "average_deal_size": {"average_deal_size": ("money", _AVERAGE)},
    "active_deals": {"active_deals": ("count", "open")},
    "leadership_update": {
        "total_pipeline": ("money", "picked_value"), "active_deals": ("count", "open"),
        "avg_deal_size": ("money", _AVERAGE), "top_sector": ("text", "top_sector"),
        "top_sector_value": ("money", "top_sector_value"), "deals_in_negotiation": ("count", "negotiating"),
    },
}
ORDER_KPIS = {
    "billing_completion_rate": {
        "total_amount": ("money", "amount"), "billed_amount": ("money", "done"),
        "unbilled_amount": ("money", "not_done"), "completion_rate": ("percent", _COMPLETION),
    },
    "total_billed": {"total_billed": ("money", "billed")},
    "total_collected": {"total_collected": ("money", "collected")},
    "receivables": {"total_receivable": ("money", "receivable")},
    "financial_summary": {
        "total_billed": ("money", "billed"), "total_collected": ("money", "collected"),
        "total_receivable": ("money", "receivable"), "collection_rate": ("percent", _COLLECTION),
        "outstanding_ratio": ("percent", percent("receivable", "billed")),
    },
    "leadership_update": {
        "active_work_orders": ("count", "active"), "billing_completion": ("percent", _COMPLETION),
        "total_receivable": ("money", "receivable"), "total_billed": ("money", "billed"),
        "total_collected": ("money", "collected"), "collection_rate": ("percent", _COLLECTION),
    },
}


def ranked(cube: DataFrame, frames: dict[str, Frame]) -> DataFrame:
    """The cube's rows with the ``request`` they belong to and their ``row``, from 1.

    A request has as many rows as its key has values: a window over them gathers those of
    one request, not of all.
    """
    arms = ", ".join(
        f"CASE WHEN kind = {literal(f.kind)} AND ({f.where}) THEN named_struct('request', {literal(name)}, "
        f"'first', CAST({f.first} AS DOUBLE), 'last', CAST({f.last or 'NULL'} AS INT)) END"
        for name, f in frames.items()
    )
    rows = cube.selectExpr("*", f"explode(filter(array({arms}), f -> f IS NOT NULL)) AS frame")
    from_start = Window.partitionBy("frame.request").orderBy(F.desc("frame.first"), "key")
    from_end = Window.partitionBy("frame.request").orderBy(F.desc("key"))
    limited = (
        rows.withColumn("__end", F.row_number().over(from_end))
        .filter("frame.last IS NULL OR __end <= frame.last").drop("__end")
    )
    return limited.withColumn("row", F.row_number().over(from_start)).withColumn("request", F.col("frame.request")).drop("frame")


def cells(rows: DataFrame, frames: dict[str, Frame]) -> DataFrame:
    """Ranked rows in the long form."""
    def cell(name: str, expr: str) -> str:
        text = expr == "key"
        return (
            f"named_struct('column', {literal(name)}, "
            f"'value', CAST({'NULL' if text else expr} AS DOUBLE), "
            f"'text', CAST({'key' if text else 'NULL'} AS STRING))"
        )

    arms = " ".join(
        f"WHEN {literal(name)} THEN array({', '.join(cell(n, e) for n, e in f.columns)})"
        for name, f in frames.items()
    )
    return rows.selectExpr("request", "row", f"inline(CASE request {arms} END)")


def data_frames(
    deals: DataFrame | None, work_orders: DataFrame | None, status: str = OPEN
) -> DataFrame:
    """The aggregated data frames of all requests, in the long form."""
    parts = []
    if deals is not None:
        parts.append(cells(ranked(deal_cube(deals, status), DEAL_FRAMES), DEAL_FRAMES))
    if work_orders is not None:
        parts.append(cells(ranked(order_cube(work_orders), ORDER_FRAMES), ORDER_FRAMES))
    return reduce(DataFrame.unionByName, parts)


def _whole(cube: DataFrame) -> DataFrame:
    """The row of the whole table. For deals it also has the top sector, so that the cube is
    used once; without open value there is none."""
    names = [c for c in cube.columns if c not in ("kind", "key")]
    best = {}
    if "picked" in names:
        top = "kind = 'sector' AND picked > 0"
        best = {
            "top_sector": f"min_by(key, CASE WHEN {top} THEN struct(-picked_value, key) END)",
            "top_sector_value": f"max(picked_value) FILTER (WHERE {top})",
        }
    whole = {n: f"max({n}) FILTER (WHERE kind = '{ALL}')" for n in names}
    return cube.agg(*[F.expr(e).alias(n) for n, e in {**whole, **best}.items()])


def _kpi_rows(cube: DataFrame, kpis: dict[str, dict[str, tuple[str, str]]]) -> DataFrame:
    def row(request: str, metric: str, unit: str, expr: str) -> str:
        value, text = ("NULL", expr) if unit == "text" else (expr, "NULL")
        return (
            f"named_struct('request', {literal(request)}, 'metric', {literal(metric)}, "
            f"'value', CAST({value} AS DOUBLE), 'unit', {literal(unit)}, 'text', CAST({text} AS STRING))"
        )

    rows = ", ".join(row(r, m, *of) for r, metrics in kpis.items() for m, of in metrics.items())
    return _whole(cube).selectExpr(f"inline(array({rows}))")


def kpi_frames(
    deals: DataFrame | None, work_orders: DataFrame | None, status: str = OPEN
) -> DataFrame:
    """The KPIs of all requests: ``(request, metric, value, unit, display)``."""
    parts = []
    if deals is not None:
        parts.append(_kpi_rows(deal_cube(deals, status), DEAL_KPIS))
    if work_orders is not None:
        parts.append(_kpi_rows(order_cube(work_orders), ORDER_KPIS))
    return reduce(DataFrame.unionByName, parts).selectExpr(
        "request", "metric", "value", "unit", f"coalesce(text, {kpi_display('value', 'unit')}) AS display"
    ).filter("display IS NOT NULL")


def summary_rows(deals: DataFrame | None, work_orders: DataFrame | None) -> DataFrame:
    """What is loaded, as ``(section, item, value, count)``: row counts, the five largest
    sectors, all deal statuses."""
    parts = []
    if deals is not None:
        per_kind = Window.partitionBy("kind").orderBy(F.desc("records"), "key")
        counted = (
            deal_cube(deals)
            .filter(f"kind = '{ALL}' OR (kind IN ('sector', 'deal_status') AND key IS NOT NULL)")
            .withColumn("row", F.row_number().over(per_kind))
            .filter(f"kind <> 'sector' OR row <= {TOP_SECTORS}")
        )
        parts.append(
            counted.selectExpr(
                f"CASE kind WHEN '{ALL}' THEN 1 WHEN 'sector' THEN 2 ELSE 3 END AS section",
                f"CASE kind WHEN '{ALL}' THEN 'Deals dataset' WHEN 'sector' THEN 'Top sectors' "
                "ELSE 'Status distribution' END AS item",
                "key AS value", "records AS count",
            )
        )
    if work_orders is not None:
        parts.append(
            work_orders.selectExpr(
                "4 AS section", "'Work orders dataset' AS item", "CAST(NULL AS STRING) AS value", "count(*) AS count"
            )
        )
    return reduce(DataFrame.unionByName, parts).orderBy("section", F.desc("count"), "value")
