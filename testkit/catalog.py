"""The registered queries: name -> (spark, sf_dir) -> DataFrame, whole tables each."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizmetrics import config
from bizmetrics.functions import dates, display, normalize, numbers, text
from bizmetrics.operators import cleaning, dedupe, filters, quality, schema
from bizmetrics.plans import (
    catalogue,
    financial,
    leadership,
    operational,
    pipeline,
    questions,
    registry,
    report,
)
from bizmetrics.session import configure, shared_folder
from bizmetrics.sources import board, csv, load, positions
from bizmetrics.sources.cache import Cache
from testkit import landing
from testkit import raw_tables as raw

AS_OF = dt.date(2001, 5, 15)
QUARTER_SECTOR = "Renewables"

Query = Callable[[SparkSession, str], DataFrame]


def clean_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_deals(landing.raw_deals(spark, sf_dir), raw.DEAL_ORDER)


def clean_work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_work_orders(
        landing.raw_work_orders(spark, sf_dir), raw.WORK_ORDER_ORDER
    )


def _deals(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(clean_deals(spark, sf_dir))


def _orders(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(clean_work_orders(spark, sf_dir))


def _both(plan: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(
        clean_deals(spark, sf_dir), clean_work_orders(spark, sf_dir)
    )


def _cells(column: str, expr: Callable[[str], str], stripped: bool = False) -> Query:
    """One scalar function over a column of raw spellings: id, raw cell, result."""

    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        cell = text.strip(column) if stripped else column
        return (
            raw.for_spark(spark, sf_dir, "cells")
            .selectExpr("id", column, f"{cell} AS cell")
            .selectExpr("id", column, f"{expr('cell')} AS result")
        )

    return plan


# --- sources ------------------------------------------------------------------------


def _read_deals_csv(spark, sf_dir):
    table = csv.read_deals_csv(spark, landing.deals_csv(spark, sf_dir))
    return schema.canonical_deals(table.drop(*csv.POSITION))


def _read_work_orders_csv(spark, sf_dir):
    table = csv.read_work_orders_csv(spark, landing.work_orders_csv(spark, sf_dir))
    return schema.canonical_work_orders(table.drop(*csv.POSITION))


def _load_status(spark, sf_dir):
    return load.loaded_rows(
        load.load(
            spark,
            deals_csv=["/nonexistent/deals.csv", landing.deals_csv(spark, sf_dir)],
            work_orders_csv=landing.work_orders_csv(spark, sf_dir),
        )
    )


def _load_board(spark, sf_dir):
    """Deals from board pages; work orders from CSV, as their board can't be read."""
    return load.loaded_rows(
        load.load(
            spark,
            deals_pages=landing.board_export(spark, sf_dir),
            work_orders_pages="/nonexistent/pages",
            work_orders_csv=landing.work_orders_csv(spark, sf_dir),
        )
    )


def _cached_metrics(spark, sf_dir):
    """A table that is loaded twice through the cache, and metrics of what the pointer names:
    the second load finds the version of the first and reads no source."""
    folder = f"{shared_folder(spark)}/bizmetrics-cache"
    sources = {
        "deals_csv": landing.deals_csv(spark, sf_dir),
        "work_orders_csv": landing.work_orders_csv(spark, sf_dir),
    }
    load.load(spark, **sources, cache=folder)
    second = load.load(spark, **sources, cache=folder)
    cache = Cache(spark, folder)
    kpis = catalogue.kpi_frames(second.deals.clean, second.work_orders.clean)
    found = second.findings().select(
        F.lit("findings").alias("request"), F.concat_ws(".", "table", "rule").alias("metric"),
        F.col("affected").cast("double").alias("value"), F.lit("count").alias("unit"), F.col("message").alias("display"),
    ).filter("metric not like 'load.%'")
    reread = F.lit(float(sum(t.raw is not None for t in (second.deals, second.work_orders))))
    rows = cache.current("deals").agg(F.count(F.lit(1)).cast("double").alias("value"))
    notes = rows.select(
        F.lit("cache").alias("request"), F.lit("deals").alias("metric"), "value", F.lit("rows").alias("unit"),
        F.concat(reread.cast("int"), F.lit(" sources read again")).alias("display"),
    )
    return kpis.unionByName(found).unionByName(notes)


def _clean_deals_csv(spark, sf_dir):
    """Twelve unpadded folders of CSV files, cleaned by the reader's own positions."""
    table = csv.read_deals_csv(spark, landing.deals_export(spark, sf_dir))
    table = positions.numbered(table, csv.POSITION)
    return cleaning.clean_deals(table, [positions.NAME], keep_order=True)


def _clean_deals_board(spark, sf_dir):
    table = board.read_board(spark, landing.board_export(spark, sf_dir))
    table = positions.numbered(table, board.ITEM_POSITION)
    return cleaning.clean_deals(table, [positions.NAME], keep_order=True)


def _board_items(spark, sf_dir):
    path = landing.board_pages(spark, sf_dir)
    return board.page_items(board.land_pages(spark, path))


def _board_pages_items(spark, sf_dir):
    return _board_items(spark, sf_dir).select(
        "id", "name", F.size("column_values").alias("cells")
    )


def _board_items_wide(spark, sf_dir):
    return board.items_wide(_board_items(spark, sf_dir)).drop(*board.ITEM_POSITION)


def _landing_errors(spark, sf_dir):
    responses = raw.for_spark(spark, sf_dir, "responses")
    return board.landing_errors(board.parse_pages(responses, "response", ["event_id"]))


def _catalogue(spark, sf_dir):
    pages = board.parse_pages(
        landing.catalogue_pages(spark, sf_dir), "response", ["page"]
    )
    return board.boards(pages)


def _board_columns(spark, sf_dir):
    return board.board_columns(_catalogue(spark, sf_dir))


def _find_board(spark, sf_dir):
    found = board.find_board(_catalogue(spark, sf_dir), "work ORDERS", ["page"])
    return found.select("id", "name", F.size("columns").alias("n_columns"))


# --- cleaning steps -----------------------------------------------------------------


def _canonical_raw_deals(spark, sf_dir):
    return schema.canonical_deals(landing.raw_deals(spark, sf_dir))


def _canonical_raw_orders(spark, sf_dir):
    return schema.canonical_work_orders(landing.raw_work_orders(spark, sf_dir))


def _drop_empty_rows(spark, sf_dir):
    return filters.drop_empty_rows(
        _canonical_raw_deals(spark, sf_dir), list(config.DEAL_HEADERS)
    )


def _drop_header_rows(spark, sf_dir):
    return filters.drop_header_rows(_canonical_raw_deals(spark, sf_dir))


def _drop_blank_names(spark, sf_dir):
    return filters.drop_blank_names(_canonical_raw_deals(spark, sf_dir))


def _dedupe_deals(spark, sf_dir):
    return dedupe.keep_first(
        _canonical_raw_deals(spark, sf_dir), config.DEAL_KEYS, raw.DEAL_ORDER
    )


def _dedupe_work_orders(spark, sf_dir):
    return cleaning.distinct_work_orders(
        landing.raw_work_orders(spark, sf_dir), raw.WORK_ORDER_ORDER
    )


def _dedupe_full_row(spark, sf_dir):
    table = _canonical_raw_orders(spark, sf_dir).drop(*raw.WORK_ORDER_ORDER)
    return dedupe.drop_full_duplicates(table)


def _enforce_types(spark, sf_dir):
    cells = raw.for_spark(spark, sf_dir, "cells").select("id", "amount_cell")
    return cleaning.enforce_types(
        cells.withColumn("result", F.col("amount_cell")), ["result"]
    )


def _clamp_negative(spark, sf_dir):
    return raw.for_spark(spark, sf_dir, "cells").selectExpr(
        "id", f"{numbers.clamp(numbers.money('amount_cell'))} AS result"
    )


def _format_currency(spark, sf_dir):
    """Order values over the whole range of magnitudes, both signs."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey",
        "o_totalprice * element_at(array(1D, -1D, 100D, 0.001D, -0.01D), "
        "CAST(o_orderkey % 5 + 1 AS INT)) AS v",
    )
    return orders.selectExpr("o_orderkey", f"{display.format_currency('v')} AS result")


# --- quality ------------------------------------------------------------------------


def _dq_deals(spark, sf_dir):
    return quality.deals_quality(landing.raw_deals(spark, sf_dir), raw.DEAL_ORDER)


def _dq_work_orders(spark, sf_dir):
    return quality.work_orders_quality(
        landing.raw_work_orders(spark, sf_dir), raw.WORK_ORDER_ORDER
    )


def _dq_all(spark, sf_dir):
    """Findings of both tables and the warnings of a load whose board can't be read."""
    result = load.load(spark, deals_pages="/nonexistent/pages")
    deals = landing.raw_deals(spark, sf_dir)
    orders = landing.raw_work_orders(spark, sf_dir)
    result.deals = load.Table(
        deals, raw.DEAL_ORDER, cleaning.clean_deals(deals, raw.DEAL_ORDER)
    )
    result.work_orders = load.Table(
        orders, raw.WORK_ORDER_ORDER, cleaning.clean_work_orders(orders, raw.WORK_ORDER_ORDER)
    )
    return result.findings()


def _deal_value_outliers(spark, sf_dir):
    """Order values with every 997th raised far above the bound."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    factor = F.when(F.col("o_orderkey") % 997 == 0, 50.0).otherwise(1.0)
    deals = orders.select(
        F.col("o_orderkey"), (F.col("o_totalprice") * factor).alias("deal_value")
    )
    return quality.high_outliers(deals)


def _receivable_mismatch(orders: DataFrame) -> DataFrame:
    return orders.filter(quality.receivable_mismatch()).select(
        "serial", "billed_value", "collected_amount", "amount_receivable"
    )


# --- requests and reports -----------------------------------------------------------


def _closing_soon(spark, sf_dir):
    """The one request with a period and a sector: by month only if that is asked for, and
    then in all sectors; else by quarter, in the sector if one is given."""
    deals = cleaning.clean_deals(landing.raw_deals(spark, sf_dir), raw.DEAL_ORDER, keep_order=True)
    variants = {
        "month": {"period": "current_month", "sector": QUARTER_SECTOR},
        "quarter": {"period": "current_quarter"},
        "quarter, sector": {"period": "all_time", "sector": QUARTER_SECTOR},
    }
    parts = [
        registry.run_metric("deals_closing_soon", deals, as_of=AS_OF, **how)
        .data.select(F.lit(name).alias("variant"), *pipeline.CLOSING_COLUMNS)
        for name, how in variants.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _data_summary(spark, sf_dir):
    """Orders counted by remainder: frames of 19, 20, 21 and some hundred rows, the largest
    counts first, beside KPIs and a note."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    parts = []
    for rows in (19, 20, 21, 977):
        counts = orders.groupBy((F.col("o_orderkey") % rows).alias("rest")).agg(F.count(F.lit(1)).alias("orders"))
        kpis = leadership.to_long(
            orders.selectExpr("count(*) AS orders", f"{rows}.5D AS share"), {"orders": "count", "share": "percent"}
        )
        result = registry.MetricResult(
            data=counts, kpis=kpis, warnings=["Made of remainders."] if rows == 20 else [],
            order=[("orders", True), ("rest", False)],
        )
        parts.append(report.data_summary(result).select(F.lit(f"by {rows}").alias("request"), "*"))
    nothing = registry.MetricResult(data=orders.filter("o_orderkey < 0").select("o_orderkey"))
    parts.append(report.data_summary(nothing).select(F.lit("none").alias("request"), "*"))
    return reduce(DataFrame.unionByName, parts)


def _typed_dates(spark, sf_dir):
    """Typed columns lose their time of day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cells = events.select("event_id", F.col("ts").cast("timestamp_ntz").alias("stamp"), F.to_date("ts").alias("day"))
    kinds = {f.name: f.dataType for f in cells.schema}
    return cells.selectExpr(
        "event_id", *[f"{dates.parse_date(c, kinds[c])} AS {c}" for c in ("stamp", "day")]
    )


def _interpret(spark, sf_dir):
    """Users' turns as questions with what a model replied to them."""
    asked = raw.for_spark(spark, sf_dir, "questions").withColumnRenamed("text", "question")
    replies = raw.for_spark(spark, sf_dir, "replies").withColumnRenamed("text", "reply")
    found = questions.interpret(asked.join(replies, ["conv_id", "turn"]))
    return found.withColumn("suggestions", F.array_join("suggestions", "|"))


def _unknown_metric(deals: DataFrame, orders: DataFrame) -> DataFrame:
    return registry.run_metric("no such metric", deals, orders, AS_OF).data


def queries() -> dict[str, Query]:
    def configured(plan: Query) -> Query:
        return lambda spark, sf_dir: plan(configure(spark), sf_dir)

    return {name: configured(plan) for name, plan in _plans().items()}


def _plans() -> dict[str, Query]:
    return {
        # flagship
        "pipeline_by_sector": _deals(pipeline.pipeline_by_sector),
        # sources
        "read_deals_csv": _read_deals_csv,
        "read_work_orders_csv": _read_work_orders_csv,
        "null_tokens": _cells("null_cell", text.null_tokens),
        "board_items_wide": _board_items_wide,
        "board_pages_items": _board_pages_items,
        "landing_errors": _landing_errors,
        "board_columns": _board_columns,
        "find_board": _find_board,
        "load_status": _load_status,
        "load_board": _load_board,
        "cached_metrics": _cached_metrics,
        "clean_deals_csv": _clean_deals_csv,
        "clean_deals_board": _clean_deals_board,
        # schema
        "canonical_deals": _canonical_raw_deals,
        "canonical_work_orders": _canonical_raw_orders,
        "enforce_types": _enforce_types,
        # filters
        "drop_empty_rows": _drop_empty_rows,
        "drop_header_rows": _drop_header_rows,
        "drop_blank_names": _drop_blank_names,
        "flag_gibberish": lambda spark, sf_dir: questions.flag_gibberish(
            raw.for_spark(spark, sf_dir, "questions")
        ).withColumn("suggestions", F.array_join("suggestions", "|")),
        # scalar functions
        "strip_strings": _cells("text_cell", text.strip),
        "safe_float": _cells("amount_cell", numbers.money),
        "parse_dates": _cells("date_cell", dates.parse_date, stripped=True),
        "typed_dates": _typed_dates,
        "interpret_questions": _interpret,
        "normalize_sector": _cells("sector_cell", normalize.sector, stripped=True),
        "normalize_status": _cells("status_cell", normalize.deal_status, stripped=True),
        "normalize_probability": _cells("probability_cell", normalize.probability, stripped=True),
        "normalize_execution": _cells("execution_cell", normalize.execution_status, stripped=True),
        "fill_categoricals": _cells("text_cell", text.fill_categorical),
        "clamp_negative": _clamp_negative,
        "format_currency": _format_currency,
        "extract_intent": lambda spark, sf_dir: questions.extract_intent(
            raw.for_spark(spark, sf_dir, "replies")
        ),
        # duplicates
        "dedupe_deals": _dedupe_deals,
        "dedupe_work_orders": _dedupe_work_orders,
        "dedupe_full_row": _dedupe_full_row,
        # cleaned tables
        "clean_deals": clean_deals,
        "clean_work_orders": clean_work_orders,
        # pipeline metrics
        "pipeline_by_stage": _deals(pipeline.pipeline_by_stage),
        "average_deal_size": _deals(pipeline.average_deal_size),
        "total_pipeline_value": _deals(pipeline.total_pipeline_value),
        "active_deals": _deals(pipeline.active_deals),
        "closing_this_month": lambda spark, sf_dir: pipeline.closing_this_month(
            cleaning.clean_deals(landing.raw_deals(spark, sf_dir), raw.DEAL_ORDER, keep_order=True),
            AS_OF,
            raw.DEAL_ORDER,
        ),
        "closing_this_quarter": _deals(
            lambda d: pipeline.closing_this_quarter(d, AS_OF, QUARTER_SECTOR)
        ),
        "deal_creation_trend": _deals(pipeline.deal_creation_trend),
        "pipeline_stage_quarter": _deals(
            lambda d: pipeline.pipeline_stage_quarter(d, AS_OF)
        ),
        "deals_in_negotiation": _deals(pipeline.deals_in_negotiation),
        "top_sector": _deals(pipeline.top_sector),
        "top_sectors": _deals(pipeline.top_sectors),
        "status_distribution": _deals(pipeline.status_distribution),
        # operational metrics
        "work_orders_by_sector": _orders(operational.work_orders_by_sector),
        "billing_completion": _orders(operational.billing_completion),
        "execution_status": _orders(operational.execution_status),
        "execution_status_share": _orders(operational.execution_status_share),
        "active_work_orders": _orders(operational.active_work_orders),
        "work_orders_by_type": _orders(operational.work_orders_by_type),
        "work_orders_by_status": _orders(operational.work_orders_by_status),
        # financial metrics
        "total_billed": _orders(financial.total_billed),
        "total_collected": _orders(financial.total_collected),
        "total_receivable": _orders(financial.total_receivable),
        "collection_rate": _orders(financial.collection_rate),
        "financial_summary": _orders(financial.financial_summary),
        "billing_vs_collection": _orders(financial.billing_vs_collection),
        "billing_series_long": _orders(financial.billing_series_long),
        "receivables_by_sector": _orders(financial.receivables_by_sector),
        # quality
        "dq_deals": _dq_deals,
        "dq_work_orders": _dq_work_orders,
        "dq_all": _dq_all,
        "deal_value_outliers": _deal_value_outliers,
        "receivable_mismatch": _orders(_receivable_mismatch),
        # reports
        "leadership_kpis": _both(leadership.leadership_kpis),
        "kpi_cards": _both(leadership.kpi_cards),
        "context_summary": _both(report.context_summary),
        "report_lines": _both(report.leadership_report),
        "run_metric": _both(catalogue.kpi_frames),
        "metric_data": _both(catalogue.data_frames),
        "closing_soon": _closing_soon,
        "data_summary": _data_summary,
        "unknown_metric": _both(_unknown_metric),
    }
