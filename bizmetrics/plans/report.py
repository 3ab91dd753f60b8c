"""Report texts as rows ``(section, pos, line)``, ordered by section and position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizmetrics import config
from bizmetrics.functions.display import format_currency, kpi_display
from bizmetrics.functions.text import literal
from bizmetrics.operators.filters import quoted
from bizmetrics.plans import catalogue

EDGE_ROWS = 10
MAX_ROWS = 2 * EDGE_ROWS

SECTIONS = [
    "Weekly Sales & Delivery Update",
    "Pipeline Overview",
    "Operational Highlights",
    "Financial Highlights",
    "Risks & Attention Items",
]
# metric -> (section number, position, caption)
LEADERSHIP_LINES = {
    "total_pipeline": (1, 1, "Total pipeline value"),
    "top_sector": (1, 2, "Top sector"),
    "active_deals": (1, 3, "Active deals"),
    "avg_deal_size": (1, 4, "Average deal size"),
    "active_work_orders": (2, 1, "Active work orders"),
    "billing_completion": (2, 2, "Billing completion rate"),
    "total_billed": (3, 1, "Total billed"),
    "total_collected": (3, 2, "Total collected"),
    "total_receivable": (3, 3, "Outstanding receivables"),
    "collection_rate": (3, 4, "Collection rate"),
    "deals_in_negotiation": (4, 1, "Deals in negotiation"),
}
_LIST_START = 100


def _headings(spark: SparkSession) -> DataFrame:
    """Title and section headings."""
    rows = ", ".join(
        f"named_struct('section', {i}, 'pos', 0, 'line', "
        f"{literal(('### ' if i else '## ') + title)})"
        for i, title in enumerate(SECTIONS)
    )
    return spark.range(1).selectExpr(f"inline(array({rows}))")


def _lines(
    cube: DataFrame, kpis: dict[str, tuple[str, str]], kind: str, where: str, first: str,
    section: int, text: str, limit: int | None = None,
) -> DataFrame:
    """KPI lines from the cube's row of the whole table and list lines from those of ``kind``,
    in one use of the cube. The first of the list is the top sector, where there is a line
    for that."""
    per_kind = Window.partitionBy("kind").orderBy(F.desc(first), "key")
    rows = (
        cube.filter(f"kind = '{catalogue.ALL}' OR (kind = {literal(kind)} AND ({where}))")
        .withColumn("__rank", F.row_number().over(per_kind))
    )

    def line(place: tuple[int, int, str], display: str) -> str:
        at, pos, caption = place
        return f"named_struct('section', {at}, 'pos', {pos}, 'line', concat('- ', {literal(caption)}, ': ', {display}))"

    whole = [
        line(LEADERSHIP_LINES[m], kpi_display(f"CAST({value} AS DOUBLE)", literal(unit)))
        for m, (unit, value) in kpis.items()
        if m in LEADERSHIP_LINES and unit != "text"
    ]
    listed = [
        f"CASE WHEN {f'__rank <= {limit}' if limit is not None else 'true'} THEN "
        f"named_struct('section', {section}, 'pos', __rank + {_LIST_START}, 'line', {text}) END"
    ]
    if "top_sector" in kpis:
        listed.append(f"CASE WHEN __rank = 1 THEN {line(LEADERSHIP_LINES['top_sector'], 'key')} END")
    return rows.selectExpr(
        f"inline(CASE kind WHEN '{catalogue.ALL}' THEN array({', '.join(whole)}) "
        f"ELSE filter(array({', '.join(listed)}), l -> l IS NOT NULL) END)"
    )


def leadership_report(
    deals: DataFrame | None, work_orders: DataFrame | None, sectors: int | None = None
) -> DataFrame:
    """Markdown lines: four sections of KPIs, the sectors (the largest ``sectors`` of them,
    if given) and all execution statuses. Each table is read once."""
    spark = (deals if deals is not None else work_orders).sparkSession
    parts = [_headings(spark)]
    if deals is not None:
        parts.append(
            _lines(
                catalogue.deal_cube(deals), catalogue.DEAL_KPIS["leadership_update"],
                "sector", "picked > 0", "picked_value", 1,
                f"concat('  - ', key, ': ', {format_currency('picked_value')})", sectors,
            )
        )
    if work_orders is not None:
        parts.append(
            _lines(
                catalogue.order_cube(work_orders), catalogue.ORDER_KPIS["leadership_update"],
                "execution_status", f"key <> {literal(config.UNKNOWN)}", "records", 2,
                "concat('  - ', key, ': ', CAST(records AS STRING))",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def context_summary(deals: DataFrame | None, work_orders: DataFrame | None) -> DataFrame:
    """What is loaded: row counts, the five largest sectors, all deal statuses. Each table
    is read once."""
    return catalogue.summary_rows(deals, work_orders)


def data_lines(
    data: DataFrame, order_by: list[tuple[str, bool]] | None = None, section: int = 2
) -> DataFrame:
    """A frame as lines ``(section, pos, line)``: a heading, the column names, then all rows
    of up to ``MAX_ROWS``, else the first and the last ``EDGE_ROWS`` around a line of dots.
    A frame without rows has no lines.

    Both ends are bounded top-k's: every task keeps its best rows of each, and only these
    are merged, so a frame of any size gives its lines without being sorted or collected.
    ``order_by`` names columns and whether they descend (default: all, ascending).
    """
    names = data.columns
    order = order_by or [(c, False) for c in names]
    text = F.concat_ws(" | ", *[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in names])

    def end(name: str, rows: int) -> DataFrame:
        by = [
            F.col(quoted(c)).desc_nulls_last() if down == (name == "first") else F.col(quoted(c)).asc_nulls_first()
            for c, down in order
        ]
        # numbered among its own few rows
        return data.orderBy(*by).limit(rows).select(
            text.alias("line"), F.row_number().over(Window.orderBy(*by)).alias("at"), F.lit(name).alias("side")
        )

    # One row more than fits tells whether anything is left out.
    both = end("first", MAX_ROWS + 1).unionByName(end("last", EDGE_ROWS))
    shown = both.withColumn("all", F.count_if(F.col("side") == "first").over(Window.partitionBy())).filter(
        f"CASE side WHEN 'first' THEN all <= {MAX_ROWS} OR at <= {EDGE_ROWS} ELSE all > {MAX_ROWS} END"
    )
    # Lines of a row: what stands before the first one, the row, the dots behind the tenth.
    columns = literal(" | ".join(names))
    return shown.selectExpr(
        f"{section} AS section",
        "inline(concat("
        "CASE WHEN side = 'first' AND at = 1 THEN array(named_struct('pos', 0, 'line', 'Data Breakdown:'), "
        f"named_struct('pos', 1, 'line', {columns})) ELSE array() END, "
        f"array(named_struct('pos', CASE side WHEN 'first' THEN at + 1 ELSE {MAX_ROWS + 3} - at END, 'line', line)), "
        f"CASE WHEN side = 'first' AND at = {EDGE_ROWS} AND all > {MAX_ROWS} "
        f"THEN array(named_struct('pos', {EDGE_ROWS + 2}, 'line', '...')) ELSE array() END))",
    )


def data_summary(result, order_by: list[tuple[str, bool]] | None = None) -> DataFrame | None:
    """A metric result as lines ``(section, pos, line)``: KPIs in their order, the data's
    first and last rows, notes. A result with nothing in it has one line; without frames
    it is None."""
    frames = [f for f in (result.kpis, result.data) if f is not None]
    if not frames:
        return None
    parts = []
    if result.kpis is not None:
        # a result has a handful of KPIs
        at = F.row_number().over(Window.orderBy("__at"))
        kpis = result.kpis.withColumn("__at", F.monotonically_increasing_id()).withColumn("pos", at)
        parts.append(
            kpis.selectExpr(
                "1 AS section",
                "inline(concat(CASE WHEN pos = 1 THEN array(named_struct('pos', 0, 'line', 'Key Metrics:')) "
                "ELSE array() END, array(named_struct('pos', pos, 'line', concat('  - ', metric, ': ', display)))))",
            )
        )
    if result.data is not None:
        parts.append(data_lines(result.data, order_by or result.order))
    if result.warnings:
        notes = ["Data Quality Notes:", *[f"  ! {w}" for w in result.warnings]]
        rows = ", ".join(f"named_struct('pos', {i}, 'line', {literal(n)})" for i, n in enumerate(notes))
        parts.append(frames[0].sparkSession.range(1).selectExpr("3 AS section", f"inline(array({rows}))"))
    lines = reduce(DataFrame.unionByName, parts)
    if result.kpis is not None or result.warnings:
        return lines
    # The line that says so stands first and alone.
    nothing = frames[0].sparkSession.range(1).selectExpr(
        "0 AS section", "0 AS pos", "'No data available.' AS line"
    )
    only = Window.partitionBy()
    return (
        lines.unionByName(nothing).withColumn("__last", F.max("section").over(only))
        .filter("section > 0 OR __last = 0").drop("__last")
    )


def summary_lines(result) -> list[str]:
    """The lines of `data_summary`, for a terminal: at most some dozens reach the driver."""
    frame = data_summary(result)
    if frame is None:
        notes = [f"  ! {w}" for w in result.warnings]
        return ["", "Data Quality Notes:", *notes] if notes else ["No data available."]
    out: list[str] = []
    for row in frame.orderBy("section", "pos").collect():
        if row["pos"] == 0 and row["section"] > 1:
            out.append("")
        out.append(row["line"])
    return out
