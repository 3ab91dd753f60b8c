import datetime as dt

import pytest
from pyspark.sql import functions as F

from bizmetrics.operators import quality
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

AS_OF = dt.date(2024, 5, 15)


@pytest.fixture(scope="module")
def deals(spark):
    def day(*d):
        return dt.datetime(*d)

    rows = [
        ("a", "mining", "Open", 100.0, "F. Negotiations", "High", day(2024, 5, 1), day(2024, 1, 1)),
        ("b", "mining", "Open", 0.0, "I. POC", "Low", day(2024, 6, 30), day(2024, 1, 9)),
        ("c", "dsp", "Won", 1000.0, "I. POC", "Low", day(2024, 5, 2), day(2023, 12, 1)),
        (None, "dsp", "Open", 100.0, "I. POC", "Low", day(2024, 4, 1), day(2023, 6, 1)),
        ("e", "unknown", "Dead", 0.0, "x", "Low", None, None),
    ]
    return spark.createDataFrame(
        rows,
        "deal_name string, sector string, deal_status string, deal_value double, "
        "deal_stage string, closure_probability string, "
        "tentative_close_date timestamp_ntz, created_date timestamp_ntz",
    )


@pytest.fixture(scope="module")
def orders(spark):
    rows = [
        ("mining", "Survey", "Open", "Ongoing", "Billed", 100.0, 50.0, 25.0, 25.0, 50.0),
        ("mining", "unknown", "Closed", "Executed until current", "unknown", 0.0, 10.0, 0.0, 0.0, 0.0),
        ("unknown", "Survey", "Closed", "Not Started", "", 300.0, 0.0, 0.0, 5.0, 300.0),
    ]
    return spark.createDataFrame(
        rows,
        "sector string, nature_of_work string, wo_status string, execution_status string, "
        "billing_status string, amount_total double, billed_value double, "
        "collected_amount double, amount_receivable double, amount_to_be_billed double",
    )


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_by_sector_breaks_ties_by_name(deals):
    assert tuples(pipeline.pipeline_by_sector(deals)) == [
        ("dsp", 1, 100.0, 100.0), ("mining", 1, 100.0, 100.0),
    ]
    assert tuples(pipeline.pipeline_by_sector(deals, None))[0] == ("dsp", 2, 1100.0, 550.0)


def test_average_covers_all_statuses_by_default(deals):
    assert pipeline.average_deal_size(deals).first()[0] == 400.0
    assert pipeline.average_deal_size(deals, "Open").first()[0] == 100.0
    assert pipeline.average_deal_size(deals, "Lost").first()[0] == 0.0


def test_open_deals_without_value_are_active(deals):
    assert pipeline.active_deals(deals).first()[0] == 3


def test_closing_windows(deals):
    assert [r["deal_name"] for r in pipeline.closing_this_month(deals, AS_OF).collect()] == ["a"]
    quarter = pipeline.closing_this_quarter(deals, AS_OF).collect()
    assert {r["deal_name"] for r in quarter} == {"a", "b", None}
    assert pipeline.closing_this_quarter(deals, AS_OF, "DSP").count() == 1


def test_trend_takes_months_that_have_rows(deals):
    assert tuples(pipeline.deal_creation_trend(deals, 2)) == [("2023-12", 1), ("2024-01", 2)]


def test_stage_counts_named_deals_only(deals):
    assert tuples(pipeline.pipeline_stage_quarter(deals, AS_OF)) == [
        ("F. Negotiations", 1, 100.0), ("I. POC", 0, 100.0),
    ]


def test_active_orders(orders):
    # one by status, two by execution; "Executed until current" does not count
    assert operational.active_work_orders(orders).first()[0] == 2
    assert operational.active_work_orders(orders.drop("wo_status")).first()[0] == 3


def test_order_metrics(orders):
    assert tuples(operational.billing_completion(orders)) == [(400.0, 50.0, 350.0, 12.5)]
    assert tuples(operational.work_orders_by_type(orders)) == [("Survey", 2, 400.0)]
    assert tuples(operational.work_orders_by_status(orders)) == [("Billed", 1)]
    assert operational.work_orders_by_status(orders.drop("billing_status")).count() == 0
    shares = operational.execution_status_share(orders).collect()
    assert abs(sum(r["share"] for r in shares) - 1) < 1e-12


def test_financial_summary(orders):
    assert tuples(financial.financial_summary(orders)) == [(60.0, 25.0, 30.0, 41.7, 50.0)]
    assert financial.collection_rate(orders.filter("false")).first()[0] == 0.0


def test_totals_agree(deals):
    by_sector = sum(r["total_value"] for r in pipeline.pipeline_by_sector(deals).collect())
    assert by_sector == pipeline.total_pipeline_value(deals).first()[0]


def test_leadership_kpis(deals, orders):
    kpis = {r["metric"]: r["display"] for r in leadership.leadership_kpis(deals, orders).collect()}
    assert kpis["top_sector"] == "dsp" and kpis["total_pipeline"] == "₹200.00"
    assert kpis["deals_in_negotiation"] == "1" and kpis["collection_rate"] == "41.7%"
    only = leadership.leadership_kpis(None, orders)
    assert "total_pipeline" not in {r["metric"] for r in only.collect()}
    # no open deal: no top sector
    none = leadership.leadership_kpis(deals.filter("deal_status = 'Won'"), None)
    assert "top_sector" not in {r["metric"] for r in none.collect()}
    labels = {r["label"] for r in leadership.labelled(only).collect()}
    assert "Billing Completion" in labels


def test_dispatch(deals, orders):
    same = [
        tuples(registry.run_metric(n, deals, orders, AS_OF, sector="mining").data)
        for n in ("pipeline_value", "pipeline_by_sector")
    ]
    assert same[0] == same[1] and len(same[0]) == 2  # the sector is ignored

    def closing(**kw):
        return registry.run_metric("deals_closing_soon", deals, orders, AS_OF, **kw).data.count()

    assert closing(period="current_month", sector="dsp") == 1  # ignored by month
    assert closing(sector="dsp") == 1 and closing() == 3
    assert registry.run_metric("no_such", deals, orders).chart_type == "none"


def test_dispatch_without_tables(deals, orders):
    missing = registry.run_metric("leadership_update", None, orders)
    assert missing.warnings == ["Deals data not loaded."]
    assert registry.run_metric("total_billed", None, orders).warnings == []
    assert registry.run_metric("execution_status", deals).warnings == [
        "Work orders data not loaded."
    ]
    assert registry.run_metric("receivables", deals).warnings == []  # silent
    broken = registry.run_metric("pipeline_by_stage", deals.drop("deal_stage"))
    assert broken.warnings[0].startswith("Error computing analytics")


def test_summary_lines(spark, deals):
    result = registry.run_metric("pipeline_by_sector", deals, None, AS_OF)
    lines = report.summary_lines(result)
    assert lines[:2] == ["Key Metrics:", "  - total_pipeline: ₹200.00"]
    many = registry.MetricResult(data=spark.range(100).orderBy("id"))
    body = report.summary_lines(many)
    assert body[-1] == "99" and "..." in body and len(body) == 3 + 21
    assert report.summary_lines(registry.MetricResult()) == ["No data available."]


@pytest.mark.parametrize("rows", [0, 1, 10, 19, 20, 21, 500])
def test_both_ends_of_a_frame(spark, rows):
    """All lines up to twenty, else ten from each end; the order has ties and nulls."""
    cells = [(i // 3 if i % 7 else None, i) for i in range(rows)]
    data = spark.createDataFrame(cells, "a int, b int").repartition(5)
    got = [r["line"] for r in report.data_lines(data, [("a", True), ("b", False)]).orderBy("pos").collect()]
    wanted = sorted(cells, key=lambda c: (c[0] is None, -(c[0] or 0), c[1]))
    lines = [f"{'' if a is None else a} | {b}" for a, b in wanted]
    if rows > 20:
        lines = [*lines[:10], "...", *lines[-10:]]
    assert got == (["Data Breakdown:", "a | b", *lines] if rows else [])


def test_ends_are_bounded_per_task(spark):
    plan = report.data_lines(spark.range(1000)).sort("pos")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 2


def test_catalogue_equals_the_single_metrics(spark, deals, orders):
    """Frames picked from the cubes are those of each metric's own plan."""
    for make, frames in ((deals, catalogue.DEAL_FRAMES), (orders, catalogue.ORDER_FRAMES)):
        is_deals = make is deals
        long = catalogue.data_frames(*((deals, None) if is_deals else (None, orders)))
        found = {}
        for r in long.collect():
            found.setdefault(r["request"], {}).setdefault(r["row"], {})[r["column"]] = r["value"] if r["text"] is None else r["text"]
        for name in frames:
            own = registry.run_metric(name, deals, orders, AS_OF).data
            if name in ("work_orders_by_type", "work_orders_by_status"):
                own = getattr(operational, name)(orders)
            rows = [r.asDict() for r in own.collect()]
            assert [found.get(name, {})[i] for i in sorted(found.get(name, {}))] == rows, name


def test_catalogue_kpis(deals, orders):
    kpis = {(r["request"], r["metric"]): r["display"] for r in catalogue.kpi_frames(deals, orders).collect()}
    for name in ("pipeline_value", "average_deal_size", "active_deals", "receivables", "billing_completion_rate", "financial_summary", "leadership_update"):
        own = registry.run_metric(name, deals, orders, AS_OF).kpis.collect()
        assert {r["metric"]: r["display"] for r in own} == {m: d for (r, m), d in kpis.items() if r == name}, name


def test_catalogue_of_empty_tables(deals, orders):
    kpis = catalogue.kpi_frames(deals.limit(0), orders.limit(0)).collect()
    by = {(r["request"], r["metric"]): r["value"] for r in kpis}
    assert by["active_deals", "active_deals"] == 0 and by["total_billed", "total_billed"] == 0
    assert ("leadership_update", "top_sector") not in by
    assert catalogue.data_frames(deals.limit(0), orders.limit(0)).count() == 0
    assert {r["count"] for r in catalogue.summary_rows(deals.limit(0), orders.limit(0)).collect()} == {0}


def test_status_of_a_request(deals):
    got = catalogue.kpi_frames(deals, None, "Won").filter("request = 'pipeline_value'").first()
    assert got["value"] == 1000.0


def test_moments_do_not_depend_on_the_order(spark):
    """The same bound to the last bit, whatever the partitions; near the plain one."""
    import random
    import statistics

    rng = random.Random(3)
    values = [rng.lognormvariate(10, 3) for _ in range(3000)] + [0.1, 1e-5, 123456789012.345, 0.0]
    bounds = set()
    for parts in (1, 7, 64):
        rng.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "deal_value double").repartition(parts)
        bounds.add(df.select(quality.outlier_bound(df).alias("b")).first()["b"])
    positive = [v for v in values if v > 0]
    assert len(bounds) == 1
    assert bounds.pop() == pytest.approx(statistics.mean(positive) + 3 * statistics.stdev(positive), rel=1e-9)


def test_moments_of_extremes(spark):
    equal = spark.createDataFrame([(0.1,)] * 20, "deal_value double")
    assert equal.select(quality.outlier_bound(equal).alias("b")).first()["b"] == pytest.approx(0.1, rel=1e-5)
    huge = spark.createDataFrame([(1e300,)] * 20 + [(-5.0,), (None,)], "deal_value double")
    assert huge.select(quality.outlier_bound(huge).alias("b")).first()["b"] > 1e24
    few = spark.createDataFrame([(5.0,)] * 10, "deal_value double")
    assert few.select(quality.outlier_bound(few).alias("b")).first()["b"] is None


def test_interpret(spark):
    rows = [
        ("ok", '{"metric": "receivables"}'), ("  How is it? ", '{"metric": "nonsensical", "sector": "dsp"}'),
        ("What is due?", '{"metric": "receivables", "sector": "dsp", "period": "all_time"}'),
        (" What now? ", None), (None, None), ("What is due?", "no idea"),
    ]
    df = spark.createDataFrame(rows, "question string, reply string").coalesce(1)
    got = [
        (r["nonsensical"], r["metric"], r["sector"], r["description"], r["source"], len(r["suggestions"] or []))
        for r in questions.interpret(df).collect()
    ]
    assert got == [
        (True, "nonsensical", None, "ok", "question", 7),
        (True, "nonsensical", None, "How is it?", "whole", 7),
        (False, "receivables", "dsp", None, "whole", 0),
        (False, "general_query", None, "What now?", "default", 0),
        (True, "nonsensical", None, None, "question", 7),
        (False, "general_query", None, "no idea", "default", 0),
    ]


def test_closing_deals_keep_the_order_of_the_source(spark, deals):
    ordered = deals.withColumn("at", -F.monotonically_increasing_id()).repartition(4)
    got = pipeline.closing_this_quarter(ordered, AS_OF, order_by=["at"])
    assert "at" not in got.columns
    assert [r["deal_name"] for r in got.collect()] == [None, "b", "a"]
    assert pipeline.closing_this_month(ordered, AS_OF, ["at"]).columns == pipeline.CLOSING_COLUMNS


def test_gibberish(spark):
    cells = ["aaaaa", "bcdfgh", "12345", "ok", " no ", "xz", "How is mining?", ""]
    df = spark.createDataFrame([(c,) for c in cells], "text string")
    flagged = questions.flag_gibberish(df).collect()
    got = {r["text"]: r["nonsensical"] for r in flagged}
    assert [got[c] for c in cells] == [True, True, True, True, True, True, False, True]
    assert all((r["suggestions"] is None) != r["nonsensical"] for r in flagged)


@pytest.mark.parametrize(
    "reply, metric, source",
    [
        ('{"metric": "receivables"}', "receivables", "whole"),
        ('```json\n{"metric": "a"}\n``` more {"metric": "b"}', "a", "fenced"),
        ('So: {"metric": "a", "x": {"y": 1}} done', "a", "embedded"),
        ('{broken {"metric": "a"}', "a", "embedded"),
        ('{"metric": "a"} trailing', "a", "embedded"),
        ("[1, 2]", "general_query", "default"),
        ("no json at all", "general_query", "default"),
        ('{"sector": "dsp"}', "general_query", "whole"),
    ],
)
def test_extract_intent(spark, reply, metric, source):
    df = spark.createDataFrame([(reply,)], "text string")
    row = questions.extract_intent(df).first()
    assert (row["metric"], row["source"]) == (metric, source)


def test_long_text_does_not_backtrack(spark):
    text = "{" * 5000 + " a " * 20000 + '{"metric": "receivables"}'
    row = questions.extract_intent(spark.createDataFrame([(text,)], "text string")).first()
    assert row["metric"] == "receivables"
