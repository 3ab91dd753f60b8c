"""Physical plans: no Python, one exchange for cleaning, pruned scans, no cross joins."""

import pytest

from bizmetrics.plans import financial, leadership, operational, pipeline
from bizmetrics import session
from testkit import catalog

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> int:
    return sum(
        line.strip(" :+-").startswith(("Exchange hash", "Exchange range", "Exchange Single"))
        for line in text.splitlines()
    )


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(catalog.queries()[name](spark, SF_DIR))
    for word in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
                 "NestedLoopJoin", "CartesianProduct"):
        assert word not in text, word


def test_cleaning_shuffles_once(spark):
    assert exchanges(plan(catalog.clean_deals(spark, SF_DIR))) == 1
    assert exchanges(plan(catalog.clean_work_orders(spark, SF_DIR))) == 1


def test_kpis_scan_each_table_once(spark):
    deals = catalog.clean_deals(spark, SF_DIR)
    orders = catalog.clean_work_orders(spark, SF_DIR)
    text = plan(leadership.leadership_kpis(deals, orders))
    assert text.count("FileScan") == 2


@pytest.mark.parametrize("name", ["run_metric", "metric_data", "report_lines", "context_summary", "unknown_metric"])
def test_catalogues_scan_each_table_once(spark, name):
    assert plan(catalog.queries()[name](spark, SF_DIR)).count("FileScan") == 2


def test_findings_scan_each_table_once(spark):
    """The bound of outliers shares the exchange of the merged copies."""
    found = catalog.queries()["dq_all"](spark, SF_DIR)
    found.collect()
    assert "ReusedExchange" in plan(found)


def test_share_reuses_the_grouped_counts(spark):
    df = operational.execution_status_share(catalog.clean_work_orders(spark, SF_DIR))
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_shuffle_carries_used_columns_only(spark):
    text = plan(pipeline.active_deals(catalog.clean_deals(spark, SF_DIR)))
    window = next(line for line in text.splitlines() if "Window [" in line)
    child = text[text.index(window):].splitlines()
    exchange = next(i for i, line in enumerate(child) if "Exchange hash" in line)
    carried = next(line for line in child[exchange:] if "Project [" in line)
    assert "product_deal" not in carried and "deal_value" in carried


def test_filters_reach_a_stored_table(spark, tmp_path):
    path = str(tmp_path / "deals")
    catalog.clean_deals(spark, SF_DIR).write.parquet(path)
    stored = spark.read.parquet(path)
    text = plan(pipeline.closing_this_quarter(stored, catalog.AS_OF))
    assert "GreaterThanOrEqual(tentative_close_date" in text
    assert "EqualTo(deal_status,Open)" in text
    scan = plan(pipeline.pipeline_by_sector(stored)).split("ReadSchema: ")[1]
    assert scan.startswith("struct<deal_status:string,deal_value:double,sector:string>")


def test_summary_is_one_pass(spark):
    orders = catalog.clean_work_orders(spark, SF_DIR)
    assert plan(financial.financial_summary(orders)).count("FileScan") == 1


@pytest.mark.parametrize(
    "name",
    ["clean_deals", "clean_work_orders", "dq_deals", "dq_work_orders", "parse_dates", "typed_dates",
     "run_metric", "metric_data", "report_lines", "extract_intent", "interpret_questions", "data_summary"],
)
def test_generated_code_compiles(spark, name, monkeypatch):
    """No stage passes the size that a method of the JVM may have."""
    monkeypatch.setitem(session.SETTINGS, "spark.sql.adaptive.enabled", "false")
    executed = catalog.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(executed)
    monkeypatch.undo()
    session.configure(spark)
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and -1 not in sizes
