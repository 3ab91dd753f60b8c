"""Benchmark: warm seconds per query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Every query runs to the last row (no-op sink, all columns). The raw tables are derived
and stored before the clock starts; cleaning is part of every metric query, as no
cleaned table is kept between them. The ``stored_*`` entries time metrics over cleaned
tables that were written once, the way a dashboard would run them. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bizmetrics.plans import financial, leadership, operational, pipeline  # noqa: E402
from bizmetrics.session import configure, local_session, shared_folder  # noqa: E402
from testkit import catalog, landing  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINE = [
    "pipeline_by_sector", "pipeline_by_stage", "average_deal_size", "deal_creation_trend",
    "closing_this_quarter", "work_orders_by_sector", "billing_completion",
    "execution_status_share", "active_work_orders", "financial_summary",
    "billing_vs_collection", "receivables_by_sector", "leadership_kpis", "report_lines",
    "clean_deals", "clean_work_orders", "dedupe_deals", "dedupe_work_orders", "dq_deals",
    "dq_work_orders", "deal_value_outliers", "parse_dates", "safe_float",
    "normalize_sector", "board_items_wide", "read_work_orders_csv", "extract_intent",
    "flag_gibberish",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(make) -> float:
    """Median of the warm runs; the first one compiles and is not counted."""
    seconds = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        run(make())
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds[1:]), 3)


def main() -> None:
    spark = configure(local_session(CPUS, os.environ.get("BENCH_MEMORY", "16g")))
    spark.conf.set("spark.sql.shuffle.partitions", CPUS)
    queries = catalog.queries()
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    landing.raw_deals(spark, SF_DIR)
    landing.raw_work_orders(spark, SF_DIR)
    times = {
        name: timed(lambda q=queries[name]: q(spark, SF_DIR))
        for name in names
        if name in queries
    }

    if not os.environ.get("BENCH_QUERIES"):
        folder = f"{shared_folder(spark)}/bizmetrics-bench/{uuid.uuid4().hex}"
        catalog.clean_deals(spark, SF_DIR).write.parquet(f"{folder}/deals")
        catalog.clean_work_orders(spark, SF_DIR).write.parquet(f"{folder}/work_orders")
        deals = spark.read.parquet(f"{folder}/deals")
        orders = spark.read.parquet(f"{folder}/work_orders")
        stored = {
            "pipeline_by_sector": lambda: pipeline.pipeline_by_sector(deals),
            "closing_this_quarter": lambda: pipeline.closing_this_quarter(
                deals, catalog.AS_OF
            ),
            "financial_summary": lambda: financial.financial_summary(orders),
            "billing_vs_collection": lambda: financial.billing_vs_collection(orders),
            "execution_status": lambda: operational.execution_status(orders),
            "leadership_kpis": lambda: leadership.leadership_kpis(deals, orders),
        }
        times.update({f"stored_{n}": timed(make) for n, make in stored.items()})

    print(
        json.dumps(
            {
                "metric": "total warm seconds, median run per query",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
