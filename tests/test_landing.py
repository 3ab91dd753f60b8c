"""Landed input and source positions keep to a size that follows the rows."""

import glob
import json

import pytest
from pyspark.sql import types as T

from bizmetrics.sources import board, csv, positions
from testkit import catalog, landing, raw_tables

ORDERS = 200


@pytest.fixture
def tables(spark, tmp_path):
    """Orders with lines, customers; some keys and names are null."""
    customers = [(i, f"Customer {i}", 0, 0.0, "RAIL") for i in range(5)]
    spark.createDataFrame(
        customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(ORDERS).selectExpr(
        "id AS o_orderkey", "id % 5 AS o_custkey", "IF(id % 2 = 0, 'O', 'F') AS o_orderstatus", "id + 0.5D AS o_totalprice",
        "timestamp_ntz '2001-02-03 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(ORDERS).selectExpr(
        "IF(id = 7, NULL, id) AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber", "1D AS l_quantity",
        "id + 1D AS l_extendedprice", "0D AS l_discount", "0D AS l_tax", "'A' AS l_returnflag", "'F' AS l_linestatus",
        "timestamp_ntz '2001-02-03 00:00:00' AS l_shipdate",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_rows_carry_a_number_for_their_file(spark, tmp_path):
    """Files in natural order; the key that sorts paths has hundreds of bytes a row."""
    for n in (10, 9, 2):
        (tmp_path / f"part {n}.csv").write_text(f"Deal Name,Sector\nD{n},a\n")
    rows = csv.read_deals_csv(spark, str(tmp_path))
    assert rows.schema[csv.POSITION[0]].dataType == T.IntegerType()
    assert [r[0] for r in rows.orderBy(*csv.POSITION).collect()] == ["D2", "D9", "D10"]


def test_items_carry_a_number_for_their_page_file(spark, tmp_path):
    page = '{"data": {"next_items_page": {"items": [{"id": "%d", "name": "n", "column_values": []}]}}}\n'
    for n in (10, 9, 2):
        (tmp_path / f"page_{n}.json").write_text(page % n)
    items = board.read_board(spark, str(tmp_path), titles=[])
    assert items.schema[csv.POSITION[0]].dataType == T.IntegerType()
    assert [r.item_id for r in items.orderBy(*board.ITEM_POSITION).collect()] == ["2", "9", "10"]


def test_a_failed_page_is_named_by_its_file(spark, tmp_path):
    (tmp_path / "bad.json").write_text(json.dumps({"errors": [{"message": "no"}]}) + "\n")
    with pytest.raises(board.BoardError, match="no in .*bad.json"):
        board.read_board(spark, str(tmp_path))


@pytest.mark.parametrize("name, source, made", [
    ("raw_deals", "o_orderkey", "deal_value"), ("raw_work_orders", "l_orderkey", "billed_value"),
])
def test_source_rows_are_dealt_not_the_cells_made_of_them(spark, tables, name, source, made):
    dealt = raw_tables.for_spark(spark, tables, name, dealt=True)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RebalancePartitions"):]
    assert source in below and made not in below
    assert sorted(map(str, dealt.collect())) == sorted(map(str, raw_tables.for_spark(spark, tables, name).collect()))
    assert "RoundRobin" not in dealt._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("land", ["deals_csv", "work_orders_csv", "deals_export", "board_pages", "board_export"])
def test_landed_texts_are_compressed(spark, tables, land):
    path = getattr(landing, land)(spark, tables)
    files = glob.glob(f"{path}/**/part-*", recursive=True)
    assert files and all(f.endswith(".gz") for f in files)


def test_an_export_has_files_by_its_rows(spark, tables, monkeypatch):
    """Folders of several files, read in the order of positions."""
    monkeypatch.setattr(landing, "ROWS_PER_FILE", 5)
    deals = landing.raw_deals(spark, tables)
    least = deals.count() // 5
    wanted = [r[0] for r in deals.filter("ordinal % 8 <> 1").orderBy("ordinal").select("`Deal Name`").collect()]
    path = landing.deals_export(spark, tables)
    assert len(glob.glob(f"{path}/export=*/part-*")) >= least
    table = positions.numbered(csv.read_deals_csv(spark, path), csv.POSITION)
    read = [r[0] for r in table.orderBy(positions.NAME).select("Deal Name").collect()]
    blank = {None, ""}
    assert [r for r in read if r not in blank][: len(wanted) // 2] == [w for w in wanted if w not in blank][: len(wanted) // 2]


def test_stored_pages_are_read_one_by_one(spark, tables):
    items = catalog.queries()["board_pages_items"](spark, tables)
    assert items.count() == raw_tables.for_spark(spark, tables, "raw_deals").count()
    scan = next(x for x in items._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in x)
    assert "Batched: false" in scan


def test_work_orders_csv_is_made_without_a_copy(spark, tables, tmp_path):
    """Straight from the source rows, and in the spelling of the stored table: banner and
    header stand before the rows of each file, also where there are none."""
    headers = list(raw_tables.WORK_ORDER_HEADERS.values())

    def cells(path):
        table = csv.read_work_orders_csv(spark, path)
        return sorted(map(str, table.select(*[f"`{c}`" for c in headers]).collect()))

    direct = cells(landing.work_orders_csv(spark, tables))
    assert not any(key[1:] == (tables, "raw_work_orders") for key in landing._landed)
    copy = f"{tmp_path}/copy"
    for name in ("orders", "lineitem"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(f"{copy}/{name}.parquet")
    assert landing.raw_work_orders(spark, copy).count() == len(direct) > ORDERS
    assert cells(landing.work_orders_csv(spark, copy)) == direct
    spark.read.parquet(f"{tables}/lineitem.parquet").limit(0).write.parquet(f"{copy}/none/lineitem.parquet")
    assert cells(landing.work_orders_csv(spark, f"{copy}/none")) == []
