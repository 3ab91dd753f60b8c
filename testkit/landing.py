"""Raw tables written out as the files an export would leave: CSV and board pages.

Files go below the session's shared folder, once per session and scale.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizmetrics.session import shared_folder
from testkit import raw_tables as raw

BANNER = "Work order tracker,,exported"
KEYS_PER_PAGE = 4096  # positions, 8 per order
ROWS_PER_FILE = 100_000  # of an export, about
EXPORTS = 10  # folders of rows by position; copies go to two more behind them
_landed: dict[tuple[str, str, str], str] = {}


def _once(
    spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]
) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _landed:
        path = f"{shared_folder(spark)}/bizmetrics-landing/{uuid.uuid4().hex}/{name}"
        write(path)
        _landed[key] = path
    return _landed[key]


def _stored(
    spark: SparkSession, sf_dir: str, name: str, order: list[str], headers: dict[str, str]
) -> DataFrame:
    """A raw table as Parquet, so that each query starts at a scan of raw cells."""

    def write(path: str) -> None:
        # dealt anew: a single-file input would leave one file, and one task for what follows
        raw.for_spark(spark, sf_dir, name, dealt=True).write.parquet(path, compression="zstd")

    df = spark.read.parquet(_once(spark, sf_dir, name, write))
    return df.select(*order, *headers).toDF(*order, *headers.values())


def raw_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals as a board export names them; ``ordinal`` holds the source position."""
    return _stored(spark, sf_dir, "raw_deals", raw.DEAL_ORDER, raw.DEAL_HEADERS)


def raw_work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(
        spark, sf_dir, "raw_work_orders", raw.WORK_ORDER_ORDER, raw.WORK_ORDER_HEADERS
    )


def _cells(spark: SparkSession, sf_dir: str, name: str, headers: dict[str, str]) -> DataFrame:
    """Raw cells under their headers, to be written out once: the stored table where a query
    has made it already, else the rows as they come, without a copy between."""
    path = _landed.get((spark.sparkContext.applicationId, sf_dir, name))
    df = spark.read.parquet(path) if path else raw.for_spark(spark, sf_dir, name, dealt=True)
    return df.select(*headers).toDF(*headers.values())


def deals_csv(spark: SparkSession, sf_dir: str) -> str:
    def write(path: str) -> None:
        _cells(spark, sf_dir, "raw_deals", raw.DEAL_HEADERS).write.options(
            header=True,
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
            compression="gzip",
        ).csv(path)

    return _once(spark, sf_dir, "deals_csv", write)


def _exported(spark: SparkSession, sf_dir: str, deals: DataFrame) -> tuple[DataFrame, int]:
    """Deals with the number of the ``export`` folder they are in: by range of positions,
    second copies (position 1 of 8) in folders 10 and 11. Their numbers are not padded, so
    the order of names is not that of positions. Also the number of files for them all."""
    found = deals.agg(
        (F.floor(F.max("ordinal") / EXPORTS) + 1).alias("step"), F.count(F.lit(1)).alias("rows")
    ).first()
    step, files = found["step"], max(EXPORTS + 2, -(-found["rows"] // ROWS_PER_FILE))
    copies = EXPORTS + F.floor(F.col("ordinal") / 8) % 2
    export = F.when(F.col("ordinal") % 8 == 1, copies).otherwise(F.floor(F.col("ordinal") / step))
    return deals.withColumn("export", export.cast("int")), files


def deals_export(spark: SparkSession, sf_dir: str) -> str:
    """The deals as CSV files in twelve folders, each in the order of positions: files of a
    folder are numbered in it too."""

    def write(path: str) -> None:
        deals, files = _exported(spark, sf_dir, raw_deals(spark, sf_dir))
        deals.repartitionByRange(files, "export", *raw.DEAL_ORDER).sortWithinPartitions(
            "export", *raw.DEAL_ORDER
        ).drop(*raw.DEAL_ORDER).write.options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
            compression="gzip",
        ).partitionBy("export").csv(path)

    return _once(spark, sf_dir, "deals_export", write)


def work_orders_csv(spark: SparkSession, sf_dir: str) -> str:
    """Every file starts with a banner line, its header is the second line."""

    def write(path: str) -> None:
        table = _cells(spark, sf_dir, "raw_work_orders", raw.WORK_ORDER_HEADERS)
        head = f"{BANNER}\n{','.join(table.columns)}"
        options = {
            "escape": '"',
            "ignoreLeadingWhiteSpace": "false",
            "ignoreTrailingWhiteSpace": "false",
        }
        # A file is a task's rows, and before the first of them come the two lines.
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
        line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in table.columns]), options)
        lines = table.select(line.alias("line"), first.alias("first")).select(
            F.when(F.col("first"), F.concat(F.lit(f"{head}\n"), "line")).otherwise(F.col("line")).alias("value")
        )
        if spark.read.parquet(f"{sf_dir}/lineitem.parquet").isEmpty():
            lines = spark.createDataFrame([(head,)], "value string").coalesce(1)
        lines.write.text(path, compression="gzip")

    return _once(spark, sf_dir, "work_orders_csv", write)


BOARD_COLUMNS = list(raw.DEAL_HEADERS)


def _cell(cell_id: str, text: Column, title: str | None) -> Column:
    column = (
        F.struct(F.lit(title).alias("title"))
        if title is not None
        else F.lit(None).cast("struct<title:string>")
    )
    return F.struct(
        F.lit(cell_id).alias("id"),
        text.alias("text"),
        F.lit(None).cast("string").alias("value"),
        F.lit("text").alias("type"),
        column.alias("column"),
    )


def _paged(deals: DataFrame) -> DataFrame:
    """A page holds a fixed range of positions, so its list is bounded."""
    return deals.withColumn("page", F.floor(F.col("ordinal") / KEYS_PER_PAGE))


def _page_texts(deals: DataFrame, *by: str) -> DataFrame:
    """Response texts (``page``, ``value`` and ``by``) of deals that are partitioned by these,
    some hundred items each, first and follow-up page shapes by turns. Each item repeats the
    title ``Deal Status`` and has one cell without a column.

    Rows are gathered as they are: a response is many times as long, and is made when its
    page is complete."""

    def item(row: Column) -> Column:
        cells = F.array(
            _cell("c0", F.lit("first of two"), "Deal Status"),
            *[
                _cell(f"c{i}", row[c], raw.DEAL_HEADERS[c])
                for i, c in enumerate(BOARD_COLUMNS, 1)
            ],
            _cell("link", row["client_code"], None),
        )
        return F.struct(
            row["ordinal"].cast("string").alias("id"),
            F.coalesce(row["deal_name"], F.lit("")).alias("name"),
            cells.alias("column_values"),
        )

    pages = deals.groupBy(*by, "page").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", *BOARD_COLUMNS))).alias("rows")
    )
    items = F.transform("rows", item)
    page = F.struct(F.lit("next").alias("cursor"), items.alias("items"))
    first = F.to_json(
        F.struct(
            F.struct(F.array(F.struct(page.alias("items_page"))).alias("boards")).alias("data")
        )
    )
    follow_up = F.to_json(F.struct(F.struct(page.alias("next_items_page")).alias("data")))
    return pages.select(
        *by, "page", F.when(F.col("page") % 2 == 0, first).otherwise(follow_up).alias("value")
    )


def board_pages(spark: SparkSession, sf_dir: str) -> str:
    """Deals as board items, in no order."""

    def write(path: str) -> None:
        deals = _paged(raw.for_spark(spark, sf_dir, "raw_deals"))
        _page_texts(deals.repartition("page")).select("value").write.text(path, compression="gzip")

    return _once(spark, sf_dir, "board_pages", write)


def board_export(spark: SparkSession, sf_dir: str) -> str:
    """The same pages in twelve folders, each in the order of positions."""

    def write(path: str) -> None:
        deals, files = _exported(spark, sf_dir, raw.for_spark(spark, sf_dir, "raw_deals"))
        dealt = _paged(deals).repartitionByRange(files, "export", "page")
        _page_texts(dealt, "export").sortWithinPartitions("export", "page").select(
            "export", "value"
        ).write.partitionBy("export").text(path, compression="gzip")

    return _once(spark, sf_dir, "board_export", write)


def catalogue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board catalogues as response texts: ``page`` and ``response``, 50 boards a page."""
    boards = raw.for_spark(spark, sf_dir, "boards")
    kind = F.when(F.col("nation") % 2 == 0, F.lit("numbers")).otherwise(F.lit("status"))

    def column(cid: str, title: str, ctype: Column) -> Column:
        return F.struct(
            F.lit(cid).alias("id"), F.lit(title).alias("title"), ctype.alias("type")
        )

    board = F.struct(
        "id",
        "name",
        F.array(
            column("name", "Name", F.lit("name")),
            column("c1", "Sector", F.lit("dropdown")),
            column("c2", "Amount", kind),
        ).alias("columns"),
    )
    return (
        boards.groupBy(F.floor(F.col("k") / 50).alias("page"))
        .agg(F.sort_array(F.collect_list(F.struct("k", board.alias("board")))).alias("rows"))
        .select(
            "page",
            F.to_json(
                F.struct(
                    F.struct(F.transform("rows", lambda r: r["board"]).alias("boards")).alias(
                        "data"
                    )
                )
            ).alias("response"),
        )
    )
