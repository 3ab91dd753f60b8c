import datetime as dt

import pytest

from bizmetrics import config
from bizmetrics.operators import cleaning, dedupe, filters, quality, schema


def test_headers_first_alias_wins_and_last_column_wins():
    names = schema.resolve_headers(
        ["SECTOR ", "Sector/service", "sector", "Deal Name", "My.Col", "item_name"],
        config.DEAL_HEADERS,
    )
    # "Sector/service" comes first among the aliases; the plain ones pass through renamed
    assert names == ["SECTOR ", "sector", "sector_2", "deal_name", "My.Col", "item_name"]
    twice = schema.resolve_headers(["Deal Status", "deal status "], config.DEAL_HEADERS)
    assert twice == ["Deal Status", "deal_status"]


def test_header_wildcard_stands_for_one_word():
    header = "Is any Acme software platform part of the contract"
    assert schema.resolve_headers([header], config.WORK_ORDER_HEADERS) == ["software_platform"]


def test_headers_with_dots(spark):
    df = spark.createDataFrame([("5",)], ["Amount in Rupees (Excl of GST.) (Masked)"])
    assert schema.canonical_work_orders(df).columns == ["amount_total"]


def test_empty_rows(spark):
    rows = [
        ("null", None, None, None),
        ("blank despite number", " ", "", 5.0),
        ("null and blank stay", None, "", None),
        ("one value", "x", None, None),
        ("number only", None, None, 1.0),
        ("blank", " ", "\t", None),
    ]
    df = spark.createDataFrame(rows, "k string, a string, b string, n double")
    kept = filters.drop_empty_rows(df, ["a", "b", "n"], ["a", "b"])
    assert {r["k"] for r in kept.collect()} == {
        "null and blank stay", "one value", "number only",
    }


def test_header_rows_and_blank_names(spark):
    rows = [("a", "Deal Status"), ("b", "deal status"), ("c", None), (" ", "Open"), (None, "Open")]
    df = spark.createDataFrame(rows, "deal_name string, deal_status string")
    assert {r[0] for r in filters.drop_header_rows(df).collect()} == {"b", "c", " ", None}
    # null names stay
    assert {r[0] for r in filters.drop_blank_names(df).collect()} == {"a", "b", "c", None}


KEYED = [
    (1, " A", "1,000", "first"),
    (2, "A", "1,000", "other text"),
    (3, "A", "1000", "other number text"),
    (4, "A", "1000.0", "same number"),
    (5, None, None, "null key"),
    (6, None, None, "null key again"),
    (0, "A", "1000", "earliest"),
]


@pytest.mark.parametrize(
    "numeric, want", [([], {0, 1, 2, 4, 5}), (["v"], {0, 1, 2, 5})]
)
def test_keep_first(spark, numeric, want):
    df = spark.createDataFrame(KEYED, "o int, k string, v string, note string")
    kept = dedupe.keep_first(df, ["k", "v", "absent"], ["o"], numeric)
    assert {r["o"] for r in kept.filter("k IS NULL OR v <> '1,000'").collect()} == want - {1, 2}
    if not numeric:
        assert {r["o"] for r in kept.collect()} == want
        copies = dedupe.collapse_copies(df, ["k", "v"], ["o"], ["o"])
        assert {r["o"]: r["copies"] for r in copies.collect()} == {0: 2, 1: 1, 2: 1, 4: 1, 5: 2}


def test_whole_row_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "o int, c string")
    assert dedupe.keep_first(df, ["absent"], ["o"]).count() == 2


def test_hot_key_is_cut_before_the_shuffle(spark):
    """A third of the rows share one key: each map task sends one row of it."""
    df = spark.range(0, 30000, 1, 6).selectExpr(
        "id AS o", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS k"
    )
    kept = dedupe.keep_first(df, ["k"], ["o"])
    assert kept.count() == 20001
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    hot = dedupe.collapse_copies(df, ["k"], ["o"], ["o"]).filter("copies > 1").collect()
    assert [(r["o"], r["copies"]) for r in hot] == [(0, 10000)]


@pytest.mark.parametrize("numeric", [[], ["v"]])
def test_keep_first_of_wide_rows(spark, numeric, monkeypatch):
    """The same rows, also where all keys share one word of the sketch."""
    df = spark.createDataFrame(KEYED, "o int, k string, v string, note string")
    want = sorted(dedupe.keep_first(df, ["k", "v", "absent"], ["o"], numeric).collect(), key=str)
    for words in (dedupe._WORDS, 4):
        monkeypatch.setattr(dedupe, "_WORDS", words)
        monkeypatch.setattr(dedupe, "_BLOCK", min(words, 2))
        kept = dedupe.keep_first_wide(df, ["k", "v", "absent"], ["o"], numeric)
        assert kept.columns == df.columns and sorted(kept.collect(), key=str) == want
    whole = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "o int, c string")
    assert dedupe.keep_first_wide(whole, ["absent"], ["o"]).count() == 2


def test_rows_of_one_copy_are_not_shuffled(spark, tmp_path):
    """Of 30000 wide rows 200 share their key with another: the exchange of whole rows has few
    more, though which they are is known to the data alone."""
    df = spark.range(0, 30000, 1, 6).selectExpr(
        "id AS o", "CAST(CASE WHEN id >= 29900 THEN id - 29900 ELSE id END AS STRING) AS `Serial #`",
        "repeat(sha2(CAST(id AS STRING), 256), 8) AS SECTOR",
    )
    df.write.parquet(str(tmp_path / "wide"))
    kept = cleaning.distinct_work_orders(spark.read.parquet(str(tmp_path / "wide")), ["o"])
    assert {r["o"] for r in kept.select("o").collect()} == set(range(29900))
    kept.collect()
    moved = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in moved
    assert largest_exchange(kept) < 1 << 20


def largest_exchange(df):
    """Bytes, of the executed plan's exchanges without those of subqueries."""
    todo, sizes = [df._jdf.queryExecution().executedPlan()], [0]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            sizes.append(node.metrics().apply("dataSize").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return max(sizes)


RAW_DEALS = [
    (0, "Deal 1 ", "C1", "open", "₹ 1,000", "mining sector", "25/03/2024", "high"),
    (1, "Deal 1 ", "C1", "won", "₹ 1,000", "later copy", "x", "low"),
    (2, "Deal 2", None, "Deal Status", "5", "s", "x", "x"),
    (3, " ", "C", "open", "5", "s", "x", "x"),
    (4, None, "C3", "dead", "-7", None, "TBD", None),
    (5, None, None, None, None, None, None, None),
]
RAW_DEAL_COLUMNS = [
    "o", "Deal Name", "Client Code", "Deal Status", "Deal Value", "Sector",
    "Created Date", "Closure Probability",
]


def raw_deals(spark):
    kinds = "o int, " + ", ".join(f"`{c}` string" for c in RAW_DEAL_COLUMNS[1:])
    return spark.createDataFrame(RAW_DEALS, kinds)


def test_clean_deals(spark):
    rows = cleaning.clean_deals(raw_deals(spark), ["o"]).orderBy("deal_value").collect()
    assert [tuple(r) for r in rows] == [
        (None, "C3", "Dead", 0.0, "unknown", None, "unknown"),
        ("Deal 1", "C1", "Open", 1000.0, "mining", dt.datetime(2024, 3, 25), "High"),
    ]


def test_deals_quality(spark):
    found = quality.deals_quality(raw_deals(spark), ["o"]).collect()
    assert {r["rule"]: r["affected"] for r in found} == {
        "empty_rows": 1,
        "duplicates": 1,
        "missing_sector": 1,
        "invalid_created_date": 1,
        "negative_deal_value": 1,
    }


def test_missing_columns_skip_their_steps(spark):
    df = spark.createDataFrame([(0, "x", "1")], "o int, `Deal Name` string, extra string")
    assert [tuple(r) for r in cleaning.clean_deals(df, ["o"]).collect()] == [("x", "1")]
    assert quality.deals_quality(df, ["o"]).count() == 0


def test_receivable_rules(spark):
    rows = [
        (0, "a", "100", "50", "50.5"),  # within tolerance
        (1, "b", "100", "50", "51.5"),  # mismatch
        (2, "c", "0", "0", "0"),  # a true zero counts as missing
        (3, "d", "10", "0", None),
    ]
    df = spark.createDataFrame(
        rows,
        "o int, `Serial #` string, `Billed Value in Rupees (Masked)` string, "
        "`Collected Amount in Rupees` string, `Amount Receivable` string",
    )
    found = quality.work_orders_quality(df, ["o"]).collect()
    assert {r["rule"]: r["affected"] for r in found} == {
        "receivable_mismatch": 1,
        "missing_receivable": 2,
    }


@pytest.mark.parametrize("n, outliers", [(10, 0), (40, 1)])
def test_outliers_need_more_than_ten_values(spark, n, outliers):
    values = [(10.0,)] * (n - 1) + [(100000.0,)]
    df = spark.createDataFrame(values, "deal_value double")
    assert quality.high_outliers(df).count() == outliers
    assert quality.outliers_quality(df).count() == outliers
