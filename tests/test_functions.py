import datetime as dt

import pytest
from pyspark.sql import types as T

from bizmetrics import config
from bizmetrics.functions import dates, display, normalize, numbers, text


def test_strip_knows_all_white_space(apply):
    cells = ["\t a b\n", " x　", "  ", "", None, "plain", "é ", "x ", " x"]
    assert apply(text.strip, cells) == [
        "a b", "x", "", "", None, "plain", "é", "x", "x",
    ]
    assert apply(text.strip, list(config.WHITESPACE)) == [""] * len(config.WHITESPACE)


def test_blank_is_not_null(apply):
    assert apply(text.is_blank, ["", " \t", " ", "x", " é", None]) == [
        True, True, True, False, False, None,
    ]
    assert apply(text.missing, ["", None, "x"]) == [True, True, False]


def test_null_tokens_compare_exactly(apply):
    cells = ["NA", " NA", "null", "NULL", "Null", "", None, "nan", "#N/A"]
    assert apply(text.null_tokens, cells) == [
        None, " NA", None, None, "Null", None, None, None, None,
    ]


def test_money(apply):
    cells = [
        "₹ 2,500.50", "$3", "-5", "(500)", "12%", "1d", "1e5", "nan", "", None, "1_000",
        "inf", "1e400", ".5", "7.", "1 000", "0x1p3", "9" * 16,
    ]
    assert apply(numbers.money, cells) == [
        2500.5, 3.0, -5.0, 0.0, 0.0, 0.0, 100000.0, 0.0, 0.0, 0.0, 1000.0,
        0.0, 0.0, 0.5, 7.0, 1000.0, 0.0, 9999999999999999.0,
    ]
    assert apply(numbers.non_finite, cells) == [
        c in ("inf", "1e400") for c in cells
    ]


def test_money_of_numbers(apply):
    def of_double(c):
        return numbers.money(c, T.DoubleType())

    assert apply(of_double, [1.5, float("nan"), float("inf"), None, -2.0], "double") == [
        1.5, 0.0, 0.0, 0.0, -2.0,
    ]


def test_sums_of_large_amounts(spark):
    df = spark.range(2_000_000).selectExpr("9.9e14D AS a")
    assert df.selectExpr(f"{numbers.exact_sum('a')} AS s").first()["s"] == 2e6 * 9.9e14
    mixed = spark.createDataFrame([(a,) for a in (1e15, 2e15, 0.25, -3.5, 1e300)], "a double")
    row = mixed.selectExpr(
        f"{numbers.exact_sum('a', 'a < 1e16')} AS s", f"{numbers.exact_sum('a')} AS t",
        f"{numbers.exact_sum('a', 'a > 1e301')} AS none",
    ).first()
    assert (row.s, row.t, row.none) == (3e15 - 3.25, 1e300, 0.0)


def test_exact_sum_is_exact_and_order_free(spark):
    amounts = [0.1, 0.2, 0.3, 1e14, -0.1, 123456.7891] * 500
    for parts in (1, 7):
        df = spark.createDataFrame([(a,) for a in amounts], "a double").repartition(parts)
        total = df.selectExpr(f"{numbers.exact_sum('a')} AS s").first()["s"]
        assert total == 500 * (100000000000000 + 1234567891 / 10000 + 0.5)
    empty = df.filter("false").selectExpr(f"{numbers.exact_sum('a')} AS s").first()["s"]
    assert empty == 0.0


@pytest.mark.parametrize(
    "cell, want",
    [
        ("2024-03-04", (2024, 3, 4)),
        ("2024-3-4", (2024, 3, 4)),
        ("03/04/2024", (2024, 3, 4)),
        ("25/03/2024", (2024, 3, 25)),
        ("4-3-2024", (2024, 3, 4)),
        ("12-13-2024", (2024, 12, 13)),
        ("2024/03/04", (2024, 3, 4)),
        ("March 4, 2024", (2024, 3, 4)),
        ("mar 4, 2024", (2024, 3, 4)),
        ("20240304", (2024, 3, 4)),
        ("04 Mar 2024", (2024, 3, 4)),
        ("4-Mar-24", (2024, 3, 4)),
        ("1/2/24", (2024, 1, 2)),
        ("1/2/99", (1999, 1, 2)),
        ("2024-3", (2024, 3, 1)),
        ("2024-03-04T10:11:12", (2024, 3, 4, 10, 11, 12)),
        ("2024-03-04 10:11", (2024, 3, 4, 10, 11)),
        ("2024-03-04T10:11:12Z", (2024, 3, 4, 10, 11, 12)),
        ("3/4/2024 10:11", (2024, 3, 4, 10, 11)),
        ("25/3/2024 10:11:12", (2024, 3, 25, 10, 11, 12)),
        ("4-3-2024 7:05", (2024, 3, 4, 7, 5)),
        ("3/4/24 10:11", (2024, 3, 4, 10, 11)),
        ("3/4/2024 10:11 PM", (2024, 3, 4, 22, 11)),
        ("3/4/2024, 12:11 am", (2024, 3, 4, 0, 11)),
        ("3/4/2024 12:11pm", (2024, 3, 4, 12, 11)),
        ("2024-03-04 10:11 PM", (2024, 3, 4, 22, 11)),
        ("2024/03/04 10:11:12", (2024, 3, 4, 10, 11, 12)),
        ("04-Mar-2024 10:11", (2024, 3, 4, 10, 11)),
        ("4 March 2024 10:11:12", (2024, 3, 4, 10, 11, 12)),
        ("Monday, March 4, 2024", (2024, 3, 4)),
        ("Mon, 04 Mar 2024 10:11:12", (2024, 3, 4, 10, 11, 12)),
        ("Mar. 4, 2024", (2024, 3, 4)),
        ("Sept. 4, 2024", (2024, 9, 4)),
        ("March 4th, 2024 10:11", (2024, 3, 4, 10, 11)),
        ("1st of May", None),
        ("20240304 1011", (2024, 3, 4, 10, 11)),
        ("20240304T101112", (2024, 3, 4, 10, 11, 12)),
        ("3/4/2024 25:11", None),
        ("Mar-2024", (2024, 3, 1)),
        ("2024-02-30", None),
        ("31-02-2024", None),
        ("Q1 2024", None),
        ("Mac 4, 2024", None),
        ("TBD", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_date(apply, cell, want):
    assert apply(dates.parse_date, [cell]) == [want and dt.datetime(*want)]


def test_typed_dates_are_cut_to_midnight(apply):
    def typed(c):
        return dates.parse_date(c, T.TimestampNTZType())

    cell = dt.datetime(2024, 3, 4, 10, 11)
    assert apply(typed, [cell], "timestamp_ntz") == [dt.datetime(2024, 3, 4)]


def test_quarter_and_month_bounds():
    assert dates.current_quarter(dt.date(2024, 12, 31)) == (4, 2024)
    assert dates.quarter_bounds(dt.date(2024, 12, 31)) == (
        dt.date(2024, 10, 1), dt.date(2025, 1, 1),
    )
    assert dates.month_bounds(dt.date(2024, 2, 29)) == (
        dt.date(2024, 2, 1), dt.date(2024, 3, 1),
    )


def test_sector(apply):
    cells = [
        "power-line", "---", "Security & Surveillance", "Énergie!", None, "",
        "Renewable Energy", "Rail.", "Oil/Gas",
    ]
    assert apply(normalize.sector, cells) == [
        "powerline", "", "security & surveillance", "énergie", "unknown", "unknown",
        "renewables", "railways", "oil/gas",
    ]


def test_statuses(apply):
    assert apply(normalize.deal_status, ["closed", "ACTIVE", "Some New", "", None]) == [
        "Won", "Open", "Some New", "unknown", "unknown",
    ]
    assert apply(normalize.probability, ["n/a", "won't", "HIGH", "very-high chance"]) == [
        "N/A", "Won'T", "High", "Very-High Chance",
    ]
    cells = ["Executed until Mar", "done", "Pause / struck", "In Progress", None]
    assert apply(normalize.execution_status, cells) == [
        "Executed until current", "Completed", "Pause / struck", "Ongoing", "unknown",
    ]


def test_normalisers_are_idempotent(apply):
    for function, cells in (
        (normalize.deal_status, ["closed", "Some New", None]),
        (normalize.probability, ["n/a", "very-high", "LOW"]),
        (normalize.execution_status, ["Executed until Mar", "done", "x y"]),
    ):
        once = apply(function, cells)
        assert apply(function, once) == once


def test_fill_categorical_leaves_values_untouched(apply):
    assert apply(text.fill_categorical, [" a ", " ", None]) == [" a ", "unknown", "unknown"]


def test_format_currency(apply):
    amounts = [999.5, 1000.0, 99999.0, 100000.0, 10000000.0, -250000.0, 0.0, 100500.0, 0.125]
    assert apply(display.format_currency, amounts, "double") == [
        "₹999.50", "₹1.0K", "₹100.0K", "₹1.00 L", "₹1.00 Cr", "₹-2.50 L", "₹0.00",
        "₹1.00 L",  # 1.005 is below the tie in binary
        "₹0.12",
    ]


def test_rounding_follows_the_binary_value(apply):
    values = [0.25, 0.35, 2.675, 1e6 + 0.05]
    got = apply(lambda c: numbers.round_half_even(c, 1), values, "double")
    assert got == [round(v, 1) for v in values]


def test_percent(spark):
    row = spark.range(1).selectExpr(
        f"{numbers.percent('1D', '3D')} AS a", f"{numbers.percent('1D', '0D')} AS b"
    ).first()
    assert (row["a"], row["b"]) == (33.3, 0.0)


def test_everyday_date_spellings(apply):
    cells = [
        "04.03.2024", "March 4 2024", "4 March, 2024", "Mar 2024", "4-3-24", "20240304T101112",
        "13.03.2024", "31-3-24",
    ]
    day = dt.datetime
    assert apply(dates.parse_date, cells) == [
        day(2024, 4, 3), day(2024, 3, 4), day(2024, 3, 4), day(2024, 3, 1), day(2024, 4, 3),
        day(2024, 3, 4, 10, 11, 12), day(2024, 3, 13), None,
    ]
