"""The two cleaning chains: raw cells in, typed canonical table out.

Each is one lazy plan with a single exchange (the keep-first step). A step whose column
is missing is left out of the plan. Order matters: duplicates are found on raw text,
before stripping and number parsing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizmetrics import config
from bizmetrics.functions import normalize, numbers
from bizmetrics.functions.dates import parse_date
from bizmetrics.functions.text import unless_missing
from bizmetrics.operators import filters
from bizmetrics.operators.dedupe import keep_first, keep_first_wide
from bizmetrics.operators.schema import canonical_deals, canonical_work_orders


def _data_columns(df: DataFrame, order_by: list[str]) -> list[str]:
    return [c for c in df.columns if c not in order_by]


def _text_columns(
    df: DataFrame, order_by: list[str], numeric_columns: list[str]
) -> list[str]:
    return [
        c
        for c in filters.string_columns(df)
        if c not in order_by and c not in numeric_columns
    ]


def deal_rules(df: DataFrame) -> dict[str, str]:
    """SQL texts over stripped raw deals, for the columns that exist."""
    kind = {f.name: f.dataType for f in df.schema.fields}
    rules: dict[str, str] = {}
    for c in kind:
        col = filters.quoted(c)
        if c == "sector":
            rules[c] = normalize.sector(col)
        elif c in config.DEAL_DATES:
            rules[c] = parse_date(col, kind[c])
        elif c in config.DEAL_MONEY:
            rules[c] = numbers.clamp(numbers.money(col, kind[c]))
        elif c == "deal_status":
            rules[c] = normalize.deal_status(col)
        elif c == "closure_probability":
            rules[c] = normalize.probability(col)
        elif c in config.DEAL_CATEGORICALS:
            rules[c] = unless_missing(col, col)
    return rules


def work_order_rules(df: DataFrame) -> dict[str, str]:
    kind = {f.name: f.dataType for f in df.schema.fields}
    rules: dict[str, str] = {}
    for c in kind:
        col = filters.quoted(c)
        if c == "sector":
            rules[c] = normalize.sector(col)
        elif c in config.WORK_ORDER_MONEY:
            rules[c] = numbers.clamp(numbers.money(col, kind[c]))
        elif c in config.WORK_ORDER_DATES:
            rules[c] = parse_date(col, kind[c])
        elif c == "execution_status":
            rules[c] = normalize.execution_status(col)
        elif c in config.WORK_ORDER_CATEGORICALS:
            rules[c] = unless_missing(col, col)
    return rules


_HEADER = "__header_row"


def _ready(
    df: DataFrame, rules: Callable, keys: list[str], skip: list[str]
) -> DataFrame:
    """Strip and convert what is no key: these columns enter the exchange as short values,
    and no filter behind it has to carry the parsing. Keys must stay raw till then."""
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return df  # whole rows are compared
    skip = {*keys, *skip}
    df = filters.strip_strings(df, [c for c in filters.string_columns(df) if c not in skip])
    return filters.apply_rules(df, {c: r for c, r in rules(df).items() if c not in skip})


def _raw_left(df: DataFrame, keys: list[str], later: list[str] = ()) -> list[str]:
    """What `_ready` has left raw: the keys and what was put off, or everything if there are
    no keys."""
    if not any(k in df.columns for k in keys):
        return df.columns
    return [c for c in (*keys, *later) if c in df.columns]


def _stripped(
    df: DataFrame, keys: list[str], order_by: list[str], later: list[str] = ()
) -> DataFrame:
    left = [c for c in _raw_left(df, keys, later) if c not in order_by]
    return filters.strip_strings(df, [c for c in filters.string_columns(df) if c in left])


def _finished(
    df: DataFrame, rules: Callable, keys: list[str], order_by: list[str], later: list[str] = ()
) -> DataFrame:
    left = [c for c in _raw_left(df, keys, later) if c not in order_by]
    return filters.apply_rules(df, {c: r for c, r in rules(df).items() if c in left})


def _filled(
    df: DataFrame, order_by: list[str], numeric_columns: list[str]
) -> DataFrame:
    return filters.drop_empty_rows(
        df,
        _data_columns(df, order_by),
        _text_columns(df, order_by, numeric_columns),
    )


def clean_deals(
    raw: DataFrame, order_by: list[str], numeric_columns: list[str] = (), keep_order: bool = False
) -> DataFrame:
    """``order_by`` names the columns that hold the source position; they are dropped unless
    ``keep_order``. ``numeric_columns`` are canonical columns whose cells are all numbers."""
    df = _filled(canonical_deals(raw), order_by, numeric_columns)
    # the header test is on raw text, like the keys
    header = filters.is_header_row("deal_status") if "deal_status" in df.columns else "false"
    keyed = any(k in df.columns for k in config.DEAL_KEYS)
    if keyed:
        df = df.withColumn(_HEADER, F.expr(header))
    df = _ready(df, deal_rules, config.DEAL_KEYS, [*order_by, _HEADER])
    df = keep_first(df, config.DEAL_KEYS, order_by, numeric_columns)
    df = df.filter(f"NOT {_HEADER}").drop(_HEADER) if keyed else df.filter(f"NOT {header}")
    df = df if keep_order else df.drop(*order_by)
    df = filters.drop_blank_names(_stripped(df, config.DEAL_KEYS, order_by))
    return _finished(df, deal_rules, config.DEAL_KEYS, order_by)


def distinct_work_orders(
    raw: DataFrame, order_by: list[str], numeric_columns: list[str] = ()
) -> DataFrame:
    """Canonical columns, empty rows gone, first copy of each order; text still raw."""
    df = _filled(canonical_work_orders(raw), order_by, numeric_columns)
    return keep_first_wide(df, config.WORK_ORDER_KEYS, order_by, numeric_columns)


def clean_work_orders(
    raw: DataFrame, order_by: list[str], numeric_columns: list[str] = (), keep_order: bool = False
) -> DataFrame:
    """As `clean_deals`, but header-like and nameless rows are kept here and the billing
    months stay text. The four dates are read behind the exchange: with them, the generated
    method before it would pass the size that the JVM accepts."""
    later = config.WORK_ORDER_DATES
    df = _filled(canonical_work_orders(raw), order_by, numeric_columns)
    df = _ready(df, work_order_rules, config.WORK_ORDER_KEYS, [*order_by, *later])
    df = keep_first(df, config.WORK_ORDER_KEYS, order_by, numeric_columns)
    df = _stripped(df if keep_order else df.drop(*order_by), config.WORK_ORDER_KEYS, order_by, later)
    return _finished(df, work_order_rules, config.WORK_ORDER_KEYS, order_by, later)


def enforce_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Named columns as double, anything unreadable as 0."""
    return filters.apply_rules(
        df,
        {
            c: numbers.enforce_double(filters.quoted(c))
            for c in columns
            if c in df.columns
        },
    )
