"""Row filters of the cleaning chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bizmetrics import config
from bizmetrics.functions.text import is_blank, literal, strip


_EMPTY = "__empty_row"


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def quoted(name: str) -> str:
    """SQL text of a column by its exact name, dots included."""
    return "`" + name.replace("`", "``") + "`"


def is_empty_row(columns: list[str], text_columns: list[str]) -> str:
    """All columns null, or every text column blank.

    A null is not blank: a row that mixes null and blank cells is not empty. Numbers are
    ignored by the second rule: a row whose texts are all blank is empty in spite of one.
    """
    cells = ", ".join(f"CAST({quoted(c)} AS STRING)" for c in columns)
    empty = f"coalesce({cells}) IS NULL"
    if not text_columns:
        return empty
    # One concatenation, null if any cell is null, and only for rows whose first cell is
    # blank.
    joined = "concat(" + ", ".join(quoted(c) for c in text_columns) + ")"
    first = is_blank(quoted(text_columns[0]))
    return (
        f"({empty} OR coalesce(CASE WHEN {first} THEN {is_blank(joined)} END, false))"
    )


def drop_empty_rows(
    df: DataFrame,
    columns: list[str] | None = None,
    text_columns: list[str] | None = None,
) -> DataFrame:
    columns = list(columns if columns is not None else df.columns)
    if text_columns is None:
        text_columns = [c for c in string_columns(df) if c in columns]
    # The flag passes through a one-element explode, so the filter refers to one column.
    # As a plain predicate over n columns it would be carried through every renaming
    # projection in 2^n variants, and planning a wide table would not end.
    flag = f"explode(array({is_empty_row(columns, text_columns)})) AS {_EMPTY}"
    return (
        df.selectExpr(*[quoted(c) for c in df.columns], flag)
        .filter(f"NOT {_EMPTY}")
        .drop(_EMPTY)
    )


def is_header_row(status: str) -> str:
    """Exact text, before any stripping; null is not a header."""
    words = ", ".join(literal(w) for w in config.DEAL_STATUS_HEADERS)
    return f"coalesce({status} IN ({words}), false)"


def drop_header_rows(df: DataFrame) -> DataFrame:
    if "deal_status" not in df.columns:
        return df
    return df.filter(f"NOT {is_header_row('deal_status')}")


def has_name(name: str) -> str:
    """Blank names go; null names stay."""
    return f"NOT coalesce({is_blank(name)}, false)"


def drop_blank_names(df: DataFrame) -> DataFrame:
    if "deal_name" not in df.columns:
        return df
    return df.filter(has_name("deal_name"))


def strip_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    todo = set(columns if columns is not None else string_columns(df))
    return apply_rules(df, {c: strip(quoted(c)) for c in df.columns if c in todo})


def apply_rules(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One projection; columns without a rule pass through unchanged."""
    return df.selectExpr(
        *[
            f"{rules[c]} AS {quoted(c)}" if c in rules else quoted(c)
            for c in df.columns
        ]
    )
