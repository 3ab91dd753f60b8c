"""Free-form headers to canonical columns. Plan time only, no data is read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from bizmetrics import config


def _norm(header: str) -> str:
    return header.lower().strip()


def _matches(alias: str, header: str) -> bool:
    pattern = re.escape(_norm(alias)).replace(r"\*", r"\S+")
    return re.fullmatch(pattern, header) is not None


def resolve_headers(columns: list[str], aliases: dict[str, list[str]]) -> list[str]:
    """New name for every column, by position.

    For each target the first alias that is present wins; of several equal headers the
    last column. Unknown columns keep their name, with a numbered suffix if Spark, which
    ignores case, could not tell it from another one.
    """
    last = {_norm(c): i for i, c in enumerate(columns)}
    target: dict[int, str] = {}
    for name, spellings in aliases.items():
        hit = next(
            (i for a in spellings for h, i in last.items() if _matches(a, h)), None
        )
        if hit is not None:
            target[hit] = name
    taken = set(target.values())
    out = []
    for i, column in enumerate(columns):
        name = target.get(i)
        if name is None:
            name, n = column, 1
            while name.lower() in taken:
                n += 1
                name = f"{column}_{n}"
            taken.add(name.lower())
        out.append(name)
    return out


def canonical(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    # By position: headers may hold dots and may differ only by case or outer spaces.
    return df.toDF(*resolve_headers(df.columns, aliases))


def canonical_deals(df: DataFrame) -> DataFrame:
    return canonical(df, config.DEAL_HEADERS)


def canonical_work_orders(df: DataFrame) -> DataFrame:
    return canonical(df, config.WORK_ORDER_HEADERS)
