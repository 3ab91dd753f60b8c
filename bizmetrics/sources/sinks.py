"""Sinks: report text, metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(lines: DataFrame, path: str) -> None:
    """One Markdown text. A report has some dozens of lines, so one file is enough."""
    (
        lines.orderBy("section", "pos", "line")
        .select("line")
        .coalesce(1)
        .write.mode("overwrite")
        .text(path)
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)
