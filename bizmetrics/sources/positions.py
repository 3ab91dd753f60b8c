"""Source order as one number: 0, 1, 2, … over all files of a read.

Readers leave each row's file, split and running number. These order rows, but have gaps;
a contiguous number comes from counting the rows of each run (a split of a file, a page of
items) and adding up the counts before it. Only the counts are shuffled and summed, by file
first, so nothing is sorted and no task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizmetrics.operators.filters import quoted

NAME = "position"


def run_starts(df: DataFrame, order_by: list[str]) -> DataFrame:
    """For each run, its least running number and how many rows stand before it."""
    file, *inner = order_by[:-1]
    runs = df.groupBy(*[quoted(c) for c in order_by[:-1]]).agg(
        F.min(quoted(order_by[-1])).alias("__least"), F.count(F.lit(1)).alias("__rows")
    )
    # One row a file in the window over everything; runs are summed within their file.
    all_before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    files = runs.groupBy(file).agg(F.sum("__rows").alias("__rows")).select(
        file, F.coalesce(F.sum("__rows").over(all_before), F.lit(0)).alias("__files_before")
    )
    in_file = Window.partitionBy(file).orderBy(*inner).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn(
        "__runs_before", F.coalesce(F.sum("__rows").over(in_file), F.lit(0))
    ).join(files, file).select(
        *order_by[:-1], "__least", (F.col("__files_before") + F.col("__runs_before")).alias("__before")
    )


def numbered(df: DataFrame, order_by: list[str], name: str = NAME) -> DataFrame:
    """The columns of ``order_by`` replaced by one number, ``name``.

    The last of them must count by one within a run of equal others, which the readers'
    columns do. The rows are read once more for the counts.
    """
    keep = [quoted(c) for c in df.columns if c not in order_by]
    starts = run_starts(df, order_by)
    at = F.col("__before") + F.col(quoted(order_by[-1])) - F.col("__least")
    # one row a run, sent to the rows instead of these to it
    return df.join(F.broadcast(starts), order_by[:-1]).select(at.cast("long").alias(name), *keep)
