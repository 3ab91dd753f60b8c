"""Exact duplicates by distributed most-significant-digit radix partitioning.

All rows start in one group. A round reads the next digit (a run of bytes) of every text
that is still open and splits each group by it, as one ``groupBy`` that sends a row per
distinct digit and task. A group that is down to one row, or whose texts have ended, is
final; the rest goes on with the bytes that follow. Equal means equal bytes: no digest
decides anything. Digits grow sixteenfold from round to round, so a text of n bytes takes
log16(n / 64) rounds, and each round only carries texts that share all bytes so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizmetrics.llm.shared import drop, numbered, prepare, store

FIRST_DIGIT = 64
GROWTH = 16


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> rest (bytes, A-Z lower-cased), sha (of those bytes); other columns pass."""
    for batch in batches:
        rest, sha = [], []
        for text in batch.column(0).cast(pa.binary()):
            data = (text.as_py() or b"").lower()  # of bytes: ASCII letters only
            rest.append(data)
            sha.append(hashlib.sha256(data).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rest, pa.binary()), pa.array(sha, pa.string()), *batch.columns[1:]],
            names=["rest", "sha", *batch.schema.names[1:]],
        )


def _digits(open_: DataFrame, width: int) -> DataFrame:
    """``open_`` with its next digit. ``rest`` is what follows it (null: nothing), so that no
    byte of a text goes through an exchange twice."""
    ended = F.length("rest") <= width
    return open_.select(
        "rid", "doc_id", "sha", "grp",
        F.substring("rest", 1, width).alias("digit"),
        ended.alias("ended"),
        F.when(~ended, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Group rows whose texts are the same after lower-casing A-Z; the largest id stays.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256`` and the
    ``carry`` columns. Defined cases: a null text equals an empty one; a null id ranks below
    all others, so ``keep_id`` is null only if all ids of the group are; of rows that repeat
    an id within a group exactly one is kept; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    prepare(spark)
    given = docs.select(
        F.col(text_col).alias("text"),
        F.col(id_col).alias("doc_id"),
        F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("carried"),
    )
    schema = T.StructType(
        [T.StructField("rest", T.BinaryType()), T.StructField("sha", T.StringType())]
        + given.schema.fields[1:]
    )
    rows = numbered(given.mapInArrow(_normal, schema), "exact-rows")
    open_ = rows.select("rid", "doc_id", "sha", "rest", F.lit(0).cast("long").alias("grp"))
    width, done = FIRST_DIGIT, []
    while True:
        digits = _digits(open_, width)
        keys = ["grp", "digit", "ended"]
        # Stored, so that the join has an exchange on both sides and can split a hot digit.
        groups = store(
            digits.groupBy(*keys).agg(
                F.count(F.lit(1)).alias("group_size"),
                F.max(F.struct("doc_id", "rid")).alias("last"),
                F.min("rid").alias("next"),
            ),
            "exact-groups",
        )
        final = F.col("ended") | (F.col("group_size") == 1)
        level = store(
            digits.join(groups, keys).select(
                "rid", "doc_id", "sha", "group_size", "last", final.alias("final"),
                F.col("next").alias("grp"),
                F.when(~final, F.col("rest")).alias("rest"),
            ),
            "exact-level",
        )
        drop(groups)
        if not done and not carry:
            drop(rows)
        done.append(level.filter("final"))
        open_ = level.filter("not final").select("rid", "doc_id", "sha", "rest", "grp")
        if open_.isEmpty():
            break
        width *= GROWTH
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    result = result.select(
        "rid", "doc_id",
        F.col("last.doc_id").alias("keep_id"),
        "group_size",
        (F.col("last.rid") == F.col("rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    if carry:
        result = result.join(rows.select("rid", "carried.*"), "rid")
    return result.drop("rid")
