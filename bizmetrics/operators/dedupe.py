"""Keep-first de-duplication that survives hot keys.

All forms cut each map task's copies to one row per key before the shuffle, so a key
that holds a third of the table still sends at most one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizmetrics.operators.filters import quoted

_RANK = "__copy_rank"
_HASH = "__key_hash"
_WORDS = 1 << 20  # of 64 bits, in the sketch of repeated keys: 8 MB
_BLOCK = 1 << 10  # words that are an array of their own


def key_expressions(keys: list[str], numeric_columns: list[str] = ()) -> list[str]:
    """Raw text compares as it is (`` A`` is not ``A``, nulls are equal); columns that
    hold only numbers compare by value, so ``1000`` is ``1000.0``."""
    return [
        f"try_cast({quoted(k)} AS DOUBLE)" if k in numeric_columns else quoted(k)
        for k in keys
    ]


def keep_first(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    numeric_columns: list[str] = (),
) -> DataFrame:
    """First row of each key in source order.

    The rank filter lets Spark put a group limit on both sides of the exchange, and
    columns the caller does not use never enter it. Without any key column present,
    whole rows are compared.
    """
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return drop_full_duplicates(df, order_by)
    window = Window.partitionBy(
        *[F.expr(k) for k in key_expressions(keys, numeric_columns)]
    ).orderBy(*[quoted(c) for c in order_by])
    return (
        df.withColumn(_RANK, F.row_number().over(window))
        .filter(f"{_RANK} = 1")
        .drop(_RANK)
    )


def keep_first_wide(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    numeric_columns: list[str] = (),
) -> DataFrame:
    """`keep_first` for rows that are wide, most of them the only ones of their key.

    A narrow pass finds the keys that come again, by hashes; what is none of theirs stays as
    it is, the others alone go through the exchange of whole rows. The source is read three
    times, once for its keys only.
    """
    present = [k for k in keys if k in df.columns]
    if not present:
        return keep_first(df, keys, order_by, numeric_columns)
    key = F.xxhash64(*[F.expr(e) for e in key_expressions(present, numeric_columns)])
    hashed = df.withColumn(_HASH, key)
    again = _in_sketch(_HASH, _repeated(hashed))
    copied = keep_first(hashed.filter(again).drop(_HASH), keys, order_by, numeric_columns)
    return hashed.filter(~again).drop(_HASH).unionByName(copied)


def _repeated(hashed: DataFrame) -> Column:
    """Sketch of the hashes that two rows or more have, a scalar: blocks of words, of which
    each hash sets a bit. Hashes that share a bit send rows through an exchange in vain, no
    more; the more keys are repeated, the more rows go there."""
    twice = hashed.groupBy(_HASH).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    bits = twice.selectExpr(f"{_word(_HASH)} AS word", f"shiftleft(1L, CAST({_HASH} & 63 AS INT)) AS bits")
    # every word is there, so that its place in the arrays is its number
    none = hashed.sparkSession.range(_WORDS).selectExpr("id AS word", "0L AS bits")
    words = bits.unionByName(none).groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
    blocks = words.groupBy(F.expr(f"word div {_BLOCK}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("words")
    )
    return blocks.agg(F.sort_array(F.collect_list(F.struct("block", "words")))["words"]).scalar()


def _word(column: str) -> str:
    return f"(shiftrightunsigned({column}, 6) & {_WORDS - 1})"


def _in_sketch(column: str, sketch: Column) -> Column:
    block = F.element_at(sketch, F.expr(f"CAST({_word(column)} div {_BLOCK} + 1 AS INT)"))
    bits = F.element_at(block, F.expr(f"CAST({_word(column)} % {_BLOCK} + 1 AS INT)"))
    return F.getbit(bits, F.expr(f"CAST({column} & 63 AS INT)")) == 1


def drop_full_duplicates(df: DataFrame, order_by: list[str] = ()) -> DataFrame:
    """Equal in every column but the source position."""
    compare = [c for c in df.columns if c not in order_by]
    if not order_by:
        return df.dropDuplicates()
    return keep_first(df, compare, list(order_by))


def collapse_copies(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    carry: list[str],
    numeric_columns: list[str] = (),
) -> DataFrame:
    """One row per key: the ``carry`` columns of its first row, and how many ``copies``.

    An aggregate, so counting needs no second pass and copies merge on the map side.
    """
    keys = [k for k in keys if k in df.columns] or [
        c for c in df.columns if c not in order_by
    ]
    key_columns = [
        F.expr(e).alias(f"__key{i}")
        for i, e in enumerate(key_expressions(keys, numeric_columns))
    ]
    first = F.min_by(
        F.struct(*[quoted(c) for c in carry]), F.struct(*[quoted(c) for c in order_by])
    )
    grouped = df.groupBy(*key_columns).agg(
        F.count(F.lit(1)).alias("copies"), first.alias("first")
    )
    return grouped.select("first.*", "copies")
