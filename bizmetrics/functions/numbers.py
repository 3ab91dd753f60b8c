"""Money and ratios."""

from __future__ import annotations

from pyspark.sql import types as T

from bizmetrics import config
from bizmetrics.functions.display import fixed
from bizmetrics.functions.text import literal

# Only infinity is out of range: it counts as 0 and is reported. NaN is above it as well.
_INFINITY = "double('infinity')"
# Below this, four decimals of a double are exact enough to be summed as whole numbers.
_FINE = "1e15D"

# Up to 15 digits before the point: always in range. The wider pattern keeps out
# spellings that only the JVM takes for a number (1d, 0x1p3).
_COMMON = r"r'^[+-]?\d{1,15}(\.\d*)?$'"
_NUMBER = r"r'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"
_INFINITE = r"r'(?i)^[+-]?inf(inity)?$'"


def _plain(c: str) -> str:
    """Without currency signs, thousands separators and white space, wherever they are;
    an underscore between digits is a separator as well."""
    drop = literal(config.CURRENCY_SYMBOL + "$," + config.WHITESPACE)
    return rf"regexp_replace(translate({c}, {drop}, ''), r'(?<=\d)_(?=\d)', '')"


def money(c: str, dtype: T.DataType | None = None) -> str:
    """Amount as double; null, unreadable and non-finite text count as 0."""
    if isinstance(dtype, T.NumericType):
        value = f"CAST({c} AS DOUBLE)"
        return f"CASE WHEN abs({value}) < {_INFINITY} THEN {value} ELSE 0D END"
    plain = _plain(c)
    value = f"try_cast({plain} AS DOUBLE)"
    return (
        f"CASE WHEN {c} IS NULL OR {c} = '' THEN 0D "
        f"WHEN {c} RLIKE {_COMMON} THEN try_cast({c} AS DOUBLE) "
        f"WHEN {plain} RLIKE {_COMMON} THEN {value} "
        f"WHEN {plain} RLIKE {_NUMBER} AND abs({value}) < {_INFINITY} THEN {value} "
        "ELSE 0D END"
    )


def non_finite(c: str, dtype: T.DataType | None = None) -> str:
    """True for amounts that `money` sets to 0 for being infinite."""
    if isinstance(dtype, T.NumericType):
        return f"coalesce(abs(CAST({c} AS DOUBLE)) >= {_INFINITY}, false)"
    plain = _plain(c)
    return (
        f"CASE WHEN {c} IS NULL OR {c} RLIKE {_COMMON} THEN false "
        f"WHEN {plain} RLIKE {_INFINITE} THEN true WHEN {plain} RLIKE {_NUMBER} "
        f"THEN abs(try_cast({plain} AS DOUBLE)) >= {_INFINITY} ELSE false END"
    )


def clamp(c: str) -> str:
    """Negative amounts are entry errors and become 0."""
    return f"greatest({c}, 0D)"


def enforce_double(c: str) -> str:
    """Numeric or 0: unreadable, null and NaN become 0."""
    fill = f"{config.NUMERIC_FILL}D"
    return f"coalesce(nanvl(try_cast({c} AS DOUBLE), {fill}), {fill})"


def _where(*conditions: str | None) -> str:
    """Filter of an aggregate function."""
    given = [f"({c})" for c in conditions if c]
    return f" FILTER (WHERE {' AND '.join(given)})" if given else ""


def fine_total(c: str, where: str | None = None) -> str:
    """Exact decimal total of the amounts below 1e15, at four decimals; null if none.

    A double sum changes with partitioning, task retries and merge order; a decimal sum
    does not, but costs several times as much. So each amount is split into three whole
    numbers below 10 million, which are summed as longs (for up to 9e11 rows a group) and
    joined to a decimal once per group.
    """
    high = f"floor({c} / 1e8D)"
    middle = f"floor(({c} - {high} * 1e8D) / 100D)"
    low = f"CAST(rint(({c} - {high} * 1e8D - {middle} * 100D) * 10000D) AS BIGINT)"

    def part(value: str) -> str:
        fine = f"CASE WHEN abs({c}) < {_FINE} THEN {value} END"
        return f"CAST(sum({fine}){_where(where)} AS DECIMAL(20,0))"

    return f"({part(high)} * 100000000BD + {part(middle)} * 100BD + {part(low)} * 0.0001BD)"


def large_total(c: str, where: str | None = None) -> str:
    """Total of the rare amounts of 1e15 and more, which have no decimals to lose."""
    return f"sum({c}){_where(where, f'abs({c}) >= {_FINE}')}"


def both_totals(fine: str, large: str) -> str:
    """The two as one double; null if both are."""
    fine = f"CAST({fine} AS DOUBLE)"
    return f"coalesce({fine} + {large}, {fine}, {large})"


def exact_total(c: str, where: str | None = None) -> str:
    """Total as double, no amount left out; null when nothing was added."""
    return both_totals(fine_total(c, where), large_total(c, where))


def exact_sum(c: str, where: str | None = None) -> str:
    """`exact_total`; 0 when nothing was added."""
    return f"coalesce({exact_total(c, where)}, 0D)"


def exact_average(c: str) -> str:
    return f"{exact_total(c)} / count({c})"


# Digits of base 2**20, from 2**-20 on: so many hold amounts up to 2**80, and squares of them.
_DIGIT = 20
_VALUE_DIGITS = range(-1, 4)
_SQUARE_DIGITS = range(-1, 8)
_LARGEST = float(2**80 - 2**28)  # the double before 2**80


def _digit_total(value: str, digits: range, where: str | None) -> str:
    """Total of whole digits, each summed as longs and put together from the highest on."""
    parts = []
    for k in reversed(digits):
        unit = f"{float(2.0 ** (_DIGIT * k))!r}D"
        # remainders of doubles are exact, and floor would leave the range of longs
        digit = f"CAST(({value} / {unit}) % {2 ** _DIGIT}D - ({value} / {unit}) % 1D AS BIGINT)"
        parts.append(f"coalesce(sum({digit}){_where(where)}, 0) * {unit}")
    return "(" + " + ".join(parts) + ")"


def exact_moments(c: str, where: str) -> dict[str, str]:
    """``n``, ``total`` and ``squares`` of the non-negative values of a column, the same to the
    last bit whatever the order of the rows: every value, and its square as a double, is
    split into digits at fixed places, which are summed as whole numbers. What is beyond
    2**80 counts as that, what is below 2**-20 is cut."""
    value = f"least({c}, {_LARGEST!r}D)"
    return {
        "n": f"count({c}){_where(where)}",
        "total": _digit_total(value, _VALUE_DIGITS, where),
        "squares": _digit_total(f"({value} * {value})", _SQUARE_DIGITS, where),
    }


def round_half_even(c: str, digits: int) -> str:
    """Round the binary value itself, ties to even, as ``%.nf`` formatting does.

    ``round`` works on the printed decimal, ties up, and differs on values like 1.005.
    """
    return f"CAST({fixed(c, digits)} AS DOUBLE)"


def percent(part: str, whole: str) -> str:
    """Percentage with one decimal; 0 when there is nothing to divide by."""
    ratio = round_half_even(f"({part}) / ({whole}) * 100D", 1)
    return f"CASE WHEN ({whole}) > 0 THEN {ratio} ELSE 0D END"
