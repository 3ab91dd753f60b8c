"""Dates from free text, and calendar windows around an as-of day.

Dates are ``timestamp_ntz``, so no result depends on the session time zone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

# A small grammar: [weekday] date [time [am/pm]]. Date families are recognised by their pattern
# and rewritten to ISO, which the cast itself reads, so no row pays for a chain of failing
# parsers. Any other spelling is null and shows up in the data-quality table.
_TIME = r"(?:(?:[ T]|, ?)(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)(?: ?[AaPp]\.?[Mm]\.?)?)?"
_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?[.,]* +)?"
_HALF = r"(?i)\d ?[ap]\.?m\.?$"
_AFTERNOON = r"(?i)\d ?p\.?m\.?$"
_TWELVE = r"(?i)\b12(?::\d{2}){1,2}(?:\.\d+)? ?[ap]\.?m\.?$"
_YEAR_LAST = rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}){_TIME}$"
_MONTH_PART = [r"^(0?[1-9]|1[0-2])[-/.]", r"^\d{1,2}[-/.](0?[1-9]|1[0-2])[-/.]"]
_YEAR_ONLY = r"^\d{4}$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
_COMPACT_MINUTE = r"^(\d{4})(\d{2})(\d{2})[T ](\d{2}):?(\d{2})$"
_COMPACT_TIME = r"^(\d{4})(\d{2})(\d{2})[T ](\d{2}):?(\d{2}):?(\d{2})$"
_SHORT_YEAR = rf"^(\d{{1,2}})([-/])(\d{{1,2}})\2(\d{{2}}){_TIME}$"
_MONTHS = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_MONTH_FIRST = rf"(?i)^{_WEEKDAY}{_MONTHS}\.? +{_DAY}(?:, *| +)(\d{{4}}){_TIME}$"
_DAY_FIRST = rf"(?i)^{_WEEKDAY}{_DAY}[ -]{_MONTHS}(?:\.? |-|\.?, *)(\d{{4}}|\d{{2}}){_TIME}$"
_MONTH_YEAR = rf"(?i)^{_MONTHS}\.?(?: +|-)(\d{{4}})$"


def _ntz(text: str) -> str:
    return f"try_cast({text} AS TIMESTAMP_NTZ)"


def _rewrite(c: str, shape: str, to: str) -> str:
    return f"regexp_replace({c}, r'{shape}', '{to}')"


def _group(c: str, shape: str, i: int) -> str:
    return f"regexp_extract({c}, r'{shape}', {i})"


def _full_year(year: str) -> str:
    # two-digit years: 69-99 are 19yy, the rest 20yy
    century = f"CASE WHEN length({year}) = 4 THEN '' WHEN {year} >= '69' THEN '19' ELSE '20' END"
    return f"concat({century}, {year})"


def _named(c: str, shape: str, year: int, month: int, day: int | None) -> str:
    name = f"lower(substr({_group(c, shape, month)}, 1, 3))"
    number = f"(locate({name}, 'janfebmaraprmayjunjulaugsepoctnovdec') + 2) DIV 3"
    time = f", ' ', {_group(c, shape, 4)}" if day else ""
    return _ntz(
        f"concat({_full_year(_group(c, shape, year))}, '-', "
        f"CAST({number} AS STRING), '-', {_group(c, shape, day) if day else "'1'"}{time})"
    )


def parse_date(c: str, dtype: T.DataType | None = None) -> str:
    """Read a stripped date cell; a typed date or timestamp column is cut to midnight.

    Slashes, dots and two-digit years are month first, other dashes day first; if that is
    no date and the year has four digits, the other way round. A time of day may follow any
    full date; a weekday may stand before one with a month's name, and is not checked.
    """
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return f"CAST(CAST({c} AS DATE) AS TIMESTAMP_NTZ)"
    # The month is looked at first: a cast that fails on it raises inside the JVM, which
    # costs more than all the rest.
    month_first, day_first = (
        f"CASE WHEN {c} RLIKE r'{part}' THEN {_ntz(_rewrite(c, _YEAR_LAST, iso))} END"
        for part, iso in zip(_MONTH_PART, ("$4-$1-$3 $5", "$4-$3-$1 $5"))
    )
    short = f"concat({_full_year(_group(c, _SHORT_YEAR, 4))}, '-', " + (
        f"{_group(c, _SHORT_YEAR, 1)}, '-', {_group(c, _SHORT_YEAR, 3)}, ' ', {_group(c, _SHORT_YEAR, 5)})"
    )
    iso = rf"translate(regexp_replace({c}, r'(?i)(?<=\d) ?[ap]\.?m\.?$', ''), '/', '-')"
    # Hours that am and pm move; few cells end in them.
    hours = (
        f"CASE WHEN {c} RLIKE r'{_HALF}' THEN CASE WHEN {c} RLIKE r'{_AFTERNOON}' THEN 12 ELSE 0 END "
        f"- CASE WHEN {c} RLIKE r'{_TWELVE}' THEN 12 ELSE 0 END ELSE 0 END"
    )
    read = (
        f"CASE WHEN {c} IS NULL OR {c} = '' THEN NULL "
        rf"WHEN {c} RLIKE r'^\d{{4}}[-/]' THEN {_ntz(iso)} "
        f"WHEN {c} RLIKE r'{_YEAR_LAST}' THEN CASE WHEN NOT contains(left({c}, 3), '-') "
        f"THEN coalesce({month_first}, {day_first}) "
        f"ELSE coalesce({day_first}, {month_first}) END "
        f"WHEN {c} RLIKE r'{_COMPACT}' THEN {_ntz(_rewrite(c, _COMPACT, '$1-$2-$3'))} "
        f"WHEN {c} RLIKE r'{_COMPACT_MINUTE}' "
        f"THEN {_ntz(_rewrite(c, _COMPACT_MINUTE, '$1-$2-$3 $4:$5'))} "
        f"WHEN {c} RLIKE r'{_COMPACT_TIME}' "
        f"THEN {_ntz(_rewrite(c, _COMPACT_TIME, '$1-$2-$3 $4:$5:$6'))} "
        f"WHEN {c} RLIKE r'{_YEAR_ONLY}' THEN {_ntz(c)} "
        f"WHEN {c} RLIKE r'{_SHORT_YEAR}' THEN {_ntz(short)} "
        f"WHEN {c} RLIKE r'{_MONTH_FIRST}' THEN {_named(c, _MONTH_FIRST, 3, 1, 2)} "
        f"WHEN {c} RLIKE r'{_DAY_FIRST}' THEN {_named(c, _DAY_FIRST, 3, 2, 1)} "
        f"WHEN {c} RLIKE r'{_MONTH_YEAR}' THEN {_named(c, _MONTH_YEAR, 2, 1, None)} END"
    )
    return f"({read}) + make_dt_interval(0, {hours})"


def month_label(c: str) -> str:
    return f"date_format({c}, 'yyyy-MM')"


def current_quarter(as_of: dt.date) -> tuple[int, int]:
    """Calendar quarter number and year."""
    return (as_of.month - 1) // 3 + 1, as_of.year


def _add_months(day: dt.date, n: int) -> dt.date:
    months = day.year * 12 + day.month - 1 + n
    return dt.date(months // 12, months % 12 + 1, 1)


def month_bounds(as_of: dt.date) -> tuple[dt.date, dt.date]:
    lo = dt.date(as_of.year, as_of.month, 1)
    return lo, _add_months(lo, 1)


def quarter_bounds(as_of: dt.date) -> tuple[dt.date, dt.date]:
    quarter, year = current_quarter(as_of)
    lo = dt.date(year, quarter * 3 - 2, 1)
    return lo, _add_months(lo, 3)


def within(c: str, bounds: tuple[dt.date, dt.date]) -> str:
    """Half-open range on the column itself, so that the scan can use it. In a filter,
    null is outside."""
    lo, hi = (f"TIMESTAMP_NTZ '{d.isoformat()}'" for d in bounds)
    return f"({c} >= {lo} AND {c} < {hi})"


def in_month(c: str, as_of: dt.date) -> str:
    return within(c, month_bounds(as_of))


def in_quarter(c: str, as_of: dt.date) -> str:
    return within(c, quarter_bounds(as_of))
