"""Stripping, blanks, vocabulary lookups."""

from __future__ import annotations

from bizmetrics import config


def literal(s: str) -> str:
    """A SQL string literal."""
    escaped = s.replace("\\", "\\\\").replace("'", "\\'")
    plain = "".join(c if c.isprintable() else f"\\u{ord(c):04x}" for c in escaped)
    return f"'{plain}'"


_WHITESPACE = literal(config.WHITESPACE)


def _visible(char: str) -> str:
    """The first character is printable ASCII; a plain byte comparison."""
    return f"{char} >= '!' AND {char} < '\\u007f'"


def _bare(c: str) -> str:
    return f"{_visible(c)} AND {_visible(f'substr({c}, -1, 1)')}"


def strip(c: str) -> str:
    """Remove white space of any kind at both ends (``trim`` alone knows only spaces)."""
    t = f"trim({c})"
    return (
        f"CASE WHEN {_bare(c)} THEN {c} WHEN {_bare(t)} THEN {t} "
        f"ELSE btrim({t}, {_WHITESPACE}) END"
    )


def is_blank(c: str) -> str:
    """True for text without visible characters; null for null."""
    return f"(NOT ({_visible(f'ltrim({c})')}) AND btrim({c}, {_WHITESPACE}) = '')"


def missing(c: str) -> str:
    """Null or blank, never null itself."""
    return f"({c} IS NULL OR {is_blank(c)})"


def null_tokens(c: str, tokens: list[str] | None = None) -> str:
    """Map the spellings of "no value" to null; compares the cell exactly as it is."""
    words = ", ".join(literal(t) for t in tokens or config.NULL_TOKENS)
    return f"CASE WHEN {c} NOT IN ({words}) THEN {c} END"


def find(c: str, mapping: dict[str, str]) -> str:
    """Literal map lookup, null if absent. The maps are vocabularies of some dozen words."""
    pairs = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in mapping.items())
    return f"try_element_at(map({pairs}), {c})"


def unless_missing(c: str, value: str) -> str:
    """``unknown`` for a stripped cell without text."""
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN {literal(config.UNKNOWN)} ELSE {value} END"


def fill_categorical(c: str) -> str:
    """Null or blank becomes ``unknown``; any other value is left untouched."""
    return f"CASE WHEN {missing(c)} THEN {literal(config.UNKNOWN)} ELSE {c} END"


def title_case(c: str) -> str:
    """Capital after every non-letter (``n/a`` -> ``N/A``); ``initcap`` looks at spaces only."""
    runs = rf"regexp_extract_all(lower({c}), r'(\p{{L}}+|[^\p{{L}}]+)', 1)"
    return f"array_join(transform({runs}, w -> initcap(w)), '')"
