"""Category normalisers: stripped free text in, vocabulary out."""

from __future__ import annotations

from bizmetrics import config
from bizmetrics.functions.text import (
    find,
    literal,
    strip,
    title_case,
    unless_missing,
)


def sector(c: str, aliases: dict[str, str] | None = None) -> str:
    """Lower case, only letters, digits, ``_ & /`` and spaces, then the alias table.

    Text made of other characters only ends as ``''``, not as ``unknown``. Aliases hold
    none of the removed characters, so a direct hit needs no clean-up.
    """
    aliases = aliases or config.SECTOR_ALIASES
    word = strip(
        rf"regexp_replace(lower({c}), r'(?U)[^\p{{L}}\p{{N}}_\s\x1c-\x1f&/]', '')"
    )
    return unless_missing(
        c, f"coalesce({find(f'lower({c})', aliases)}, {find(word, aliases)}, {word})"
    )


def deal_status(c: str) -> str:
    """Known words map to one spelling; others keep their own."""
    return unless_missing(
        c, f"coalesce({find(f'lower({c})', config.DEAL_STATUSES)}, {c})"
    )


def probability(c: str) -> str:
    return unless_missing(
        c, f"coalesce({find(f'lower({c})', config.PROBABILITIES)}, {title_case(c)})"
    )


def execution_status(c: str) -> str:
    known = find(f"lower({c})", config.EXECUTION_STATUSES)
    value = (
        f"CASE WHEN startswith(lower({c}), {literal(config.EXECUTED_UNTIL_PREFIX)}) "
        f"THEN {literal(config.EXECUTED_UNTIL)} ELSE coalesce({known}, {c}) END"
    )
    return unless_missing(c, value)
