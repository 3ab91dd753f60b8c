"""User questions as a table: junk detection and intent extraction, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizmetrics import config
from bizmetrics.functions.text import literal, strip
from bizmetrics.operators.filters import quoted

# a JSON object with at most one level of nesting; possessive, so it cannot backtrack
_OBJECT = r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"


def is_gibberish(text: str) -> str:
    """Too short, no letters, one character five times or more, one or two small
    letters, or six and more characters without a vowel. Expects stripped text."""
    junk = " OR ".join(f"{text} RLIKE r'{p}'" for p in config.GIBBERISH_PATTERNS)
    return f"(length({text}) < {config.MIN_QUESTION_LENGTH} OR {junk})"


def flag_gibberish(questions: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``nonsensical`` and, for flagged rows, the ``suggestions`` to offer."""
    offer = ", ".join(literal(s) for s in config.SUGGESTED_QUESTIONS)
    return (
        questions.withColumn("__text", F.expr(strip(quoted(column))))
        .withColumn("nonsensical", F.expr(is_gibberish("__text")))
        .drop("__text")
        .withColumn("suggestions", F.expr(f"CASE WHEN nonsensical THEN array({offer}) END"))
    )


def _is_json(c: str) -> str:
    # A parser stops after the first value; inside brackets trailing text is an error.
    listed = f"concat('[', {c}, ']')"
    return f"(try_parse_json({listed}) IS NOT NULL AND json_array_length({listed}) = 1)"


def extract_intent(replies: DataFrame, column: str = "text") -> DataFrame:
    """Adds the intent fields found in a free text, and ``source``, where they came from.

    The whole text if it is JSON, else the first fenced block, else the first object
    that parses. A text without any, or with JSON that is no object, is a general query
    described by the text itself.
    """
    block = strip("regexp_replace(get(split(__text, '```'), 1), r'^json', '')")
    objects = f"regexp_extract_all(__text, r'{_OBJECT}', 0)"
    found = (
        replies.withColumn("__text", F.expr(strip(quoted(column))))
        .withColumn("__block", F.expr(block))
        .withColumn(
            "__found",
            F.expr(
                f"CASE WHEN {_is_json('__text')} THEN struct('whole' AS source, __text AS json) "
                f"WHEN {_is_json('__block')} THEN struct('fenced' AS source, __block AS json) "
                "ELSE struct('embedded' AS source, "
                f"get(filter({objects}, o -> {_is_json('o')}), 0) AS json) END"
            ),
        )
    )
    schema = ", ".join(f"{f} string" for f in config.INTENT_FIELDS)
    parsed = found.withColumn(
        "__intent",
        F.expr(
            "CASE WHEN startswith(__found.json, '{') "
            f"THEN from_json(__found.json, '{schema}') END"
        ),
    )
    fields = {f: F.expr(f"__intent.{f}") for f in config.INTENT_FIELDS}
    # an object without a metric is a general query as well
    fields["metric"] = F.expr(
        f"coalesce(__intent.metric, {literal(config.DEFAULT_METRIC)})"
    )
    fields["description"] = F.expr(
        "CASE WHEN __intent IS NULL THEN __text ELSE __intent.description END"
    )
    fields["source"] = F.expr(
        "CASE WHEN __intent IS NULL THEN 'default' ELSE __found.source END"
    )
    return parsed.withColumns(fields).drop("__text", "__block", "__found", "__intent")


def interpret(
    exchanges: DataFrame, question: str = "question", reply: str = "reply"
) -> DataFrame:
    """The intent of each question, from the model's reply to it: ``nonsensical``, the intent
    fields, ``suggestions`` and ``source`` beside the columns of ``exchanges``.

    A question that is junk, or whose reply says so, gets the full nonsensical result: that
    metric, no sector, period or status, the stripped question as its description, and the
    questions to offer instead. Without a reply a question is a general query, described by
    itself.
    """
    asked = exchanges.withColumn("__question", F.expr(strip(quoted(question))))
    asked = asked.withColumn("__junk", F.expr(f"coalesce({is_gibberish('__question')}, true)"))
    # Reading a reply takes long expressions: the text is replaced where it plays no part.
    asked = asked.withColumn("__reply", F.expr(f"CASE WHEN NOT __junk THEN {quoted(reply)} END"))
    found = extract_intent(asked, "__reply").withColumn(
        "nonsensical", F.expr(f"__junk OR metric = {literal(config.NONSENSICAL_METRIC)}")
    )
    offer = ", ".join(literal(s) for s in config.SUGGESTED_QUESTIONS)
    fields = {
        "metric": f"CASE WHEN nonsensical THEN {literal(config.NONSENSICAL_METRIC)} ELSE metric END",
        "description": "CASE WHEN nonsensical OR __reply IS NULL THEN __question ELSE description END",
        "source": "CASE WHEN __junk THEN 'question' ELSE source END",
        "suggestions": f"CASE WHEN nonsensical THEN array({offer}) END",
        **{
            f: f"CASE WHEN NOT nonsensical THEN {f} END"
            for f in config.INTENT_FIELDS
            if f not in ("metric", "description")
        },
    }
    return found.withColumns({n: F.expr(e) for n, e in fields.items()}).drop(
        "__question", "__junk", "__reply"
    )
