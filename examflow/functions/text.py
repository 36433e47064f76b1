"""String predicates and extractors as native Column expressions.

All of these stay inside the JVM (whole-stage codegen); none is a UDF.
Positions follow Python's convention of counting code points, which is what
``length``/``instr``/``substring`` do in Spark (``regexp_instr`` counts UTF-16
units instead and is therefore not used).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (
    CORRECT,
    CORRECT_ANSWER,
    INCORRECT,
    NOT_CORRECT_ANSWER,
    PY_WHITESPACE,
    QUESTION_TAG,
)

# a letter immediately followed by a closing bracket, else any letter
_LETTER_BRACKET = r"([A-F])\)"
_LETTER = r"[A-F]"
_FORMAT_LETTER = r"[A-E]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(c) -> Column:
    """Python ``str.strip()``: trims the 29 Unicode whitespace code points."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def is_answer_format(c) -> Column:
    """Does a piece of text read like an answer? Rules apply in order."""
    c = _c(c)
    return (
        F.when(c.contains(NOT_CORRECT_ANSWER), F.lit(False))
        .when(c.contains(CORRECT_ANSWER), F.lit(True))
        .when(c.contains(INCORRECT), F.lit(False))
        .when(c.contains(CORRECT), F.lit(True))
        .otherwise(c.rlike(_FORMAT_LETTER))
    )


def find_choice(c) -> Column:
    """The chosen option letter: the first ``X)``, else the first ``X``; null if none."""
    c = _c(c)
    return F.coalesce(
        F.nullif(F.regexp_extract(c, _LETTER_BRACKET, 1), F.lit("")),
        F.nullif(F.regexp_extract(c, _LETTER, 0), F.lit("")),
    )


def find_choice_pos(c) -> Column:
    """0-based code-point position of the letter ``find_choice`` picks; -1 if none."""
    c = _c(c)
    before_bracketed = F.length(F.regexp_extract(c, r"(?s)^(.*?)[A-F]\)", 1))
    before_any = F.length(F.regexp_extract(c, r"(?s)^(.*?)[A-F]", 1))
    return (
        F.when(c.rlike(r"[A-F]\)"), before_bracketed)
        .when(c.rlike(_LETTER), before_any)
        .otherwise(F.lit(-1))
    )


def cut_at_question(c) -> Column:
    """Text before the first question tag (the generation stop sequence)."""
    return F.substring_index(_c(c), QUESTION_TAG, 1)


def cut_at_stops(c, stops: list[str]) -> Column:
    """Text before the earliest of several stop sequences."""
    out = _c(c)
    for stop in stops:
        out = F.substring_index(out, stop, 1)
    return out


def replace_model_slash(c) -> Column:
    return F.replace(_c(c), F.lit("/"), F.lit("_"))


def is_awq(model) -> Column:
    """Engine hint: the model name mentions AWQ quantisation (case-insensitive)."""
    return F.lower(_c(model)).contains("awq")
