"""Prompt rendering as Column expressions.

An item has ``question``, options ``A``..``F`` (nullable), ``answer`` and
``explanation``. Rendering:

* the question has each ``\\n\\n`` collapsed to ``\\n`` (one left-to-right
  pass) and is stripped;
* options are taken in order until the first missing one, rendered as
  ``(X) text`` one per line, and the whole block is stripped;
* a solved example ends with the reasoning (chain of thought) and/or the
  bracketed answer; an open question ends with nothing (``bare``) or with the
  opening of the answer/reasoning (``suffix``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ANSWER_OPEN, OPTION_LETTERS, QUESTION_TAG, STEP_BY_STEP, TOPIC_LINE
from .text import _c, py_strip

STYLES = ("bare", "suffix")


def clean_question(q) -> Column:
    return py_strip(F.replace(_c(q), F.lit("\n\n"), F.lit("\n")))


def option_array(prefix: str = "") -> Column:
    return F.array(*[F.col(f"{prefix}{x}") for x in OPTION_LETTERS])


def take_present(options: Column) -> Column:
    """Options up to (not including) the first null; an empty string is kept."""
    first_null = F.array_position(F.transform(options, lambda v: v.isNull()), True)
    n = F.when(first_null == 0, F.size(options)).otherwise(first_null - 1)
    return F.slice(options, 1, n)


def render_options(present: Column) -> Column:
    lines = F.transform(
        present, lambda v, i: F.concat(F.lit("("), F.char(i + 65), F.lit(") "), v)
    )
    return py_strip(F.array_join(lines, "\n"))


def render_item(
    style: str = "bare",
    cot: bool = False,
    with_answer: bool = False,
    prefix: str = "",
) -> Column:
    """The rendered text of one item (columns optionally prefixed)."""
    if style not in STYLES:
        raise ValueError(f"unknown template style {style!r}; expected one of {STYLES}")
    q = clean_question(F.col(f"{prefix}question"))
    opts = render_options(take_present(option_array(prefix)))
    parts: list[Column] = [F.lit(QUESTION_TAG), q, F.lit("\n"), opts]
    if with_answer:
        ans = py_strip(F.col(f"{prefix}answer"))
        if cot:
            reasoning = py_strip(F.coalesce(F.col(f"{prefix}explanation"), F.lit("")))
            parts += [F.lit(f"\n{STEP_BY_STEP}\n"), reasoning]
        parts += [F.lit(f"\n{ANSWER_OPEN}"), ans, F.lit(")")]
    elif style == "suffix":
        parts.append(F.lit(f"\n{STEP_BY_STEP}\n" if cot else f"\n{ANSWER_OPEN}"))
    return F.concat(*parts)


def topic_block(topic: str = TOPIC_LINE) -> str:
    return topic + "\n\n"


def with_prefill(prompt, prefill: str) -> Column:
    """Prompt followed by the prefill, kept verbatim."""
    return F.concat(_c(prompt), F.lit(prefill))


# A chat template as (text before the user turn, text after it, up to the
# assistant's turn). Replace with a model's own; this one is generic.
DEFAULT_CHAT_TEMPLATE = ("<|user|>\n", "\n<|assistant|>\n")


def chat_wrap(prompt, prefill: str, template: tuple[str, str] = DEFAULT_CHAT_TEMPLATE) -> Column:
    """One user turn wrapped by a chat template, then the verbatim prefill."""
    before, after = template
    return F.concat(F.lit(before), _c(prompt), F.lit(after + prefill))


def template_text(
    prefill: str, chat: bool = False, template: tuple[str, str] = DEFAULT_CHAT_TEMPLATE
) -> str:
    """What a prompt gets wrapped in at generation time (charged to the budget)."""
    return (template[0] + template[1] + prefill) if chat else prefill


def messages(prompt, prefill: str) -> Column:
    """``[user: prompt, assistant: prefill.strip()]`` for chat-style responders."""
    return F.array(
        F.struct(F.lit("user").alias("role"), _c(prompt).alias("content")),
        F.struct(F.lit("assistant").alias("role"), py_strip(F.lit(prefill)).alias("content")),
    )


def flat_prefill(prompt, prefill: str) -> Column:
    """``prompt + prefill.strip()`` for single-string responders."""
    return F.concat(_c(prompt), py_strip(F.lit(prefill)))
