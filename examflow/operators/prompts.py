"""Few-shot prompt assembly.

prompt = topic line + blank line + (solved dev examples, each followed by a
blank line) + the open question.

The dev examples of a subset are rendered once, concatenated in order into
a per-subset header and attached to the test rows by a size-checked
broadcast (``attach_small``), so the test side is never shuffled by subset.

With a token budget the examples are kept greedily in order: one is kept
while the budget left after it stays strictly positive, otherwise it is
skipped and the next (perhaps shorter) one is tried. The budget starts at
``max_length`` minus the tokens of the topic block, of the open question and
of the prompt template (chat wrapper and prefill), and may start negative.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MAX_FEW_SHOT, TOPIC_LINE
from ..functions.templates import render_item, topic_block
from .joins import attach_small
from .topk import first_k

TokenLen = Callable[[Column], Column]


def check_k(k: int, max_k: int | None = MAX_FEW_SHOT) -> int:
    if not isinstance(k, int) or k < 0 or (max_k is not None and k > max_k):
        raise ValueError(f"few-shot count must be an integer in [0, {max_k}], got {k!r}")
    return k


def shot_rows(dev: DataFrame, k: int, style: str = "bare", cot: bool = False) -> DataFrame:
    """``subset, rank, text``: the first ``k`` dev items by ``seq``, rendered solved."""
    text = F.concat(render_item(style, cot, with_answer=True), F.lit("\n\n"))
    return first_k(dev, ["subset"], ["seq"], k).select("subset", "rank", text.alias("text"))


def _guard_count(n: Column, k: int, value: Column) -> Column:
    """Fail the job (lazily, on the executors) when a subset has fewer than k examples."""
    msg = F.concat(
        F.lit("few-shot count "),
        F.lit(str(k)),
        F.lit(" exceeds the dev examples of subset "),
        F.col("subset"),
    )
    return F.when(n < k, F.raise_error(msg)).otherwise(value)


def shot_header(dev: DataFrame, k: int, style: str = "bare", cot: bool = False) -> DataFrame:
    """``subset, header``: the solved examples of each subset joined in order."""
    rows = shot_rows(dev, k, style, cot)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    header = F.array_join(F.transform(ordered, lambda s: s["text"]), "")
    return rows.groupBy("subset").agg(
        _guard_count(F.count(F.lit(1)), k, header).cast("string").alias("header")
    )


def shot_bank(
    dev: DataFrame, k: int, style: str = "bare", cot: bool = False, token_len: TokenLen = F.length
) -> DataFrame:
    """``subset, shots array<struct<rank, text, n_tokens>>`` ordered by rank."""
    rows = shot_rows(dev, k, style, cot).withColumn("n_tokens", token_len(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text", "n_tokens")))
    return rows.groupBy("subset").agg(
        _guard_count(F.count(F.lit(1)), k, ordered).alias("shots")
    )


def build_prompts(
    test: DataFrame,
    dev: DataFrame | None,
    k: int,
    style: str = "bare",
    cot: bool = False,
    topic: str = TOPIC_LINE,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``subset, seq, id, prompt, gold_answer`` (+ ``keep`` columns) for each test item."""
    check_k(k, None)
    item = render_item(style, cot, with_answer=False)
    base = test.select("subset", "seq", "id", item.alias("item_prompt"), "answer", *keep)
    if k > 0:
        base = attach_small(
            base, shot_header(dev, k, style, cot), ["subset"], "left", salt_by=F.col("id")
        )
        header = F.coalesce(F.col("header"), F.lit(""))
    else:
        header = F.lit("")
    prompt = F.concat(F.lit(topic_block(topic)), header, F.col("item_prompt"))
    return base.select(
        "subset", "seq", "id", prompt.alias("prompt"), F.col("answer").alias("gold_answer"), *keep
    )


def budget_fold(shots: Column, start: Column) -> Column:
    """``struct(left, text)`` after greedily keeping shots that fit strictly."""
    init = F.struct(start.cast("long").alias("left"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        after = acc["left"] - s["n_tokens"]
        return F.when(
            after > 0, F.struct(after.alias("left"), F.concat(acc["text"], s["text"]).alias("text"))
        ).otherwise(acc)

    return F.aggregate(F.coalesce(shots, F.array().cast(shots_type())), init, step)


def shots_type() -> str:
    return "array<struct<rank:int,text:string,n_tokens:int>>"


def build_prompts_budget(
    test: DataFrame,
    dev: DataFrame | None,
    k: int,
    max_length: int,
    template_text: str = "",
    style: str = "bare",
    cot: bool = False,
    topic: str = TOPIC_LINE,
    token_len: TokenLen = F.length,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """As ``build_prompts`` with the examples cut to a token budget.

    ``template_text`` is what the prompt will be wrapped in at generation
    time (chat template around an empty turn, plus the prefill).
    """
    check_k(k, None)
    if not isinstance(max_length, int) or isinstance(max_length, bool):
        raise ValueError("max_length must be an explicit integer when a budget is used")
    item = render_item(style, cot, with_answer=False)
    base = test.select("subset", "seq", "id", item.alias("item_prompt"), "answer", *keep)
    head = F.lit(topic_block(topic))
    # what is the same for all items is counted once
    fixed = test.sparkSession.range(1).select((token_len(head) + token_len(F.lit(template_text))).alias("n")).first()["n"]
    start = F.lit(max_length - fixed) - token_len(F.col("item_prompt"))
    if k > 0:
        bank = shot_bank(dev, k, style, cot, token_len).select(
            "subset", F.col("shots").cast(shots_type()).alias("shots")
        )
        base = attach_small(base, bank, ["subset"], "left", salt_by=F.col("id"))
        kept = budget_fold(F.col("shots"), start)
        header, left = kept["text"], kept["left"]
    else:
        header, left = F.lit(""), start.cast("long")
    prompt = F.concat(head, header, F.col("item_prompt"))
    return base.select(
        "subset",
        "seq",
        "id",
        prompt.alias("prompt"),
        left.alias("budget_left"),
        F.col("answer").alias("gold_answer"),
        *keep,
    )
