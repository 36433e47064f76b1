"""Responders that answer from given data.

Spark joins recorded calls (or option scores) to the items on a key; they travel to the
responder as a column beside the prompt (``respond(aside=...)``), so nothing is looked up
on the executors and a hot recording is split by weight (``skew.salted_join``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import ROWS_PER_TASK, salted_join


def recorded_calls(turns: DataFrame, key: str = "conv_id", role: str = "assistant") -> DataFrame:
    """``turns(<key>, turn, role, text)`` -> key, calls: one entry per turn in order, the
    text of a turn of ``role``, null (a call without an answer) for any other."""
    said = F.when(F.col("role") == role, F.col("text"))
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("text")))).alias("t"))
    return rows.select(key, F.transform("t", lambda x: x["text"]).alias("calls"))


def attach_recorded(items: DataFrame, recorded: DataFrame, key: Column, on: str = "conv_id",
                    spread: Column | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``items`` with the columns of ``recorded`` whose ``on`` equals ``key`` (null if none)."""
    keyed = items.withColumn(on, key)
    return salted_join(keyed, recorded, [on], "left", spread, rows_per_task).drop(on)


class Replay:
    """The k-th attempt gets the k-th recorded call of its row; a null one fails."""

    def __init__(self, **_):
        pass

    def attempt(self, request: dict, number: int) -> str:
        calls = request["calls"]
        if calls is None or number > len(calls):
            raise LookupError("no call is recorded")
        text = calls[number - 1]
        if text is None:
            raise ConnectionError("the recorded call has no answer")
        return text


class ReplayScores:
    """Option scores from a recorded array: the entry at the option's place in the
    alphabet plus the context's length, modulo the array's. Nothing recorded scores least."""

    def __init__(self, **_):
        pass

    def loglik(self, contexts: list[str], continuations: list[str], aside: list[dict]) -> list[float]:
        out = []
        for context, letter, row in zip(contexts, continuations, aside, strict=True):
            scores = row["scores"]
            none = scores is None or not len(scores)
            out.append(float("-inf") if none else float(scores[(ord(letter) - 65 + len(context)) % len(scores)]))
        return out
