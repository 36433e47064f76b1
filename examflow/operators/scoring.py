"""Scoring responses and reporting accuracy per subset.

``score`` is a pure projection (no shuffle). ``report`` is one aggregation on
``subset``: Spark computes partial counts in every map task and merges a
handful of rows per subset, so a subset holding a third of all rows costs no
more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scorers import Mode, is_correct, with_prediction


def score(
    df: DataFrame,
    mode: Mode = "direct",
    response: str = "full_response",
    gold: str = "gold_answer",
) -> DataFrame:
    """Adds ``prediction`` (null when no letter is found) and ``correct`` (0/1)."""
    return with_prediction(df, mode, response, "prediction").withColumn(
        "correct", is_correct(F.col("prediction"), F.col(gold))
    )


def report(scored: DataFrame, order: bool = True, by: tuple[str, ...] = ("subset",)) -> DataFrame:
    """``subset, n, n_correct, avg_score`` — one row per subset seen.

    ``by=("run_id", "subset")`` reports many runs (models, settings) from one
    scan of their logs in the same single aggregation.
    """
    out = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("correct").cast("long").alias("n_correct"),
        F.avg("correct").alias("avg_score"),
    )
    return out.orderBy(*by) if order else out


def report_dict(report_df: DataFrame) -> dict[str, float | None]:
    """``{subset: avg_score}`` in ascending key order, for printing.

    Only the report (one row per subset) reaches the driver.
    """
    rows = report_df.select("subset", "avg_score").collect()
    return {r["subset"]: r["avg_score"] for r in sorted(rows, key=lambda r: r["subset"])}


def report_for(scored: DataFrame, requested: DataFrame, order: bool = True) -> DataFrame:
    """As ``report``, but every requested subset appears; an empty one has n = 0
    and a null mean (the division by zero is not raised)."""
    agg = report(scored, order=False)
    # both sides hold one row per subset; the planner (and AQE) pick the join
    out = requested.select("subset").distinct().join(agg, "subset", "left")
    out = out.select(
        "subset",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("n_correct", F.lit(0)).cast("long").alias("n_correct"),
        "avg_score",
    )
    return out.orderBy("subset") if order else out


def rescore(
    past_log: DataFrame,
    new_responses: DataFrame | None,
    mode: Mode = "direct",
    dedupe: bool = False,
) -> DataFrame:
    """Past log lines re-scored with the current mode, bag-unioned with new scores.

    Duplicated log lines count as many times as they occur (``dedupe=True``
    keeps one line per item and run instead, of past and new lines: the least
    response and gold answer), and the gold answer is the one that
    was logged.
    """
    cols = ["subset", "id", "full_response", "gold_answer"]
    if "run_id" in past_log.columns and (new_responses is None or "run_id" in new_responses.columns):
        cols.append("run_id")
    rows = past_log.select(*cols)
    if new_responses is not None:
        rows = rows.unionByName(new_responses.select(*cols))
    if dedupe:
        keys = [c for c in cols if c in ("subset", "id", "run_id")]
        rows = rows.groupBy(*keys).agg(
            F.min(F.struct("full_response", "gold_answer")).alias("one")
        ).select(*keys, "one.full_response", "one.gold_answer")
    return score(rows, mode)
