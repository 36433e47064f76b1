"""Joins on skewed keys: hot keys are salted, as many ways as they weigh.

A frequent-items sketch of the large side's keys (one narrow pass, merged from the
tasks' sketches) finds every key that weighs more than its error bound. Each such key is
split into ``ceil(rows / rows_per_task)`` salts; all others keep one, so that only the hot
keys' rows of the small side are copied. The salt of a row is a hash of a column of its
own (``spread``), hence the same in a retried task.

The table of hot keys has at most ``TRACKED / 4`` rows and is broadcast. A key below
the error bound (some 1/2,300 of all rows) is never split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACKED = 8192
ROWS_PER_TASK = 200_000
_KEY, _SALTS, _SALT = "__key", "__salts", "__salt"


def _key_of(on: list[str]) -> Column:
    # nulls and the borders of the columns stay apart
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in on]), {"ignoreNullFields": "false"})


def hot_keys(df: DataFrame, on: list[str], rows_per_task: int = ROWS_PER_TASK) -> dict[str, int]:
    """Key (as JSON text) -> salts, for the keys of more than ``rows_per_task`` rows."""
    keys = df.select(_key_of(on).alias(_KEY))
    top = keys.agg(F.expr(f"approx_top_k({_KEY}, {TRACKED // 4}, {TRACKED})")).first()[0] or []
    return {r["item"]: -(-r["count"] // rows_per_task) for r in top if r["count"] > rows_per_task}


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", spread: Column | None = None,
                rows_per_task: int = ROWS_PER_TASK, hot: dict[str, int] | None = None) -> DataFrame:
    """``big JOIN small USING (on)``; ``spread`` tells the rows of one key of ``big``
    apart (default: all its columns). ``hot`` as ``hot_keys`` gives it, if known."""
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    hot = hot_keys(big, on, rows_per_task) if hot is None else hot
    if not hot:
        return big.join(small, on, how)
    table = F.broadcast(big.sparkSession.createDataFrame(list(hot.items()), f"{_KEY} string, {_SALTS} long"))
    ways = F.coalesce(F.col(_SALTS), F.lit(1))
    spread = F.xxhash64(*big.columns) if spread is None else F.xxhash64(spread)
    left = big.withColumn(_KEY, _key_of(on)).withColumn("__spread", spread).join(table, _KEY, "left")
    left = left.withColumn(_SALT, F.pmod("__spread", ways)).drop(_KEY, _SALTS, "__spread")
    right = small.withColumn(_KEY, _key_of(on)).join(table, _KEY, "left")
    right = right.withColumn(_SALT, F.explode(F.sequence(F.lit(0).cast("long"), ways - 1))).drop(_KEY, _SALTS)
    return left.join(right, [*on, _SALT], how).drop(_SALT)
