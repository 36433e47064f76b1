"""Joining a small, per-group table onto a large one.

Per-subset tables (few-shot headers, dev keys, first-failure positions) are
small, but their size is not fixed by the code: it grows with the number of
subsets and with the length of the texts. So we never broadcast them on
faith. ``attach_small`` materialises the small side once (cached on the
executors by the same job that measures it, so it is computed only once; a
lost block is simply recomputed from its lineage), checks it against a row
and a byte bound, and then either broadcasts it or, past the bound, joins by
a salted shuffle.

The salted shuffle is there for skew: a subset can hold a third of all rows,
and a plain shuffle join on ``subset`` would send all of them to one task.
Past the bound, a sketch of the large side's keys tells which subsets are hot, and only
these are salted, by weight (``skew.salted_join``); the small side's rows of all other
subsets are sent once.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import _context, parallelism
from .skew import ROWS_PER_TASK, salted_join

DEFAULT_MAX_ROWS = 100_000
DEFAULT_MAX_BYTES = 64 * 1024 * 1024
# small sides stay cached while recent; older ones are released (a plan that
# still refers to one just recomputes it)
_CACHED: deque[DataFrame] = deque()
MAX_CACHED = 64
SMALL_PARTITIONS = 64


@dataclass(frozen=True)
class SmallSide:
    df: DataFrame
    rows: int
    approx_bytes: int
    broadcastable: bool


def measure_small(
    small: DataFrame,
    max_rows: int = DEFAULT_MAX_ROWS,
    max_bytes: int = DEFAULT_MAX_BYTES,
    materialise: bool = True,
) -> SmallSide:
    """Materialise ``small`` and check it against a row and byte bound."""
    if materialise:
        # Spark keeps a cached plan's shuffle partitioning as is (AQE may not
        # coalesce it), so a small side would otherwise sit in hundreds of
        # empty partitions that every later read schedules; merge them
        # (narrow, no shuffle) before caching.
        small = small.coalesce(min(parallelism(small.sparkSession), SMALL_PARTITIONS)).cache()
        _CACHED.append(small)
        while len(_CACHED) > MAX_CACHED:
            old = _CACHED.popleft()
            # a frame of a stopped context is gone already
            if _context(old.sparkSession) is _context(small.sparkSession):
                old.unpersist()
    # One distributed aggregate over the materialised side (no limit: that
    # would add a single-partition exchange); only two numbers reach the driver.
    size_expr = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in small.columns]))))
    stats = small.agg(F.count(F.lit(1)).alias("n"), size_expr.alias("b")).first()
    rows, approx_bytes = int(stats["n"]), int(stats["b"] or 0)
    ok = rows <= max_rows and approx_bytes <= max_bytes
    return SmallSide(small, rows, approx_bytes, ok)


def attach_small(
    big: DataFrame,
    small: DataFrame | SmallSide,
    on: list[str],
    how: str = "left",
    salt_by: Column | None = None,
    max_rows: int = DEFAULT_MAX_ROWS,
    max_bytes: int = DEFAULT_MAX_BYTES,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``big JOIN small USING (on)`` with a size-checked broadcast.

    ``salt_by`` is a column of ``big`` that spreads the rows of one key
    (e.g. the item id); it is only used when the small side is too large to
    broadcast.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    side = small if isinstance(small, SmallSide) else measure_small(small, max_rows, max_bytes)
    if side.broadcastable:
        return big.join(F.broadcast(side.df), on, how)
    if salt_by is None:
        return big.join(side.df, on, how)
    return salted_join(big, side.df, on, how, salt_by, rows_per_task)
