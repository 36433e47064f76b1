"""Places in a total order, without one task for all rows.

``ranges`` deals rows to ascending ranges of a key, a bounded number of rows in each;
``number_line`` adds the sum of a weight over all rows before (a row number, for weight
1); ``zip_outputs`` joins two tables by their row numbers.

The cuts come from one approximate-percentile pass over the key. A key that fills ranges
of its own is split along the tie-breaker, so a hot key is not one task's. Only a row a
range (at most three times ``RANGES``) is summed in one place or broadcast.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 65_536
RANGE_ROWS = 4096


def ranges(df: DataFrame, key: Column, tie: Column, rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``_k`` (``key``) and ``_t`` (``tie``), longs without nulls, and ``_r``, ``_s``:
    (_r, _s) ascends with (_k, _t), and has some ``rows`` rows where the ties of a hot key
    are spread evenly (row numbers, ids, hashes)."""
    return _dealt(df, key, tie, rows)[0]


def _dealt(df: DataFrame, key: Column, tie: Column, rows: int) -> tuple[DataFrame, bool]:
    """The dealt rows, and whether there is more than one range."""
    df = df.withColumn("_k", key).withColumn("_t", tie)
    n = min(df.count() // rows + 1, RANGES)
    points = df.agg(F.percentile_approx("_k", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else None
    seen = Counter(points or [])
    hot = sorted(v for v, m in seen.items() if m > 1)
    cuts = sorted(set(seen) | {v + 1 for v in hot if v < 2**63 - 1})
    if not cuts:
        return df.withColumn("_r", F.lit(0).cast("long")).withColumn("_s", F.lit(0)), False
    longs = lambda x: F.lit(x).cast("array<long>")
    halves = [2**k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    # number of cuts at or under the key, by halving
    place = F.aggregate(longs(halves), F.lit(0).cast("long"), lambda lo, h: F.when(
        (lo + h <= len(cuts)) & (F.get(longs(cuts), (lo + h - 1).cast("int")) <= F.col("_k")), lo + h).otherwise(lo))
    df = df.withColumn("_r", place)
    if not hot:
        return df.withColumn("_s", F.lit(0)), True
    # a hot key's ties are cut evenly between the least and the largest: a row a hot key
    ends = {r["_k"]: r for r in df.filter(F.col("_k").isin(hot)).groupBy("_k").agg(
        F.min("_t").alias("lo"), F.max("_t").alias("hi")).collect()}
    at = F.col("_r").cast("int")
    parts = F.get(longs([1] + [seen[v] + 1 if v in ends else 1 for v in cuts]), at)
    lows = F.get(longs([0] + [ends[v]["lo"] if v in ends else 0 for v in cuts]), at)
    highs = F.get(longs([0] + [ends[v]["hi"] if v in ends else 0 for v in cuts]), at)
    wide = lambda c: c.cast("double")
    part = F.floor((wide(F.col("_t")) - wide(lows)) * parts / (wide(highs) - wide(lows) + 1))
    return df.withColumn("_s", F.when(parts > 1, F.greatest(F.least(part, parts - 1), F.lit(0))).otherwise(0).cast("int")), True


def number_line(df: DataFrame, key: str, tie: Column, weight: Column, out: str, rows: int = RANGE_ROWS,
                then: tuple[str, ...] = ()) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over all rows before, by (``key``, ``tie``,
    ``then``), null keys first."""
    dealt, several = _dealt(df.withColumn("_w", weight), F.coalesce(F.col(key), F.lit(-(2**63))), tie, rows)
    before = Window.orderBy("_r", "_s").rowsBetween(Window.unboundedPreceding, -1)
    # a row a range: at most three times RANGES
    sums = dealt.groupBy("_r", "_s").agg(F.sum("_w").alias("_sum")).withColumn(
        "_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_r", "_s").orderBy("_k", "_t", *then).rowsBetween(Window.unboundedPreceding, -1)
    here = dealt.withColumn("_here", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    if not several:
        return here.withColumn(out, F.col("_here")).drop("_r", "_s", "_k", "_t", "_w", "_here")
    return here.join(F.broadcast(sums), ["_r", "_s"]).withColumn(out, F.col("_before") + F.col("_here")).drop(
        "_r", "_s", "_k", "_t", "_w", "_before", "_here")


def row_numbers(df: DataFrame, order: tuple[str, str], out: str = "row", rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... by two long columns."""
    return number_line(df, order[0], F.col(order[1]), F.lit(1), out, rows)


def zip_outputs(inputs: DataFrame, outputs: DataFrame, input_order: tuple[str, str], output_order: tuple[str, str],
                columns: list[str], rows: int = RANGE_ROWS) -> DataFrame:
    """``inputs`` with ``columns`` of the output in the same place, for outputs that carry
    no key. Tables of different length raise, as a shift would go unseen."""
    n, m = inputs.count(), outputs.count()
    if n != m:
        raise ValueError(f"{m} outputs for {n} inputs")
    left = row_numbers(inputs, input_order, "__row", rows)
    right = row_numbers(outputs, output_order, "__row", rows).select("__row", *columns)
    return left.join(right, "__row").drop("__row")
