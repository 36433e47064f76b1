"""First ``k`` rows per group without funnelling a hot group into one task.

``row_number() OVER (PARTITION BY g ORDER BY o) <= k`` is planned by Spark
with a partial ``WindowGroupLimit`` below the exchange: each map task keeps
only its own first ``k`` rows per group before anything is shuffled, so the
shuffle carries at most ``k x groups x map tasks`` rows whatever the skew.
We only ever apply it to a projection of the key columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_k(df: DataFrame, group: list[str], order: list[str], k: int, rank: str = "rank"):
    """Rows of ``df`` that are among the first ``k`` of their group, with their rank."""
    if k < 0:
        raise ValueError("k must be >= 0")
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked.where(F.col(rank) <= k)
