"""Scale rules, checked on every registered query's physical plan, and the
salted fallback of the size-checked join under a hot key."""

import re

import pytest
from pyspark.sql import functions as F

from examflow.operators.joins import attach_small, measure_small
from examflow.plans.catalog import QUERIES

NAMES = sorted(QUERIES)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_plan_rules(spark, sf_small, name):
    p = _plan(QUERIES[name](spark, sf_small))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p  # no row-at-a-time Python UDF
    # every window is a top-k whose rows were limited map-side
    windows = re.findall(r"\bWindow \[", p)
    # number lines sort one bounded range at a time
    if windows and name != "zip_outputs":
        assert "WindowGroupLimit" in p and "Partial" in p, name


def test_salted_fallback_equals_broadcast_under_hot_key(spark):
    # one key holds a third of the rows
    big = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("subset"),
        F.col("id").cast("string").alias("id"),
    )
    small = big.select("subset").distinct().withColumn("v", F.length("subset"))
    wide = attach_small(big, small, ["subset"], "left", salt_by=F.col("id"))
    side = measure_small(small, max_rows=0)
    assert not side.broadcastable and side.rows == 51
    salted = attach_small(big, side, ["subset"], "left", salt_by=F.col("id"), rows_per_task=1000)
    p = _plan(salted)
    assert "BroadcastHashJoin" not in p or "__salt" in p
    key = lambda r: (r.subset, r.id, r.v)
    assert sorted(map(key, wide.collect())) == sorted(map(key, salted.collect()))
    # the hot key is spread over the salts
    per_salt = (
        big.where("subset = 'hot'")
        .select(F.pmod(F.xxhash64("id"), F.lit(16)).alias("s"))
        .groupBy("s").count().collect()
    )
    assert len(per_salt) == 16 and max(r["count"] for r in per_salt) < 2 * 10_000 / 16
