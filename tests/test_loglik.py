"""Log-softmax, arg-max choice and token slicing against NumPy/Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from examflow.operators import loglik as LL


def test_log_softmax_matches_numpy(spark):
    rng = np.random.default_rng(0)
    vecs = [rng.normal(size=7).tolist() for _ in range(5)]
    df = spark.createDataFrame([(i, v, i % 7) for i, v in enumerate(vecs)], "i int, v array<double>, t int")
    rows = df.orderBy("i").select(LL.log_softmax("v").alias("ls"), LL.token_logprob("v", "t").alias("lp")).collect()
    for (i, v), r in zip(enumerate(vecs), rows):
        x = np.array(v)
        ref = x - x.max() - np.log(np.exp(x - x.max()).sum())
        assert np.allclose(r.ls, ref)
        assert math.isclose(r.lp, ref[i % 7], rel_tol=1e-12)


@pytest.mark.parametrize("token", [5, 2, -1])
def test_out_of_range_token_raises(spark, token):
    df = spark.createDataFrame([([0.0, 1.0], token)], "v array<double>, t int")
    with pytest.raises(Exception, match="out of range"):
        df.select(LL.token_logprob("v", "t")).collect()
    table = spark.createDataFrame([("s", "1", "A", 0, token, [0.0, 1.0])],
                                  "subset string, id string, choice string, pos int, token_id int, logits array<double>")
    for path in (LL.choose_from_logits, lambda t: LL.choose(LL.choice_loglik(t))):
        with pytest.raises(Exception, match="out of range"):
            path(table).collect()


def test_too_few_logits_raise(spark):
    df = spark.createDataFrame([([[0.0, 1.0]], [0, 1, 1])], "s array<array<double>>, t array<int>")
    with pytest.raises(Exception, match="fewer logits"):
        df.select(LL.continuation_logprob("s", "t", 2)).collect()


def _choose(spark, rows):
    df = spark.createDataFrame(rows, "subset string, id string, choice string, loglik double")
    via_sums = {r.id: r.prediction for r in LL.choose(df).collect()}
    # the same decision straight from a logits table: logits [x, 0] with
    # token 0 give log-prob x - log(1 + e^x), monotone in x (NaN stays NaN)
    lg = df.select("subset", "id", "choice", F.lit(0).alias("pos"), F.lit(0).alias("token_id"),
                   F.array(F.col("loglik"), F.lit(0.0)).alias("logits"))
    direct = {r.id: r.prediction for r in LL.choose_from_logits(lg).collect()}
    assert via_sums == direct
    return via_sums


def test_argmax_ties_and_nan(spark):
    got = _choose(
        spark,
        [("s", "1", "A", -0.5), ("s", "1", "B", -0.5), ("s", "2", "A", -1.0), ("s", "2", "C", -0.1),
         ("s", "3", "B", float("nan")), ("s", "3", "A", 0.0)],
    )
    assert got == {"1": "A)", "2": "C)", "3": "B)"}


def test_sum_over_positions(spark):
    df = spark.createDataFrame(
        [("s", "1", "A", 0, 0, [0.0, 0.0]), ("s", "1", "A", 1, 0, [0.0, 0.0]), ("s", "1", "B", 0, 1, [0.0, 5.0])],
        "subset string, id string, choice string, pos int, token_id int, logits array<double>",
    )
    ll = {r.choice: r.loglik for r in LL.choice_loglik(df).collect()}
    assert math.isclose(ll["A"], 2 * math.log(0.5))
    assert math.isclose(ll["B"], 5 - math.log(1 + math.exp(5)))


def test_left_truncate_python_slice(spark):
    toks = list(range(6))
    ns = [3, 0, 6, 9, -2, -10, 1]
    df = spark.createDataFrame([(n,) for n in ns], "n int").withColumn("a", F.array(*[F.lit(t) for t in toks]))
    got = [r[0] for r in df.select(LL.left_truncate("a", F.col("n"))).collect()]
    assert got == [toks[-n:] for n in ns]


def test_continuation(spark):
    df = spark.createDataFrame([([1, 2], [1, 2, 3, 4]), ([1, 2, 3], [1, 2])], "c array<int>, w array<int>")
    assert [r[0] for r in df.select(LL.continuation("c", "w")).collect()] == [[3, 4], []]


def test_log_softmax_is_linear_in_vocabulary(spark):
    """A 50k-entry vocabulary must not be re-scanned per element."""
    import time

    v = 50_000
    df = spark.range(16, numPartitions=4).select(
        F.transform(F.sequence(F.lit(1), F.lit(v)), lambda i: F.sin(i * (F.col("id") + 1))).alias("x"),
        (F.col("id") * 7).cast("int").alias("t"),
    ).cache()
    df.count()
    t = time.perf_counter()
    got = df.select(LL.token_logprob("x", "t").alias("lp")).collect()
    assert time.perf_counter() - t < 30
    x = np.sin(np.arange(1, v + 1) * 1.0)
    assert math.isclose(got[0].lp, x[0] - x.max() - np.log(np.exp(x - x.max()).sum()), rel_tol=1e-9)


def test_shifted_continuation_logprob(spark):
    rng = np.random.default_rng(1)
    T, V, n = 6, 9, 2
    seq_logits = rng.normal(size=(T - 1, V))  # positions 0..T-2 predict tokens 1..T-1
    toks = rng.integers(0, V, size=T).tolist()
    df = spark.createDataFrame([(seq_logits.tolist(), toks)], "l array<array<double>>, t array<int>")
    got = df.select(LL.continuation_logprob("l", "t", n)).first()[0]
    ls = seq_logits - seq_logits.max(1, keepdims=True)
    ls = ls - np.log(np.exp(ls).sum(1, keepdims=True))
    want = sum(ls[t - 1, toks[t]] for t in range(T - n, T))
    assert math.isclose(got, want, rel_tol=1e-12)
