"""Random responses from a hostile token alphabet: Spark's readers against
the DuckDB SQL readers (an independent implementation of the same rules),
and invariance of the scores to partitioning."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from examflow.functions.scorers import predict_cot, predict_direct, with_prediction
from examflow.plans import oracle as O

TOKENS = [
    "A", "B", "C", "D", "E", "F", "a", ")", "(", "Ａ", "）", " ", "\n", "\n\n", "\n\n\n",
    "　", " ", "\x1c", "\u0085", "\t", "正確答案", "正確答案：(", "不是正確答案", "不正確",
    "正確", "問題：", "\U0001f600", "因為", "x", "所以", "或", "答案",
]


@pytest.fixture(scope="module")
def responses():
    rng = random.Random(7)
    out = []
    for i in range(3000):
        n = rng.randint(0, 14)
        out.append((i, "".join(rng.choice(TOKENS) for _ in range(n))))
    out.append((len(out), None))
    return out


def test_spark_readers_match_duckdb(spark, responses):
    df = spark.createDataFrame(responses, "i int, r string")
    staged = with_prediction(with_prediction(df, "direct", "r", "d"), "cot", "r", "c")
    got = {r.i: (r.d, r.c) for r in staged.collect()}
    nested = {
        r.i: (r.d, r.c)
        for r in df.select("i", predict_direct(F.col("r")).alias("d"), predict_cot(F.col("r")).alias("c")).collect()
    }
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, r VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", responses)
    want = {
        i: (d, c)
        for i, d, c in con.execute(
            f"SELECT i, {O.predict_direct('r')}, {O.predict_cot('r')} FROM t"
        ).fetchall()
    }
    bad = [(i, responses[i][1], got[i], want[i]) for i in want if got[i] != want[i]]
    assert not bad, bad[:5]
    assert nested == got


def test_report_invariant_to_partitioning(spark, responses):
    from examflow.operators.scoring import report, score

    df = spark.createDataFrame(
        [(f"s{i % 3}", str(i), r, "ABCDEF"[i % 6]) for i, r in responses],
        "subset string, id string, full_response string, gold_answer string",
    )
    one = {tuple(r) for r in report(score(df.repartition(1), "cot")).collect()}
    many = {tuple(r) for r in report(score(df.repartition(13, "id"), "cot")).collect()}
    assert one == many
