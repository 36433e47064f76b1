"""Row numbers, positional zips, salted joins and sequence scores against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from examflow.operators.loglik import continuation_scores
from examflow.operators.rowindex import number_line, ranges, row_numbers, zip_outputs
from examflow.operators.skew import hot_keys, salted_join


def _rows(spark, n=5000):
    rnd = random.Random(4)
    # a third of the keys is one value, some are null, some at the ends of a long
    keys = [None if i % 17 == 0 else 7 if i % 3 == 0 else rnd.choice([-(2**63), 2**63 - 1, rnd.randrange(-900, 900)]) for i in range(n)]
    return [(k, i, i % 5) for i, k in enumerate(keys)], spark.createDataFrame(
        [(k, i, i % 5) for i, k in enumerate(keys)], "k long, i long, w int").repartition(7)


def _order(rows):
    return sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1]))


def test_row_numbers_and_sums(spark):
    rows, df = _rows(spark)
    got = {r.i: r.row for r in row_numbers(df, ("k", "i"), rows=100).collect()}
    assert got == {r[1]: n for n, r in enumerate(_order(rows))}
    line, at = {}, 0
    for r in _order(rows):
        line[r[1]] = at
        at += r[2]
    assert {r.i: r.at for r in number_line(df, "k", F.col("i"), F.col("w"), "at", rows=100).collect()} == line
    # the hot key and the nulls are dealt to several parts of bounded size
    sizes = ranges(df, F.coalesce("k", F.lit(-(2**63))), F.col("i"), 100).groupBy("_r", "_s").count().collect()
    assert max(r["count"] for r in sizes) < 1000 and sum(r["count"] for r in sizes) == len(rows)
    assert row_numbers(df.limit(0), ("k", "i")).count() == 0
    assert [r.row for r in row_numbers(df.limit(1), ("k", "i")).collect()] == [0]


def test_zip_outputs(spark):
    rows, df = _rows(spark, 2000)
    outs = spark.createDataFrame([(i * 7 % 2001, i, f"t{i}") for i in range(2000)], "o long, p long, text string")
    got = {r.i: r.text for r in zip_outputs(df, outs, ("k", "i"), ("o", "p"), ["text"], rows=64).collect()}
    order = sorted(((i * 7 % 2001, i) for i in range(2000)))
    assert got == {a[1]: f"t{b[1]}" for a, b in zip(_order(rows), order, strict=True)}
    with pytest.raises(ValueError, match="1999 outputs for 2000 inputs"):
        zip_outputs(df, outs.where("p > 0"), ("k", "i"), ("o", "p"), ["text"])


def test_only_hot_keys_are_salted(spark):
    big = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), F.col("id").alias("i"))
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), (None, 4)], "k string, v int")
    hot = hot_keys(big, ["k"], 1000)
    assert hot == {'{"k":"hot"}': 7, '{"k":null}': 2}
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = salted_join(big, small, ["k"], how, F.col("i"), 1000)
        plain = big.join(small, ["k"], how)
        assert salted.columns == plain.columns
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))
    # the hot key's rows of the small side are copied, no others
    widest = salted_join(big, small, ["k"], "inner", F.col("i"), 1000, hot={'{"k":"hot"}': 7})
    sizes = widest.where("k = 'hot'").groupBy(F.pmod(F.xxhash64("i"), F.lit(7))).count().collect()
    assert len(sizes) == 7 and max(r["count"] for r in sizes) < 1200


def test_continuation_scores(spark):
    rnd = random.Random(2)
    logits, tokens, expect = [], [], {}
    for s, length, n in (("a", 6, 2), ("b", 3, 2), ("c", 40, 39), ("d", 4, 0)):
        vectors = [[rnd.uniform(-3, 3) for _ in range(5)] for _ in range(length)]
        ids = [rnd.randrange(5) for _ in range(length)]
        logits += [("x", s, p, v) for p, v in enumerate(vectors)]
        tokens += [("x", s, p, t, n) for p, t in enumerate(ids)]
        if n:
            expect[s] = sum(vectors[p - 1][ids[p]] - math.log(sum(map(math.exp, vectors[p - 1]))) for p in range(length - n, length))
    lt = spark.createDataFrame(logits, "subset string, id string, pos long, logits array<double>")
    tt = spark.createDataFrame(tokens, "subset string, id string, pos long, token_id int, n int")
    got = {r.id: r.loglik for r in continuation_scores(lt, tt).collect()}
    assert got.keys() == expect.keys() and all(got[k] == pytest.approx(expect[k]) for k in got)
    with pytest.raises(Exception, match="fewer logits"):
        continuation_scores(lt, tt.withColumn("n", F.when(F.col("id") == "b", F.lit(3)).otherwise(F.col("n")))).collect()
