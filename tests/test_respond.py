"""Responder contract, retries, reconciliation and prefix commit."""

import pytest
from pyspark.sql import functions as F

from examflow.operators.respond import prefix_commit, reconcile, respond
from stand_ins import BatchLetterResponder, FlakyResponder, LetterResponder


def _prompts(spark, n=40):
    return spark.createDataFrame(
        [(f"s{i % 3}", str(i), "p" * (i + 1)) for i in range(n)], "subset string, id string, prompt string"
    )


def test_letter_responder_keyed(spark):
    out = respond(_prompts(spark), LetterResponder, partitions=4).collect()
    assert len(out) == 40
    for r in out:
        n = int(r.id) + 1
        assert r.full_response == chr(65 + n % 4) + ")" and r.error is None and r.attempts == 1


def test_batch_responder(spark):
    out = respond(_prompts(spark), BatchLetterResponder, carry=("prompt",)).collect()
    assert all(r.full_response == chr(65 + len(r.prompt) % 4) + ")" for r in out)


def test_retries_and_errors(spark):
    out = respond(_prompts(spark), FlakyResponder, max_tries=2).collect()
    for r in out:
        fails = len("p" * (int(r.id) + 1)) % 3
        if fails < 2:
            assert r.error is None and r.attempts == fails + 1
        else:
            assert r.full_response is None and "transient" in r.error and r.attempts == 2


def test_batch_length_mismatch_raises(spark):
    # defined here so that it is pickled by value for the Python workers
    class _Short:
        def __init__(self, **_):
            pass

        def batch(self, prompts):
            return prompts[:-1]

    with pytest.raises(Exception, match="outputs for"):
        respond(_prompts(spark), _Short).collect()


def test_reconcile(spark):
    exp = spark.createDataFrame([("a",), ("a",), ("b",)], "subset string")
    got_df = spark.createDataFrame([("a", None), ("a", "boom"), ("b", None)], "subset string, error string")
    got = {r.subset: (r.n_expected, r.n_answered, r.n_missing) for r in reconcile(exp, got_df).collect()}
    assert got == {"a": (2, 1, 1), "b": (1, 1, 0)}


def test_prefix_commit_golden(spark):
    df = spark.createDataFrame(
        [("s", "1", 1, False), ("s", "2", 2, False), ("s", "3", 3, True), ("s", "4", 4, False),
         ("t", "5", 1, False)],
        "subset string, id string, seq long, failed boolean",
    )
    got = sorted(r.id for r in prefix_commit(df).collect())
    assert got == ["1", "2", "5"]


def test_threads_keep_order_and_results(spark):
    one = {r.id: r.full_response for r in respond(_prompts(spark), LetterResponder).collect()}
    many = {r.id: r.full_response for r in respond(_prompts(spark), LetterResponder, threads=8).collect()}
    assert one == many


def test_call_timeout_counts_as_failed_attempt(spark):
    class Slow:
        def __init__(self, **_):
            pass

        def __call__(self, prompt):
            import time

            if len(prompt) % 2 == 0:
                time.sleep(3)
            return "A)"

    out = respond(_prompts(spark, 6), Slow, max_tries=1, call_timeout=0.5).collect()
    for r in out:
        if (int(r.id) + 1) % 2 == 0:
            assert r.full_response is None and "Timeout" in r.error
        else:
            assert r.full_response == "A)"


def test_cut_at_stops(spark):
    from pyspark.sql import functions as F

    from examflow.functions.text import cut_at_stops

    df = spark.createDataFrame([("ab問題：cd###e",), ("x###y問題：z",), ("plain",)], "t string")
    got = [r[0] for r in df.select(cut_at_stops(F.col("t"), ["問題：", "###"])).collect()]
    assert got == ["ab", "x", "plain"]


def test_hung_calls_fail_alone(spark):
    """Calls that hang cost neither the calls beside them nor those after them."""
    import time

    class Hangs:
        def __init__(self, **_):
            pass

        def __call__(self, prompt):
            if prompt in ("p0", "p1"):
                time.sleep(30)
            return "A)"

    df = spark.createDataFrame([("s", str(i), f"p{i}") for i in range(10)], "subset string, id string, prompt string").coalesce(1)
    rows = {r.id: r for r in respond(df, Hangs, call_timeout=1.0, threads=1).collect()}
    assert {i for i, r in rows.items() if r.error} == {"0", "1"}
    assert all(r.full_response == "A)" for i, r in rows.items() if i not in ("0", "1"))


def test_refused_key_is_not_retried(spark):
    class Refuses:
        def __init__(self, **_):
            pass

        def __call__(self, prompt):
            raise PermissionError("bad key")

    df = spark.createDataFrame([("s", "1", "p")], "subset string, id string, prompt string")
    assert respond(df, Refuses, max_tries=50).first().attempts == 1


def test_batches_of_long_prompts_are_small(spark):
    class Sizes:
        def __init__(self, **_):
            pass

        def batch(self, prompts):
            return [str(sum(map(len, prompts)))] * len(prompts)

    rows = spark.range(0, 10_000, 1, 1).select(F.lit("s").alias("subset"), F.col("id").cast("string").alias("id"),
                                               F.repeat(F.lit("x"), 2000).alias("prompt"))
    assert max(int(r.full_response) for r in respond(rows, Sizes).collect()) < 10_000_000
