"""End-to-end runs: resume idempotence, strict prefix mode, overwrite,
probability-path requests, tokenizer counters, engine output order."""

import pytest
from pyspark.sql import functions as F

from examflow.functions.tokens import char_len, token_len_udf, whitespace_len
from examflow.operators import loglik as LL
from examflow.operators.respond import _in_request_order
from stand_ins import LetterResponder
from examflow.plans.evaluate import evaluate
from examflow.sources import testdata as td
from examflow.sources.runlog import read_log


def _report(df):
    return {r.subset: (r.n, r.n_correct) for r in df.collect()}


def test_resume_is_idempotent(spark, sf_small, scratch):
    sets = td.exam_item_sets(spark, sf_small)
    path = scratch("run")
    first = evaluate(spark, sets, LetterResponder, path, k=2, run_id="a")
    rep1 = _report(first.report)
    n_logged = read_log(spark, path).count()
    assert n_logged == sets.test.count()
    second = evaluate(spark, sets, LetterResponder, path, k=2, run_id="b")
    assert second.staged.count() == 0  # nothing left to answer
    assert _report(second.report) == rep1
    assert read_log(spark, path).count() == n_logged


def test_subset_selection_and_unknown(spark, sf_small, scratch):
    sets = td.exam_item_sets(spark, sf_small)
    res = evaluate(spark, sets, LetterResponder, scratch("run"), k=0, subsets="fr, de")
    assert set(_report(res.report)) == {"de", "fr"}
    as_list = evaluate(spark, sets, LetterResponder, scratch("run"), k=0, subsets=["fr", "de"])
    assert list(as_list.as_dict()) == ["de", "fr"] and as_list.as_dict() == res.as_dict()
    with pytest.raises(ValueError, match="not an available subset"):
        evaluate(spark, sets, LetterResponder, scratch("run"), k=0, subsets="fr,")


def test_strict_prefix_mode(spark, sf_small, scratch):
    class FailOnSeq:
        def __init__(self, **_):
            pass

        def __call__(self, prompt):
            if "問題：" in prompt and len(prompt) % 5 == 0:
                raise ConnectionError("down")
            return "A)"

    sets = td.exam_item_sets(spark, sf_small)
    path = scratch("run")
    with pytest.raises(RuntimeError, match="calls failed"):
        evaluate(spark, sets, FailOnSeq, path, k=0, strict=True)
    logged = read_log(spark, path).select("subset", "id")
    prompts = td.test_items(sets.all)
    from examflow.operators.prompts import build_prompts

    p = build_prompts(prompts, None, 0, "suffix").withColumn("bad", F.length("prompt") % 5 == 0)
    first_bad = {r.subset: r.m for r in p.where("bad").groupBy("subset").agg(F.min("seq").alias("m")).collect()}
    expect = {
        (r.subset, r.id)
        for r in p.collect()
        if r.subset not in first_bad or r.seq < first_bad[r.subset]
    }
    assert {(r.subset, r.id) for r in logged.collect()} == expect


def test_overwrite_replaces_requested_subsets(spark, sf_small, scratch):
    sets = td.exam_item_sets(spark, sf_small)
    path = scratch("run")
    evaluate(spark, sets, LetterResponder, path, k=0, run_id="a")
    evaluate(spark, sets, LetterResponder, path, k=0, subsets="fr", overwrite=True, run_id="b")
    runs = {(r.subset, r.run_id) for r in read_log(spark, path).select("subset", "run_id").distinct().collect()}
    assert ("fr", "b") in runs and ("fr", "a") not in runs and ("en", "a") in runs


def test_probability_backend_rejects_cot(spark, sf_small, scratch):
    sets = td.exam_item_sets(spark, sf_small)
    with pytest.raises(ValueError, match="chain-of-thought"):
        evaluate(spark, sets, LetterResponder, scratch("run"), mode="cot", backend="hf")


def test_loglik_requests_only_present_options(spark):
    df = spark.createDataFrame(
        [("s", "1", "P", "a", "b", None, "d", None, None)],
        "subset string, id string, prompt string, A string, B string, C string, D string, E string, F string",
    )
    rows = LL.loglik_requests(df, "\n正確答案：(").collect()
    assert [(r.choice, r.context, r.continuation) for r in rows] == [
        ("A", "P\n正確答案：(", "A"),
        ("B", "P\n正確答案：(", "B"),
    ]


def test_token_counters(spark):
    df = spark.createDataFrame([("a bc  d",), ("",), (None,)], "t string")
    r = df.select(
        char_len("t").alias("c"),
        whitespace_len("t").alias("w"),
        token_len_udf(lambda: (lambda s: s.split()))(F.col("t")).alias("u"),
    ).collect()
    assert [(x.c, x.w, x.u) for x in r] == [(7, 3, 3), (0, 0, 0), (None, None, None)]


def test_engine_outputs_sorted_by_numeric_request_id():
    assert _in_request_order([("10", "c"), ("2", "b"), ("1", "a")]) == ["a", "b", "c"]
    assert _in_request_order(["x", "y"]) == ["x", "y"]


def test_chat_api_backends_receive_messages(spark, sf_small, scratch):
    class EchoRoles:
        def __init__(self, **_):
            pass

        def __call__(self, msgs):
            roles = [m["role"] for m in msgs]
            assert roles == ["user", "assistant"]
            assert msgs[1]["content"] == "正確答案：("
            assert msgs[0]["content"].endswith(")") or "問題：" in msgs[0]["content"]
            return "B)"

    sets = td.exam_item_sets(spark, sf_small)
    res = evaluate(spark, sets, EchoRoles, scratch("run"), k=0, backend="anthropic", subsets="es")
    assert res.staged.where("error IS NOT NULL").count() == 0
    assert _report(res.report)["es"][0] == sets.test.where("subset = 'es'").count()


def test_probability_backend_with_chat_template(spark, sf_small, scratch):
    from examflow.functions.templates import DEFAULT_CHAT_TEMPLATE
    from examflow.operators.prompts import build_prompts
    from stand_ins import ModLoglikModel

    sets = td.exam_item_sets(spark, sf_small)
    path = scratch("run")
    evaluate(spark, sets, ModLoglikModel, path, k=2, backend="hf", chat_template=True, subsets="de")
    logged = {r.id: (r.full_response, r.prompt) for r in read_log(spark, path).collect()}
    prompts = build_prompts(sets.test.where("subset = 'de'"), sets.dev, 2, "bare", keep=tuple("ABCDEF"))
    before, after = DEFAULT_CHAT_TEMPLATE
    expect = {}
    for r in prompts.collect():
        ctx = before + r.prompt + after + "\n正確答案：("
        opts = []
        for c in "ABCDEF":
            if r[c] is None:
                break
            opts.append(c)
        best = max(opts, key=lambda c: (-((len(ctx) + ord(c)) % 5), -ord(c)), default=None)
        expect[r.id] = (best and best + ")", r.prompt)
    assert logged == expect


def test_isolated_runs_share_a_folder(spark, sf_small, scratch):
    sets = td.exam_item_sets(spark, sf_small)
    path = scratch("run")
    n = sets.test.where("subset = 'es'").count()
    a = evaluate(spark, sets, LetterResponder, path, k=0, subsets="es", run_id="k0", isolate_runs=True)
    b = evaluate(spark, sets, LetterResponder, path, k=2, subsets="es", run_id="k2", isolate_runs=True)
    # the second setting answered everything again and reports only itself
    assert b.staged.count() == n
    assert _report(a.report)["es"][0] == n and _report(b.report)["es"][0] == n
    assert read_log(spark, path).count() == 2 * n


def test_probability_item_without_options_is_logged_unanswered(spark, scratch):
    from stand_ins import ModLoglikModel

    schema = (
        "subset string, split string, seq long, id string, question string, A string, B string, "
        "C string, D string, E string, F string, answer string, explanation string"
    )
    items = spark.createDataFrame(
        [("s", "test", 1, "s-1", "q1", "x", "y", None, None, None, None, "A", "e"),
         ("s", "test", 2, "s-2", "q2", None, None, None, None, None, None, "A", "e")],
        schema,
    )
    path = scratch("run")
    res = evaluate(spark, items, ModLoglikModel, path, k=0, backend="hf")
    logged = {r.id: r.full_response for r in read_log(spark, path).collect()}
    assert set(logged) == {"s-1", "s-2"} and logged["s-2"] is None and logged["s-1"] in ("A)", "B)")
    assert _report(res.report)["s"][0] == 2


def test_budget_with_a_real_tokenizer_file(spark, sf_small, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import models, pre_tokenizers

    from examflow.functions.tokens import tokenizer_file_len, whitespace_len
    from examflow.operators.prompts import build_prompts_budget

    tok = tokenizers.Tokenizer(models.WordLevel({"[UNK]": 0}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "tok.json")
    tok.save(path)

    sets = td.exam_item_sets(spark, sf_small)
    test = sets.test.where("subset = 'es'")
    via_file = build_prompts_budget(test, sets.dev, 5, 300, "\n正確答案：(", token_len=tokenizer_file_len(path))
    native = build_prompts_budget(test, sets.dev, 5, 300, "\n正確答案：(", token_len=whitespace_len)
    a = {r.id: (r.prompt, r.budget_left) for r in via_file.collect()}
    b = {r.id: (r.prompt, r.budget_left) for r in native.collect()}
    assert a == b and len(a) == test.count()
    full = {r.id: r.prompt for r in build_prompts_budget(test, sets.dev, 5, 10**9, "").collect()}
    assert any(a[i][0] != full[i] for i in a)  # the budget binds for some items


def test_resume_with_parquet_log(spark, sf_small, scratch):
    sets = td.exam_item_sets(spark, sf_small)
    path = scratch("prun")
    first = evaluate(spark, sets, LetterResponder, path, k=1, subsets="de", log_format="parquet")
    second = evaluate(spark, sets, LetterResponder, path, k=1, subsets="de", log_format="parquet")
    assert second.staged.count() == 0
    assert first.as_dict() == second.as_dict()
    assert read_log(spark, path, fmt="parquet").count() == sets.test.where("subset = 'de'").count()


def test_reader_of_ones_own(spark, sf_small, scratch):
    sets = td.exam_item_sets(spark, sf_small)
    path = scratch("run")
    res = evaluate(spark, sets, LetterResponder, path, k=0, subsets="de", run_id="a",
                   reader=lambda response: F.lit("A"))
    log = read_log(spark, path)
    assert res.report.first()["n_correct"] == log.where("gold_answer = 'A'").count() > 0
