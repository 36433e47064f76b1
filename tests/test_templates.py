"""Prompt rendering, option take-while, few-shot header and budget fold."""

from pyspark.sql import functions as F

from examflow.functions.constants import TOPIC_LINE
from examflow.functions.templates import (
    chat_wrap,
    clean_question,
    flat_prefill,
    messages,
    option_array,
    render_item,
    render_options,
    take_present,
)
from examflow.operators.prompts import budget_fold, build_prompts, build_prompts_budget

ITEM_SCHEMA = (
    "subset string, split string, seq long, id string, question string, A string, B string, "
    "C string, D string, E string, F string, answer string, explanation string"
)


def items_df(spark, rows):
    return spark.createDataFrame(rows, ITEM_SCHEMA)


def test_take_while_and_render(spark):
    df = spark.createDataFrame(
        [("a", "", None, "d", None, None)], "A string, B string, C string, D string, E string, F string"
    )
    r = df.select(
        take_present(option_array()).alias("p"), render_options(take_present(option_array())).alias("o")
    ).first()
    assert r.p == ["a", ""]
    assert r.o == "(A) a\n(B)"


def test_question_cleanup(spark):
    df = spark.createDataFrame([("a\n\n\n\nb",), ("a\n\n\nb",), (" x \n",)], "q string")
    got = [r[0] for r in df.select(clean_question(F.col("q"))).collect()]
    assert got == ["a\n\nb", "a\n\nb", "x"]


def _item(seq, split="test", expl=" why ", answer=" B "):
    return ("s1", split, seq, f"s1-{seq}", f"Q{seq}\n\nmore", "x", "y ", None, "z", None, None, answer, expl)


def test_render_styles(spark):
    df = items_df(spark, [_item(1)])
    r = df.select(
        render_item("bare", False, False).alias("bare"),
        render_item("suffix", False, False).alias("suf"),
        render_item("suffix", True, False).alias("sufcot"),
        render_item("bare", True, False).alias("barecot"),
        render_item("bare", False, True).alias("solved"),
        render_item("bare", True, True).alias("solvedcot"),
    ).first()
    body = "問題：Q1\nmore\n(A) x\n(B) y"
    assert r.bare == body
    assert r.barecot == body
    assert r.suf == body + "\n正確答案：("
    assert r.sufcot == body + "\n讓我們一步一步思考。\n"
    assert r.solved == body + "\n正確答案：(B)"
    assert r.solvedcot == body + "\n讓我們一步一步思考。\nwhy\n正確答案：(B)"


def test_null_explanation_is_empty_reasoning(spark):
    df = items_df(spark, [_item(1, expl=None)])
    r = df.select(render_item("bare", True, True).alias("p")).first()
    assert r.p.endswith("思考。\n\n正確答案：(B)")


def test_few_shot_header_order_and_k0(spark):
    rows = [_item(i, "dev") for i in (5, 3, 9, 1, 7, 11)] + [_item(100), _item(101)]
    df = items_df(spark, rows)
    test, dev = df.where("split='test'"), df.where("split='dev'")
    k3 = {r.id: r.prompt for r in build_prompts(test, dev, 3, "bare").collect()}
    k0 = {r.id: r.prompt for r in build_prompts(test, dev, 0, "bare").collect()}
    solved = lambda s: f"問題：Q{s}\nmore\n(A) x\n(B) y\n正確答案：(B)\n\n"
    item = "問題：Q100\nmore\n(A) x\n(B) y"
    assert k3["s1-100"] == TOPIC_LINE + "\n\n" + solved(1) + solved(3) + solved(5) + item
    assert k0["s1-100"] == TOPIC_LINE + "\n\n" + item


def test_too_few_dev_examples_fails(spark):
    import pytest

    rows = [_item(1, "dev"), _item(2, "dev"), _item(100)]
    df = items_df(spark, rows)
    with pytest.raises(Exception, match="exceeds the dev examples"):
        build_prompts(df.where("split='test'"), df.where("split='dev'"), 3, "bare").collect()


def test_subset_without_dev_is_zero_shot(spark):
    rows = [_item(100)]
    df = items_df(spark, rows)
    p = build_prompts(df.where("split='test'"), df.where("split='dev'"), 5, "bare").first().prompt
    assert p == TOPIC_LINE + "\n\n" + "問題：Q100\nmore\n(A) x\n(B) y"


def _fold(spark, start, lengths):
    shots = [(i + 1, f"<{i}>", n) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(
        [(start, shots)], "start long, shots array<struct<rank:int,text:string,n_tokens:int>>"
    )
    r = df.select(budget_fold(F.col("shots"), F.col("start")).alias("r")).first().r
    return r.left, r.text


def test_budget_fold_goldens(spark):
    assert _fold(spark, 100, [50, 80, 30]) == (20, "<0><2>")
    assert _fold(spark, 100, [100, 50]) == (50, "<1>")
    assert _fold(spark, -5, [1, 1]) == (-5, "")


def test_budget_header_is_subsequence_of_full(spark):
    rows = [_item(i, "dev") for i in (1, 2, 3, 4, 5)] + [_item(100)]
    df = items_df(spark, rows)
    test, dev = df.where("split='test'"), df.where("split='dev'")
    full = build_prompts(test, dev, 5, "bare").first().prompt
    for budget in (0, 60, 120, 200, 10_000):
        p = build_prompts_budget(test, dev, 5, budget, "\n正確答案：(").first()
        assert p.prompt.startswith(TOPIC_LINE) and p.prompt.endswith("(B) y")
        # every kept example appears in the full prompt, in order
        kept = p.prompt[len(TOPIC_LINE) + 2 : -len("問題：Q100\nmore\n(A) x\n(B) y")]
        pos = 0
        for block in [b for b in kept.split("\n\n") if b]:
            pos = full.find(block, pos)
            assert pos >= 0
    big = build_prompts_budget(test, dev, 5, 10_000, "").first().prompt
    assert big == full


def test_chat_and_messages(spark):
    df = spark.createDataFrame([("P",)], "p string")
    r = df.select(
        chat_wrap(F.col("p"), "\n正確答案：(").alias("c"),
        messages(F.col("p"), "\n讓我們一步一步思考。\n").alias("m"),
        flat_prefill(F.col("p"), "\n正確答案：(").alias("f"),
    ).first()
    assert r.c == "<|user|>\nP\n<|assistant|>\n\n正確答案：("
    assert [(m.role, m.content) for m in r.m] == [("user", "P"), ("assistant", "讓我們一步一步思考。")]
    assert r.f == "P正確答案：("
