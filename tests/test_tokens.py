"""Token spans, cut contexts and token budgets against the tokenizers library."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from examflow.functions.constants import TOPIC_LINE
from examflow.functions.tokens import FileTokenizer, PatternTokenizer, cut_contexts, cut_left, text_of_last, token_spans
from examflow.plans.catalog import DIRECT_PREFILL, TOKEN_BUDGET, WORDS, prompt_budget_tokens
from examflow.sources import testdata as td

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_cut_context_fits_and_is_a_suffix():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    ids = lambda t: tok.encode(t, add_special_tokens=False).ids
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "the ", " 日本", "é", "🎉", "\n", "x1", "  "]) for _ in range(rnd.randrange(30)))
        option = rnd.choice(["A", " B", "日"])
        limit = rnd.randrange(1, 20)
        cut, kept, own = cut_left(text, option, limit, FileTokenizer(PATH))
        context, whole = ids(text), ids(text + option)
        n = limit - max(len(whole) - len(context), 0)
        expect = context[-n:]  # as the model's input is cut
        assert own == max(len(whole) - len(context), 0) and kept == len(expect) and text.endswith(cut)
        if text.isascii():
            assert tok.decode(expect) == cut


def test_columns_agree(spark):
    texts = ["", "one", "one two three four five", "日本 é 🎉 x y", "a  b   c ", " lead"]
    df = spark.createDataFrame([(i, t, "B") for i, t in enumerate(texts)] + [(9, None, "B")], "i int, t string, o string")
    for tokenizer in (PatternTokenizer(WORDS), FileTokenizer(PATH)):
        for limit in (1, 2, 3, 5, 100):
            rows = df.where("t IS NOT NULL").withColumn("cut", cut_contexts(tokenizer, limit)("t", "o")).withColumn(
                "s", token_spans(tokenizer)("t")).select(
                "t", "cut", text_of_last(F.col("t"), F.col("s"), F.lit(limit) - F.col("cut.n_conti")).alias("x")).collect()
            for r in rows:
                assert tuple(r.cut) == cut_left(r.t, "B", limit, tokenizer) and r.x == r.cut.text
    assert df.where("t IS NULL").select(token_spans(PatternTokenizer(WORDS))("t").alias("s")).first().s is None


def test_prompt_budget_tokens(spark, sf_small):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    sets = td.exam_item_sets(spark, sf_small)
    from examflow.operators.prompts import build_prompts, shot_rows

    shots = {}
    for r in sorted(shot_rows(sets.dev, 5).collect(), key=lambda r: (r.subset, r.rank)):
        shots.setdefault(r.subset, []).append(r.text)
    head = TOPIC_LINE + "\n\n"
    bare = {r.id: r.prompt for r in build_prompts(sets.test, None, 0).collect()}
    bound = 0
    for r in prompt_budget_tokens(spark, sf_small).collect():
        item = bare[r.id].removeprefix(head)
        left, text = TOKEN_BUDGET - count(head) - count(item) - count(DIRECT_PREFILL), ""
        for shot in shots[r.subset]:
            if left - count(shot) > 0:
                left, text = left - count(shot), text + shot
            else:
                bound += 1
        assert (r.budget_left, r.prompt) == (left, head + text + item)
    assert bound


def test_context_length_needs_a_tokenizer(spark, sf_small, scratch):
    from examflow.operators.replay import ReplayScores
    from examflow.plans.evaluate import evaluate

    with pytest.raises(ValueError, match="context_length"):
        evaluate(spark, td.exam_item_sets(spark, sf_small), ReplayScores, scratch("run"), backend="hf", context_length=5)


def test_counts_encode_few_texts_at_once():
    """A batch of many texts is encoded in parts, and long texts are not kept."""
    class Encoding:
        def __init__(self, text):
            self.ids = text.split()

    class Parts:
        most = 0

        def encode_batch(self, texts, add_special_tokens):
            self.most = max(self.most, sum(map(len, texts)))
            return [Encoding(t) for t in texts]

    tokenizer, parts = FileTokenizer("no file"), Parts()
    FileTokenizer._loaded["no file"] = (parts, {})
    texts = [f"{i} " + "a " * 50_000 for i in range(100)]
    assert tokenizer.counts(texts) == [50_001] * 100 and parts.most <= FileTokenizer.AT_ONCE + 200_000
    assert tokenizer.counts([*texts[:2], "b"]) == [50_001, 50_001, 1]
    assert sum(map(len, FileTokenizer._loaded.pop("no file")[1])) <= FileTokenizer.KEPT_CHARS


def test_a_context_is_taken_apart_once():
    class Counted(PatternTokenizer):
        seen = 0

        def bounds(self, text):
            Counted.seen += 1
            return super().bounds(text)

    from examflow.functions.tokens import cuts_left

    for text in ("", "a b c d", " x", "w" * 5):
        for pattern in (" ?[^ ]+| ", "[a-z]+", "( ?)[^ ]+", "q*"):
            t = Counted(pattern)
            assert list(zip(*(c.tolist() for c in t.bounds(text)), strict=True)) == t.spans(text)
            Counted.seen = 0
            cuts = cuts_left(text, ["A", " B"], 3, t)
            assert Counted.seen == 1 and cuts == [cut_left(text, c, 3, t) for c in ("A", " B")]
