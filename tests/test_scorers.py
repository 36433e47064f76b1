"""Goldens for the two answer readers and the text predicates."""

import pytest
from pyspark.sql import functions as F

from examflow.functions.constants import PY_WHITESPACE
from examflow.functions.scorers import is_correct, predict_cot, predict_direct
from examflow.functions.text import find_choice, find_choice_pos, is_answer_format, py_strip

S = "　"
GOLDENS = [
    ("", None, None),
    ("A) x", "A", "A"),
    ("B", "B", "B"),
    ("F", "F", None),
    ("我選F)", "F", None),
    ("hello\n\nC)", "C", "C"),
    ("正確答案：(D)\n\nA)", "D", "A"),
    ("不是正確答案A\n\n所以B", "B", "B"),
    ("因為A錯\n正確答案：(C)", "C", "C"),
    ("A 與 B)", "B", "B"),
    ("先想A\n想B\n問題：C)", "C", "B"),
    ("正確答案是 A\n) 不正確 B", "A", "A"),
    ("\U0001f600正確答案：(B)", "B", "B"),
    (S + "\n A)" + S, "A", "A"),
    ("問題：A)", "A", None),
    ("不正確 A", "A", None),
    ("答案A，正確答案：(E)", "E", "E"),
    ("Because正確答案：無", "B", None),
    ("a\n\nb\n\n", None, None),
    ("Ａ）", None, None),
    ("x\n\n不正確A)", "A", None),
    ("D)\n不是正確答案：A)", "D", "A"),
    ("正確答案：B 或 A\n) 不正確", "B", "A"),
    ("正確答案：F 或 C\n) 不正確", "F", "C"),
    ("選 B\n\n\nC)", "B", "C"),
    (None, None, None),
]


@pytest.fixture(scope="module")
def predictions(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDENS)], "i int, r string")
    rows = df.select(
        "i", predict_direct(F.col("r")).alias("d"), predict_cot(F.col("r")).alias("c")
    ).collect()
    return {r.i: (r.d, r.c) for r in rows}


@pytest.mark.parametrize("i", range(len(GOLDENS)))
def test_direct_golden(predictions, i):
    assert predictions[i][0] == GOLDENS[i][1], repr(GOLDENS[i][0])


@pytest.mark.parametrize("i", range(len(GOLDENS)))
def test_cot_golden(predictions, i):
    assert predictions[i][1] == GOLDENS[i][2], repr(GOLDENS[i][0])


def test_strip_matches_python(spark):
    ws = "".join(chr(c) for c in range(0x110000) if chr(c).strip() == "")
    assert set(ws) == set(PY_WHITESPACE) and len(PY_WHITESPACE) == 29
    samples = [ws + "x" + ws + "y" + ws, "\x1c\x1dab\x1e\x1f", "\u0085a ", "  ", ""]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(py_strip(F.col("s"))).collect()]
    assert got == [s.strip() for s in samples]


def test_answer_format_rule_order(spark):
    cases = {
        "不是正確答案 A": False,
        "正確答案": True,
        "不正確 A": False,
        "正確": True,
        "E": True,
        "F": False,
        "xyz": False,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.f for r in df.select("t", is_answer_format(F.col("t")).alias("f")).collect()}
    assert got == cases


def test_find_choice_positions_count_code_points(spark):
    cases = ["\U0001f600\U0001f600A", "xB)A", "zzz", "C", "a\nb D)"]
    expect = []
    for t in cases:
        import re

        m = re.search(r"[A-F]\)", t) or re.search(r"[A-F]", t)
        expect.append((m.group(0)[0] if m else None, m.start() if m else -1))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = [
        (r.c, r.p)
        for r in df.orderBy("i")
        .select(find_choice(F.col("t")).alias("c"), find_choice_pos(F.col("t")).alias("p"))
        .collect()
    ]
    assert got == expect


def test_gold_compared_unstripped(spark):
    df = spark.createDataFrame([("A)", "A "), ("A)", "A"), (None, "A")], "r string, g string")
    got = [r[0] for r in df.select(is_correct(predict_direct(F.col("r")), F.col("g"))).collect()]
    assert got == [0, 1, 0]


def test_whitespace_appended_does_not_change_direct(spark):
    rows = [(g[0],) for g in GOLDENS if g[0] is not None]
    df = spark.createDataFrame(rows, "r string")
    out = df.select(
        predict_direct(F.col("r")).alias("a"),
        predict_direct(F.concat(F.col("r"), F.lit(" \n　"))).alias("b"),
    ).collect()
    assert all(r.a == r.b for r in out)


def test_staged_prediction_equals_column_readers(spark):
    from examflow.functions.scorers import with_prediction

    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDENS)], "i int, r string")
    staged = with_prediction(with_prediction(df, "direct", "r", "d"), "cot", "r", "c")
    assert staged.columns == ["i", "r", "d", "c"]
    got = {r.i: (r.d, r.c) for r in staged.collect()}
    assert got == {i: (g[1], g[2]) for i, g in enumerate(GOLDENS)}


def test_conversation_prediction_counts_match_fixtures(spark):
    """Counts probed independently at sf0.01 (FIXTURES.md §3)."""
    from examflow.plans.catalog import QUERIES

    df = QUERIES["conversation_predictions"](spark, "/root/testdata/sf0.01")
    direct = {r[0]: r[1] for r in df.groupBy("pred_direct").count().collect()}
    cot = {r[0]: r[1] for r in df.groupBy("pred_cot").count().collect()}
    assert direct == {None: 22, "A": 75, "B": 12, "C": 8, "D": 16, "E": 93, "F": 7}
    assert cot == {None: 22, "A": 60, "B": 12, "C": 11, "D": 14, "E": 111, "F": 3}


def test_callable_mode_reads_the_response(spark):
    from examflow.functions.scorers import scorer
    from examflow.operators.scoring import rescore, score

    def last_letter(response):
        return F.upper(F.substring(response, -1, 1))

    log = spark.createDataFrame(
        [("s", "1", "is b", "B"), ("s", "2", "is c", "B"), ("s", "3", None, "B")],
        "subset string, id string, full_response string, gold_answer string",
    )
    got = {r.id: (r.prediction, r.correct) for r in score(log, last_letter).collect()}
    assert got == {"1": ("B", 1), "2": ("C", 0), "3": (None, 0)}
    assert rescore(log, None, last_letter).agg(F.sum("correct")).first()[0] == 1
    assert scorer(last_letter) is last_letter
