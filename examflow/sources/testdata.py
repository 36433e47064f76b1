"""Exam-shaped views derived from the driver's generic test tables.

The driver ships documents, conversations and embeddings rather than exam
items, so the views below turn them into items, responses, a past log and a
logits table by fixed rules (they are spelled out in FIXTURES.md §3 and
mirrored one-to-one by the DuckDB SQL in ``plans/oracle.py``). Everything is
lazy and grows with the input tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ANSWER_OPEN, ANSWER_TAG, NOT_CORRECT_ANSWER, QUESTION_TAG
from ..functions.templates import option_array, render_item, take_present, topic_block
from ..operators.joins import SmallSide, attach_small, measure_small
from ..operators.topk import first_k
from ..session import table_path

N_DEV = 5
# fixed values: the ten response forms (see FIXTURES.md §3)
IDEOGRAPHIC_SPACE = "\u3000"
GRINNING_FACE = "\U0001f600"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


@dataclass
class ExamItems:
    """Items of every split, plus the dev split as a measured small side.

    The dev rows come straight out of the map-side top-k (each task keeps at
    most ``n_dev`` rows per language before the shuffle), so building the
    few-shot header needs no further scan of the documents.
    """

    all: DataFrame
    dev: DataFrame

    @property
    def test(self) -> DataFrame:
        return test_items(self.all)


def _item_columns(lines: Column) -> list[Column]:
    # every line is in exactly one column: the question, an option, or (from the
    # eighth line on) the explanation
    n_opt = F.greatest(F.least(F.size(lines) - 1, F.lit(6)), F.lit(1))
    return [
        F.concat("lang", F.lit("-"), F.col("doc_id").cast("string")).alias("id"),
        F.get(lines, 0).alias("question"),
        *[F.get(lines, i).alias(letter) for i, letter in enumerate("ABCDEF", start=1)],
        F.char(F.pmod("doc_id", n_opt) + 65).alias("answer"),
        F.when(F.size(lines) > 7, F.array_join(F.slice(lines, 8, F.size(lines)), "\n")).alias("explanation"),
    ]


_ITEM_OUT = ["id", "question", *"ABCDEF", "answer", "explanation"]


def exam_item_sets(spark: SparkSession, sf_dir: str, n_dev: int = N_DEV) -> ExamItems:
    """Every document is an item; the first ``n_dev`` per language are dev."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    lines = F.split("text", "\n", -1)
    base = docs.select("lang", "doc_id", *_item_columns(lines))
    # the top-k sorts keys only; texts of the few dev rows are joined to them
    first = first_k(docs.select("lang", "doc_id"), ["lang"], ["doc_id"], n_dev)
    keys = measure_small(first.select("lang", "doc_id", F.lit("dev").alias("split")))
    dev_side = measure_small(
        attach_small(base, keys, ["lang", "doc_id"], "inner", salt_by=F.col("id")).drop("split")
    )
    labelled = attach_small(base, keys, ["lang", "doc_id"], "left", salt_by=F.col("id"))

    def shape(df: DataFrame, split: Column) -> DataFrame:
        return df.select(
            F.col("lang").alias("subset"),
            split.alias("split"),
            F.col("doc_id").alias("seq"),
            *_ITEM_OUT,
        )

    return ExamItems(
        all=shape(labelled, F.coalesce("split", F.lit("test"))),
        dev=shape(dev_side.df, F.lit("dev")),
    )


def exam_items(spark: SparkSession, sf_dir: str, n_dev: int = N_DEV) -> DataFrame:
    return exam_item_sets(spark, sf_dir, n_dev).all


def test_items(items: DataFrame) -> DataFrame:
    return items.where(F.col("split") == "test")


def dev_items(items: DataFrame) -> DataFrame:
    return items.where(F.col("split") == "dev")


def response_text() -> Column:
    """The synthetic free-text response of a test item, in ten fixed forms."""
    n_opt = F.greatest(F.size(take_present(option_array())), F.lit(1))
    seq = F.col("seq")
    p = F.char(F.pmod(F.expr("seq div 3"), n_opt) + 65)
    g = F.col("answer")
    q = F.col("question")
    opened = F.concat(F.lit(ANSWER_OPEN), p, F.lit(")"))
    form = F.pmod(seq, 10)
    return (
        F.when(form == 0, F.concat(p, F.lit(")")))
        .when(form == 1, opened)
        .when(form == 2, F.concat(q, F.lit("\n\n"), opened))
        .when(form == 3, F.concat(F.lit(NOT_CORRECT_ANSWER + "\n\n"), p, F.lit(")")))
        .when(
            form == 4,
            F.concat(F.lit(IDEOGRAPHIC_SPACE + "\n"), p, F.lit(") " + IDEOGRAPHIC_SPACE)),
        )
        .when(form == 5, F.concat(F.lit("A 與 B\n"), opened))
        .when(form == 6, F.concat(opened, F.lit("\n" + QUESTION_TAG + "A)")))
        .when(form == 7, F.lit(""))
        .when(form == 8, F.concat(F.lit(ANSWER_TAG), g, F.lit(" 或 "), p, F.lit("\n) 不正確")))
        .otherwise(F.concat(F.lit(GRINNING_FACE), q, F.lit("\n"), opened))
    )


def responses_of(items: DataFrame) -> DataFrame:
    """One synthetic response per test item."""
    return test_items(items).select(
        "subset",
        "seq",
        "id",
        response_text().alias("full_response"),
        F.col("answer").alias("gold_answer"),
    )


def exam_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses_of(exam_items(spark, sf_dir))


def log_rows_of(items: DataFrame, whole: bool = False) -> DataFrame:
    """A past run's log: every fourth response (an interrupted run, for the resume
    queries) or, if ``whole``, every response; every fortieth one twice.

    The logged prompt is the zero-shot, answer-opening prompt of the item.
    One pass over the items: the doubled rows come from an explode.
    """
    prompt = F.concat(F.lit(topic_block()), render_item("suffix", cot=False))
    copies = F.when(F.pmod("seq", 40) == 0, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    return (
        test_items(items)
        .where(F.lit(True) if whole else F.pmod("seq", 4) == 0)
        .select(
            "subset",
            "seq",
            "id",
            prompt.alias("prompt"),
            response_text().alias("full_response"),
            F.col("answer").alias("gold_answer"),
            F.explode(copies).alias("copy"),
        )
        .drop("copy")
    )


def exam_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a whole run."""
    return log_rows_of(exam_items(spark, sf_dir), whole=True)


def failures_of(items: DataFrame) -> DataFrame:
    """Responses where every 97th call failed."""
    return responses_of(items).withColumn("failed", F.pmod("seq", 97) == 0)


def exam_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logits table: four option rows per item, one scored position each."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(
        F.lit("embeddings").alias("subset"),
        F.expr("vec_id div 4").cast("string").alias("id"),
        F.char(F.pmod("vec_id", 4) + 65).alias("choice"),
        F.lit(0).alias("pos"),
        F.col("label").alias("token_id"),
        F.col("embedding").cast("array<double>").alias("logits"),
    )


def assistant_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations")
    return conv.where(F.col("role") == "assistant").select("conv_id", "turn", "text")
