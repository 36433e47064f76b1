"""Cleaning and packing of a corpus in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet under the shared folder and reads it back as the next stage's ``docs``.

* ``toxicity`` drops documents whose expected severity is at least 0.5. The model is
  fitted on at most ``toxicity.SAMPLE`` labelled documents of the input.
* ``near_dedup`` keeps one document of each group of near copies: five-word shingles,
  similarity 0.8 or more.
* ``substring_dedup`` cuts passages of 20 or more words that start earlier in the
  corpus out of ``text``. All rows stay; a text may become empty.
* ``packing`` returns the pieces of all documents, packed into sequences.

All but the last return the columns of documents (and any extra ones). Null ids,
null or empty texts, repeated rows and empty tables pass as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from examflow.llm import minhash, packing, substring_dedup, toxicity
from examflow.llm.frames import read_table, written
from examflow.llm.queries import public_tokenizer


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, num=100, den=80)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_texts(docs, width=20)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("packing", packing_stage),
]

# A trained classifier, automata and bin packing have no SQL form. tests/llm/test_rows.py
# holds near_dedup, substring_dedup and packing, row by row, against plain Python on whole
# tables, and severities against plain Python for a given model; what the model learns is
# held against labels it has not seen.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return written(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")
