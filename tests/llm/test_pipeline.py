"""The pipeline's stages against brute force, and the queries against their SQL."""

import hashlib

import pytest

import corpus_pipeline
from examflow.llm import minhash, substring_dedup
from examflow.llm.frames import written
from examflow.llm.oracle import ORACLE_SQL
from examflow.llm.queries import QUERIES
from tools.check_oracle import canon, duck


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    s_cols, s_vals = canon(df.columns, [tuple(r) for r in df.collect()])
    res = duck(sf_small).execute(ORACLE_SQL[name])
    d_cols, d_vals = canon([d[0] for d in res.description], res.fetchall())
    assert s_cols == d_cols and s_vals == d_vals


def test_stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = written(stages["toxicity"](spark, docs, sf_small), "t")
    assert clean.columns == docs.columns and clean.count() < docs.count()
    kept = written(stages["near_dedup"](spark, clean, sf_small), "t")
    groups = minhash.near_duplicates(clean, 100, 80).filter("kept").count()
    assert kept.columns == docs.columns and kept.count() == groups
    cut = written(stages["substring_dedup"](spark, kept, sf_small), "t")
    assert cut.columns == docs.columns and cut.count() == kept.count()
    # what is left of each text, by the words rule on the stage's own input
    want = {r.doc_id: r.kept_sha256 for r in substring_dedup.dedup_words(kept).collect()}
    for r in cut.collect():
        assert hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() == want[r.doc_id]
        assert r.n_chars == len(r.text)
    packed = stages["packing"](spark, cut, sf_small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(want)
