"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest

import __spark_entry__ as E
from examflow.plans.catalog import QUERIES
from examflow.plans.oracle import ORACLE_SQL
from tools.check_oracle import canon, duck

# a vocabulary has no SQL; held against the tokenizers library in test_tokens
NO_SQL = {"prompt_budget_tokens"}
NAMES = sorted(set(QUERIES) - NO_SQL)


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


def test_every_query_has_oracle():
    assert set(ORACLE_SQL) == set(QUERIES) - NO_SQL
    assert set(QUERIES) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["subset", "n", "n_correct", "avg_score"]
    assert df.count() == 4


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, sf_small, name):
    df = E.queries()[name](spark, sf_small)
    s_cols, s_vals = canon(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(E.oracle_sql()[name])
    d_cols, d_vals = canon([d[0] for d in res.description], res.fetchall())
    assert s_cols == d_cols
    assert len(s_vals) == len(d_vals)
    assert s_vals == d_vals
