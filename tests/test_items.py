"""Items view, subset selection and validation, items table scan."""

import pytest
from pyspark.sql import functions as F

from examflow.functions.constants import SUBSETS
from examflow.sources import testdata as td
from examflow.sources.items import (
    load_items,
    parse_subsets,
    subset_catalog,
    unknown_subsets,
    validate_subsets,
    write_items,
)


def test_items_counts(spark, sf_small):
    items = td.exam_items(spark, sf_small)
    counts = {(r.subset, r.split): r["count"] for r in items.groupBy("subset", "split").count().collect()}
    assert sum(counts.values()) == 200
    assert {k[0] for k in counts} == {"de", "en", "es", "fr"}
    assert all(counts[(s, "dev")] == 5 for s in ("de", "en", "es", "fr"))
    assert counts[("en", "test")] == 122


def test_parse_subsets():
    assert parse_subsets("ALL") is None
    assert parse_subsets("AST_chinese, driving_rule") == ["AST_chinese", "driving_rule"]
    assert parse_subsets("AST_chinese,") == ["AST_chinese", ""]
    assert parse_subsets("a, a ,b") == ["a", "b"]


def test_validate_against_catalog(spark):
    cat = subset_catalog(spark)
    assert cat.count() == len(SUBSETS) == 37
    assert validate_subsets(spark, "AST_chinese, driving_rule", cat) == ["AST_chinese", "driving_rule"]
    with pytest.raises(ValueError):
        validate_subsets(spark, "AST_chinese,", cat)
    assert [r.subset for r in unknown_subsets(spark, "AST_chinese,nope", cat).collect()] == ["nope"]


def test_items_table_partition_pruning(spark, sf_small, scratch):
    path = scratch("items")
    write_items(td.exam_items(spark, sf_small), path)
    df = load_items(spark, path, split="test", subsets=["en"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "split" in plan
    assert df.count() == 122
    assert df.where(F.col("subset") != "en").count() == 0
