"""Plan checks: native expressions, checked broadcasts, map-side top-k,
anti-join below the responder, pruned scans."""

from examflow.operators.respond import respond
from stand_ins import LetterResponder
from examflow.operators.scoring import report, score
from examflow.plans.catalog import QUERIES
from examflow.sources import testdata as td
from examflow.sources.runlog import pending


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_has_no_python(spark, sf_small):
    p = plan_of(report(score(td.exam_responses(spark, sf_small), "cot")))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in p


def test_prompt_plan_is_native_and_broadcasts_header(spark, sf_small):
    df = QUERIES["prompt_bare_k5"](spark, sf_small)
    p = plan_of(df)
    assert "Python" not in p and "MapInPandas" not in p
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_top_k_is_limited_before_shuffle(spark, sf_small):
    from examflow.operators.topk import first_k

    docs = td.read_table(spark, sf_small, "documents").select("lang", "doc_id")
    p = first_k(docs, ["lang"], ["doc_id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p and "Partial" in p


def test_anti_join_below_responder(spark, sf_small):
    items = td.exam_items(spark, sf_small)
    todo = pending(td.test_items(items).select("subset", "id", "question"), td.log_rows_of(items))
    p = plan_of(respond(todo, LetterResponder, input_col="question"))
    i_map, i_anti = p.find("MapInPandas"), p.find("LeftAnti")
    assert i_map >= 0 and i_anti > i_map  # the anti join is in the responder's input subtree


def test_scan_is_pruned(spark, sf_small):
    p = plan_of(QUERIES["conversation_predictions"](spark, sf_small))
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in p
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)]" in p


def test_items_scan_reads_only_needed_columns(spark, sf_small):
    import re

    p = plan_of(QUERIES["report_direct"](spark, sf_small))
    schemas = set(re.findall(r"ReadSchema: (struct<[^>]*>)", p))
    assert schemas <= {"struct<doc_id:bigint,text:string,lang:string>", "struct<doc_id:bigint,lang:string>"}, schemas
