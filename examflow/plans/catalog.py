"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads the driver's tables (through the exam views of
``sources.testdata``) over their whole extent, so its work grows with them.
``plans/oracle.py`` holds the equivalent DuckDB SQL under the same keys and
with the same column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import BACKENDS
from ..functions.scorers import with_prediction
from ..functions.templates import (
    chat_wrap,
    flat_prefill,
    messages,
    option_array,
    render_options,
    take_present,
    with_prefill,
)
from ..functions.tokens import FileTokenizer, PatternTokenizer, cut_contexts, text_of_last, token_spans, tokenizer_len
from ..functions.text import cut_at_question, find_choice, find_choice_pos, is_answer_format, is_awq
from ..operators import loglik as LL
from ..operators.prompts import build_prompts, build_prompts_budget
from ..operators.replay import Replay, ReplayScores, attach_recorded, recorded_calls
from ..operators.respond import prefix_commit, reconcile, respond
from ..operators.rowindex import zip_outputs
from ..operators.scoring import report, rescore, score
from ..session import parallelism, scratch_path
from ..sources import testdata as td
from ..sources.items import catalog_of, load_items, unknown_subsets, write_items
from ..sources.runlog import append_log, overwrite_log, pending, read_log, read_mixed_logs, run_dir, write_named_log
from ..streaming.score_stream import deduped_report, stream_report_once

Query = Callable[[SparkSession, str], DataFrame]

# fixed parameters of the registered queries
BUDGET_MAX_LENGTH = 4000
TRUNCATE_MAX_LENGTH = 64
STUB_MAX_TRIES = 4
RETRY_MAX_TRIES = 2
CONTEXT_LENGTH = 40  # words of a context and its option
WORDS = " ?[^ ]+| "  # a word with the blank before it
SEQUENCE = 8  # vectors that make one sequence of logits
TOKEN_BUDGET = 1500
SUBSET_SPEC = "en, fr"
UNKNOWN_SPEC = "en, fr,xx,"
OVERWRITE_SUBSETS = ["en", "es"]
DIRECT_PREFILL = "\n正確答案：("
COT_PREFILL = "\n讓我們一步一步思考。\n"


def _items(spark, sf):
    return td.exam_items(spark, sf)


def _prompts(spark, sf, k, style, cot):
    sets = td.exam_item_sets(spark, sf)
    return build_prompts(sets.test, sets.dev, k, style, cot)


# --- scoring ------------------------------------------------------------------


def report_direct(spark, sf):
    return report(score(td.exam_responses(spark, sf), "direct"))


def report_cot(spark, sf):
    return report(score(td.exam_responses(spark, sf), "cot"))


def predict_direct_q(spark, sf):
    return score(td.exam_responses(spark, sf), "direct").select(
        "subset", "id", "prediction", "correct"
    )


def predict_cot_q(spark, sf):
    return score(td.exam_responses(spark, sf), "cot").select(
        "subset", "id", "prediction", "correct"
    )


def conversation_predictions(spark, sf):
    turns = td.assistant_turns(spark, sf)
    turns = with_prediction(turns, "direct", "text", "pred_direct")
    turns = with_prediction(turns, "cot", "text", "pred_cot")
    return turns.select("conv_id", "turn", "pred_direct", "pred_cot")


def _document_lines(spark, sf):
    docs = td.read_table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def answer_format(spark, sf):
    return _document_lines(spark, sf).select(
        "doc_id", "line_no", is_answer_format(F.col("line")).alias("is_answer")
    )


def find_choice_q(spark, sf):
    return _document_lines(spark, sf).select(
        "doc_id",
        "line_no",
        find_choice(F.col("line")).alias("choice"),
        find_choice_pos(F.col("line")).alias("choice_pos"),
    )


def stop_truncate(spark, sf):
    return td.exam_responses(spark, sf).select(
        "subset", "id", cut_at_question(F.col("full_response")).alias("truncated")
    )


# --- options and prompts --------------------------------------------------------


def options_takewhile(spark, sf):
    present = take_present(option_array())
    return _items(spark, sf).select(
        "subset",
        "id",
        F.size(present).alias("n_options"),
        F.array_join(present, "\u001f").alias("options_text"),
    )


def options_render(spark, sf):
    return _items(spark, sf).select(
        "subset", "id", render_options(take_present(option_array())).alias("options_block")
    )


def _prompt_query(k, style, cot):
    def q(spark, sf):
        return _prompts(spark, sf, k, style, cot)

    return q


def prompt_budget(spark, sf):
    sets = td.exam_item_sets(spark, sf)
    return build_prompts_budget(
        sets.test,
        sets.dev,
        5,
        BUDGET_MAX_LENGTH,
        template_text=DIRECT_PREFILL,
        style="bare",
        cot=False,
    ).select("subset", "seq", "id", "prompt", "budget_left", "gold_answer")


def prefill_suffix(spark, sf):
    p = _prompts(spark, sf, 0, "bare", False)
    return p.select("subset", "id", with_prefill(F.col("prompt"), DIRECT_PREFILL).alias("model_input"))


def chat_wrap_q(spark, sf):
    p = _prompts(spark, sf, 0, "bare", True)
    return p.select("subset", "id", chat_wrap(F.col("prompt"), COT_PREFILL).alias("model_input"))


def messages_q(spark, sf):
    p = _prompts(spark, sf, 0, "bare", True)
    m = messages(F.col("prompt"), COT_PREFILL)
    return p.select(
        "subset",
        "id",
        m[0]["content"].alias("user_content"),
        m[1]["content"].alias("assistant_content"),
        flat_prefill(F.col("prompt"), COT_PREFILL).alias("flat_input"),
    )


# --- resume and log -------------------------------------------------------------


def pending_ids(spark, sf):
    items = _items(spark, sf)
    return pending(td.test_items(items).select("subset", "id"), td.log_rows_of(items))


def log_distinct_ids(spark, sf):
    return td.exam_log(spark, sf).select("subset", "id").distinct()


def rescore_union(spark, sf):
    items = _items(spark, sf)
    past = td.log_rows_of(items)
    new = pending(td.responses_of(items), past)
    return report(rescore(past, new, "direct"))


def rescore_union_cot(spark, sf):
    items = _items(spark, sf)
    past = td.log_rows_of(items)
    new = pending(td.responses_of(items), past)
    return report(rescore(past, new, "cot"))


def log_roundtrip(spark, sf):
    path = scratch_path(spark, "log")
    append_log(td.exam_log(spark, sf), path, run_id="r1")
    return read_log(spark, path).select("subset", "id", "prompt", "full_response", "gold_answer")


def overwrite_subset(spark, sf):
    """A whole log, in which 'en' is replaced by other responses and 'es' by none."""
    items = _items(spark, sf)
    path = scratch_path(spark, "log")
    append_log(td.log_rows_of(items, whole=True), path, run_id="r1")
    fresh = (
        td.responses_of(items)
        .where(F.col("subset") == "en")
        .withColumn("full_response", F.concat(F.lit("again\n\n"), "full_response"))
        .withColumn("prompt", F.lit(None).cast("string"))
    )
    overwrite_log(spark, fresh, path, OVERWRITE_SUBSETS, run_id="r2")
    return read_log(spark, path).select("subset", "id", "full_response", "gold_answer")


def items_text_check(spark, sf):
    """Lines and characters per subset, counted from the item columns."""
    parts = F.filter(F.array("question", *"ABCDEF", "explanation"), lambda x: x.isNotNull())
    return _items(spark, sf).groupBy("subset").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum(F.size(F.split(F.array_join(parts, "\n"), "\n", -1))).alias("n_lines"),
        F.sum(F.char_length(F.replace(F.array_join(parts, "\n"), F.lit("\n"), F.lit("")))).alias("n_chars"),
    )


def _two_runs(spark, sf):
    responses = td.responses_of(_items(spark, sf)).withColumn("prompt", F.lit(None).cast("string"))
    path = scratch_path(spark, "log")
    append_log(responses, path, run_id="r1")
    append_log(responses, path, run_id="r2")
    return responses, path


def overwrite_one_run(spark, sf):
    """Two runs share a folder and one of them is replaced; the other one stays."""
    responses, path = _two_runs(spark, sf)
    names = [r["subset"] for r in responses.select("subset").distinct().collect()]
    fresh = responses.withColumn("full_response", F.lit("B)"))
    overwrite_log(spark, fresh, path, names, run_id="r2", only_run=True)
    return read_log(spark, path).select("run_id", "subset", "id", "full_response")


def rescore_dedupe(spark, sf):
    """Lines per subset after dropping an item's repeated lines within each run."""
    responses, path = _two_runs(spark, sf)
    append_log(responses, path, run_id="r1")
    scored = rescore(read_log(spark, path), None, "direct", dedupe=True)
    return scored.groupBy("subset").agg(F.count(F.lit(1)).alias("n"))


def items_scan_dev(spark, sf):
    path = scratch_path(spark, "items")
    write_items(_items(spark, sf), path)
    return load_items(spark, path, split="dev").select("subset", "seq", "id", "answer")


# --- subsets, runs, reconciliation -----------------------------------------------


def subset_filter(spark, sf):
    from ..sources.items import parse_subsets, select_subsets

    items = _items(spark, sf)
    return select_subsets(items, parse_subsets(SUBSET_SPEC)).select("subset", "split", "id")


def unknown_subsets_q(spark, sf):
    return unknown_subsets(spark, UNKNOWN_SPEC, catalog_of(_items(spark, sf)))


def reconcile_counts(spark, sf):
    items = _items(spark, sf)
    fails = td.failures_of(items).select(
        "subset", F.when(F.col("failed"), F.lit("call failed")).alias("error")
    )
    return reconcile(td.test_items(items), fails)


def prefix_commit_q(spark, sf):
    return prefix_commit(td.failures_of(_items(spark, sf))).select("subset", "seq", "id")


def run_dirs(spark, sf):
    docs = td.read_table(spark, sf, "documents")
    runs = docs.select("lang", "source").distinct()
    n = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    backend = F.element_at(F.array(*[F.lit(b) for b in BACKENDS]), F.pmod(n, 6) + 1)
    runs = runs.select(
        F.concat("lang", F.lit("/"), "source").alias("model"),
        backend.alias("backend"),
        (F.pmod(n, 4) == 1).alias("cot"),
        F.when(F.pmod(n, 5) == 0, F.concat(F.lit("custom/"), "lang")).alias("log_dir"),
    )
    return runs.select(
        "model",
        "backend",
        "cot",
        run_dir("model", "backend", "cot", F.col("log_dir")).alias("run_dir"),
        is_awq("model").alias("awq"),
    )


# --- probability path --------------------------------------------------------------


def log_softmax_token(spark, sf):
    lg = td.exam_logits(spark, sf)
    return lg.select(
        "subset", "id", "choice", F.round(LL.token_logprob("logits", "token_id"), 6).alias("lp")
    )


def choice_loglik(spark, sf):
    return LL.choice_loglik(td.exam_logits(spark, sf)).select(
        "subset", "id", "choice", F.round("loglik", 6).alias("loglik")
    )


def choice_argmax(spark, sf):
    return LL.choose_from_logits(td.exam_logits(spark, sf)).select(
        "subset", "id", "prediction", F.round("loglik", 6).alias("loglik")
    )


def loglik_requests_q(spark, sf):
    items = _items(spark, sf)
    p = build_prompts(td.test_items(items), None, 0, "bare", False, keep=tuple("ABCDEF"))
    return LL.loglik_requests(p, DIRECT_PREFILL)


def loglik_report(spark, sf):
    """Probability path end to end: arg-max labels scored like text."""
    resp = LL.loglik_responses(td.exam_logits(spark, sf))
    gold = F.char(F.pmod(F.col("id").cast("long"), 4) + 65)
    return report(score(resp.withColumn("gold_answer", gold), "direct"))


def left_truncate_q(spark, sf):
    p = _prompts(spark, sf, 0, "bare", False)
    ctx = F.split(with_prefill(F.col("prompt"), DIRECT_PREFILL), " ", -1)
    whole = F.split(F.concat(with_prefill(F.col("prompt"), DIRECT_PREFILL), F.lit(" A")), " ", -1)
    conti = LL.continuation(ctx, whole)
    kept = LL.left_truncate(ctx, F.lit(TRUNCATE_MAX_LENGTH) - F.size(conti))
    return p.select(
        "subset",
        "id",
        F.size(conti).alias("n_conti"),
        F.size(kept).alias("n_kept"),
        F.array_join(kept, " ").alias("kept_text"),
    )


def evaluate_loglik_truncated(spark, sf):
    """A probability run whose contexts, whole documents among them, are cut to the model
    length; the scores depend on the cut context. The logged labels."""
    from .evaluate import evaluate

    sets = _recorded_scores(spark, sf)
    path = scratch_path(spark, "run")
    evaluate(spark, sets, ReplayScores, path, k=0, backend="hf", run_id="cut", aside=("scores",),
             tokenizer=PatternTokenizer(WORDS), context_length=CONTEXT_LENGTH)
    return read_log(spark, path).select("subset", "id", "full_response")


def cut_contexts_q(spark, sf):
    """Every request of the probability path with its context cut, once by the token
    spans and once together with its continuation."""
    requests = loglik_requests_q(spark, sf)
    tokenizer = PatternTokenizer(WORDS)
    both = requests.withColumn("cut", cut_contexts(tokenizer, CONTEXT_LENGTH)("context", "continuation"))
    spans = both.withColumn("spans", token_spans(tokenizer)("context"))
    return spans.select(
        "subset", "id", "choice", F.col("cut.text").alias("kept_text"), F.col("cut.n_kept").alias("n_kept"),
        F.col("cut.n_conti").alias("n_conti"),
        text_of_last(F.col("context"), F.col("spans"), F.lit(CONTEXT_LENGTH) - F.col("cut.n_conti")).alias("text_by_spans"))


def continuation_loglik(spark, sf):
    """All vectors as sequences of logits; of each, the last one to three tokens scored."""
    emb = td.read_table(spark, sf, "embeddings").select(
        F.lit("embeddings").alias("subset"), F.expr(f"vec_id div {SEQUENCE}").alias("seq"),
        F.pmod("vec_id", F.lit(SEQUENCE)).alias("pos"), "label", F.col("embedding").cast("array<double>").alias("logits"))
    rows = emb.withColumn("id", F.col("seq").cast("string"))
    length = rows.groupBy("id").agg(F.count(F.lit(1)).alias("length"))
    n = F.least(1 + F.pmod("seq", F.lit(3)), F.col("length") - 1)
    tokens = rows.join(length, "id").select("subset", "id", "pos", F.col("label").alias("token_id"), n.alias("n"))
    return LL.continuation_scores(rows.select("subset", "id", "pos", "logits"), tokens).select(
        "subset", "id", "n", F.round("loglik", 6).alias("loglik"))


def zip_outputs_q(spark, sf):
    """Documents by id, and their lengths by length, paired by place."""
    docs = td.read_table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    outputs = docs.select(F.col("doc_id").alias("o"), "n")
    return zip_outputs(docs.select("doc_id"), outputs, ("doc_id", "doc_id"), ("n", "o"), ["n"])


# --- responder and end to end ---------------------------------------------------------


def _with_recorded(spark, sf, recorded, on):
    """The items with what is recorded for them: the item's number modulo the recordings'."""
    sets = td.exam_item_sets(spark, sf)
    last = recorded.agg(F.max(on)).first()[0] or 0
    items = attach_recorded(sets.all, recorded, F.pmod("seq", F.lit(last + 1)), on, spread=F.col("id"))
    return td.ExamItems(items, sets.dev)


def recorded_call_items(spark, sf):
    return _with_recorded(spark, sf, recorded_calls(td.read_table(spark, sf, "conversations")), "conv_id")


def _recorded_scores(spark, sf):
    emb = td.read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("scores"))
    return _with_recorded(spark, sf, emb, "vec_id")


def _suffix_prompts(items):
    return build_prompts(td.test_items(items), None, 0, "suffix", False, keep=("calls",))


def respond_stub(spark, sf):
    """The items that the log has not, answered by the conversations' recorded turns."""
    items = recorded_call_items(spark, sf).all
    todo = pending(_suffix_prompts(items), td.log_rows_of(items))
    out = respond(todo, Replay, partitions=parallelism(spark), max_tries=STUB_MAX_TRIES, aside=("calls",))
    return out.select("subset", "id", "full_response")


def respond_retry(spark, sf):
    out = respond(
        _suffix_prompts(recorded_call_items(spark, sf).all),
        Replay,
        max_tries=RETRY_MAX_TRIES,
        partitions=parallelism(spark),
        aside=("calls",),
    )
    return out.select(
        "subset", "id", "full_response", F.col("error").isNotNull().alias("failed"), "attempts"
    )


def evaluate_resume(spark, sf):
    """A whole resumed run: past log on disk, 5-shot prompts for the rest, recorded
    answers, append, then the report from the log as it now stands."""
    from .evaluate import evaluate

    sets = recorded_call_items(spark, sf)
    path = scratch_path(spark, "run")
    append_log(td.log_rows_of(_items(spark, sf)), path, run_id="past")  # no recorded calls
    result = evaluate(
        spark,
        sets,
        Replay,
        path,
        mode="direct",
        style="suffix",
        k=5,
        run_id="now",
        aside=("calls",),
    )
    return result.report


def resume_after_abort(spark, sf):
    """A run that stops after half of its buckets, and the one that goes on from there:
    the log, which the second run alone writes."""
    from .evaluate import RunPaused, evaluate

    sets = recorded_call_items(spark, sf)
    path = scratch_path(spark, "run")
    run = lambda **how: evaluate(spark, sets, Replay, path, k=0, run_id="once", aside=("calls",), commits=4, **how)
    try:
        run(most_commits=2)
    except RunPaused:
        run()
    return read_log(spark, path).select("run_id", "subset", "id", "full_response", "gold_answer")


def evaluate_budget_chat(spark, sf):
    """A fresh run of a local-engine backend: chat template, prefill and a few-shot token
    budget, every item asked for; the log with the prompts."""
    from .evaluate import evaluate

    sets = recorded_call_items(spark, sf)
    path = scratch_path(spark, "run")
    evaluate(
        spark,
        sets,
        Replay,
        path,
        mode="direct",
        k=5,
        backend="vllm",
        chat_template=True,
        max_length=BUDGET_MAX_LENGTH,
        run_id="budget",
        aside=("calls",),
    )
    return read_log(spark, path).select("subset", "id", "prompt", "full_response", "gold_answer")


def evaluate_loglik(spark, sf):
    """A fresh probability-backend run: 5-shot prompts, every option present scored from
    recorded scores, arg-max labels logged and scored, report."""
    from .evaluate import evaluate

    sets = _recorded_scores(spark, sf)
    result = evaluate(spark, sets, ReplayScores, scratch_path(spark, "run"), k=5, backend="hf", run_id="hf",
                      aside=("scores",))
    return result.report


def legacy_log_rescore(spark, sf):
    """One log in two layouts, 'en' in a file of its own beside the partitioned rest,
    read as one and scored again."""
    log = td.exam_log(spark, sf)
    path = scratch_path(spark, "log")
    append_log(log.where(F.col("subset") != "en"), path, run_id="r1")
    write_named_log(log.where(F.col("subset") == "en"), path, "en")
    rows, _torn = read_mixed_logs(spark, path)
    return report(rescore(rows, None, "direct"))


def prompt_budget_tokens(spark, sf):
    """Few-shot examples cut to a budget in tokens of a public vocabulary."""
    import public_tokenizers

    count = tokenizer_len(FileTokenizer(str(public_tokenizers.path("byte_bpe_50k.json"))))
    sets = td.exam_item_sets(spark, sf)
    return build_prompts_budget(sets.test, sets.dev, 5, TOKEN_BUDGET, DIRECT_PREFILL, "bare", False, token_len=count).select(
        "subset", "seq", "id", "prompt", "budget_left", "gold_answer")


def stream_dedupe(spark, sf):
    """Two runs in one folder, one of them logged twice: a stream that counts each item of
    a run once."""
    _, path = _two_runs(spark, sf)
    append_log(td.responses_of(_items(spark, sf)).withColumn("prompt", F.lit(None).cast("string")), path, run_id="r1")
    return deduped_report(spark, path, scratch_path(spark, "seen"), scratch_path(spark, "stream-ckpt"))


def stream_report(spark, sf):
    path = scratch_path(spark, "stream-log")
    append_log(td.exam_log(spark, sf), path, run_id="r1")
    return stream_report_once(
        spark,
        path,
        scratch_path(spark, "stream-report"),
        scratch_path(spark, "stream-ckpt"),
        mode="direct",
    ).select("subset", "n", "n_correct", "avg_score")


QUERIES: dict[str, Query] = {
    "report_direct": report_direct,
    "report_cot": report_cot,
    "predict_direct": predict_direct_q,
    "predict_cot": predict_cot_q,
    "conversation_predictions": conversation_predictions,
    "answer_format": answer_format,
    "find_choice": find_choice_q,
    "stop_truncate": stop_truncate,
    "options_takewhile": options_takewhile,
    "options_render": options_render,
    "prompt_bare_k0": _prompt_query(0, "bare", False),
    "prompt_bare_k5": _prompt_query(5, "bare", False),
    "prompt_suffix_k5": _prompt_query(5, "suffix", False),
    "prompt_bare_cot_k5": _prompt_query(5, "bare", True),
    "prompt_suffix_cot_k5": _prompt_query(5, "suffix", True),
    "prompt_budget": prompt_budget,
    "prefill_suffix": prefill_suffix,
    "chat_wrap": chat_wrap_q,
    "messages": messages_q,
    "pending_ids": pending_ids,
    "items_text_check": items_text_check,
    "overwrite_one_run": overwrite_one_run,
    "rescore_dedupe": rescore_dedupe,
    "log_distinct_ids": log_distinct_ids,
    "rescore_union": rescore_union,
    "rescore_union_cot": rescore_union_cot,
    "log_roundtrip": log_roundtrip,
    "overwrite_subset": overwrite_subset,
    "items_scan_dev": items_scan_dev,
    "subset_filter": subset_filter,
    "unknown_subsets": unknown_subsets_q,
    "reconcile_counts": reconcile_counts,
    "prefix_commit": prefix_commit_q,
    "run_dirs": run_dirs,
    "log_softmax_token": log_softmax_token,
    "choice_loglik": choice_loglik,
    "choice_argmax": choice_argmax,
    "left_truncate": left_truncate_q,
    "loglik_requests": loglik_requests_q,
    "loglik_report": loglik_report,
    "respond_stub": respond_stub,
    "respond_retry": respond_retry,
    "evaluate_resume": evaluate_resume,
    "evaluate_budget_chat": evaluate_budget_chat,
    "evaluate_loglik": evaluate_loglik,
    "stream_report": stream_report,
    "evaluate_loglik_truncated": evaluate_loglik_truncated,
    "cut_contexts": cut_contexts_q,
    "continuation_loglik": continuation_loglik,
    "zip_outputs": zip_outputs_q,
    "resume_after_abort": resume_after_abort,
    "legacy_log_rescore": legacy_log_rescore,
    "prompt_budget_tokens": prompt_budget_tokens,
    "stream_dedupe": stream_dedupe,
}

__all__ = ["QUERIES"]
