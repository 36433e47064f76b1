"""One evaluation run, end to end, as Spark jobs.

  items ─ subsets ─ anti-join the log and the answers of a run that broke off
        ─ open items written once, in buckets
  bucket ─ prompts (few-shot header by checked broadcast) ─ responder (Arrow batches)
        ─ committed in the run's progress folder
  all    ─ successes appended to the log ─ log read back ─ scored ─ report per subset

Subsets run as partitions of the same jobs, not as a loop. The responder's output is
written exactly once, bucket by bucket, before anything else reads it, so no second
action can call the service again, and a lost driver costs the answers of one bucket
(``sources.progress``). The log is the single source of truth for the report, which
therefore counts past and new lines together. The items are scanned once: what was asked
and what came back is counted on the written open items and responses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import (
    BACKEND_PREFILL,
    BACKEND_STYLE,
    DEFAULT_MAX_RETRIES,
    DEFAULT_MAX_TOKENS,
    DEFAULT_TEMPERATURE,
    DEFAULT_TIMEOUT,
    OPTION_LETTERS,
    QUESTION_TAG,
    TOPIC_LINE,
)
from ..functions.text import cut_at_stops
from ..functions.templates import (
    chat_wrap, flat_prefill, messages, option_array, take_present, template_text, with_prefill)
from ..operators.prompts import build_prompts, build_prompts_budget, check_k
from ..operators.respond import RESPONSE_SCHEMA, prefix_commit, respond, score_items
from ..operators.scoring import report_dict, report_for, rescore
from ..session import parallelism, scratch_path
from ..sources.progress import Progress
from ..sources.items import catalog_of, requested_table, select_subsets, validate_subsets
from ..sources.runlog import append_log, overwrite_log, pending, read_log, read_mixed_logs
from ..sources.testdata import ExamItems, dev_items, test_items


@dataclass
class EvalResult:
    report: DataFrame
    failures: DataFrame
    counts: DataFrame
    staged: DataFrame  # what this run asked for; kept until the next run of its name

    def as_dict(self) -> dict[str, float | None]:
        """``{subset: mean score}`` in key order (one row per subset)."""
        return report_dict(self.report)


# False, True (the generic wrapper), a (before, after) pair, or a callable that
# takes the prompt column and gives the wrapped one
ChatTemplate = bool | tuple[str, str] | Callable[[Column], Column]


def _wrapped(prompt: Column, prefill: str, chat_template: ChatTemplate) -> Column:
    if callable(chat_template):
        return with_prefill(chat_template(prompt), prefill)
    if isinstance(chat_template, tuple):
        return chat_wrap(prompt, prefill, chat_template)
    return chat_wrap(prompt, prefill) if chat_template else with_prefill(prompt, prefill)


def _prefill(backend: str | None, cot: bool) -> str:
    if backend is None:
        return ""
    direct, reasoning = BACKEND_PREFILL[backend]
    if cot and reasoning is None:
        raise ValueError("chain-of-thought is not supported with the probability backend")
    return reasoning if cot else direct


def model_input(
    backend: str | None, cot: bool, chat_template: ChatTemplate = False
) -> Callable[[Column], Column]:
    """How a backend turns the prompt into its input (prefill and wrapper)."""
    if backend is None:
        return lambda p: p
    prefill = _prefill(backend, cot)
    if backend in ("hf", "vllm"):
        return lambda p: _wrapped(p, prefill, chat_template)
    if backend == "google":
        # single-string API: the stripped prefill is glued to the prompt
        return lambda p: flat_prefill(p, prefill)
    # chat APIs: [user: prompt, assistant: stripped prefill]; the responder
    # receives a list of {"role", "content"} records
    return lambda p: messages(p, prefill)


class RunPaused(RuntimeError):
    """The run has committed as many buckets as it was allowed to."""


STAGED = T.StructType([
    *RESPONSE_SCHEMA.fields,
    T.StructField("seq", T.LongType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("gold_answer", T.StringType()),
])


def evaluate(
    spark: SparkSession,
    items: DataFrame | ExamItems,
    factory: Callable[..., object],
    log_path: str,
    mode: str = "direct",
    style: str | None = None,
    k: int = 5,
    subsets: str | list[str] = "ALL",
    overwrite: bool = False,
    backend: str | None = None,
    chat_template: ChatTemplate = False,
    max_length: int | None = None,
    token_len: Callable[[Column], Column] = F.length,
    max_tries: int = DEFAULT_MAX_RETRIES,
    partitions: int | None = None,
    threads: int = 1,
    run_id: str | None = None,
    topic: str = TOPIC_LINE,
    strict: bool = False,
    log_format: str = "json",
    stop: list[str] | None = None,
    call_timeout: float | None = None,
    backoff: float = 0.0,
    target_rows_per_file: int = 200_000,
    isolate_runs: bool = False,
    reader: Callable[[Column], Column] | None = None,
    commits: int = 2,
    aside: tuple[str, ...] = (),
    tokenizer=None,
    context_length: int | None = None,
    mixed_log: bool = False,
    most_commits: int | None = None,
    **options,
) -> EvalResult:
    """Run (or resume) an evaluation and report accuracy per subset.

    ``strict`` reproduces stop-at-first-failure: per subset, only responses
    before the first failed call (in item order) are logged, and the run
    then raises. By default every success is logged and failures are
    returned in ``EvalResult.failures`` (a resume retries them).
    ``log_format="parquet"`` keeps a columnar log (JSON lines by default).
    ``stop`` truncates responses at the earliest stop sequence (for
    responders without stop support); by default the local engine (``vllm``)
    stops at the question tag. ``chat_template`` is a bool, a (before, after)
    pair or a callable on the prompt column. ``backoff`` see ``respond``.
    ``call_timeout`` bounds the wait for one call. The factory receives
    ``max_tokens``, ``temperature`` and ``timeout`` (defaults 128, 0.0, 20 s)
    plus any other ``options``; a failing call is tried up to ``max_tries``
    times (default 100). ``isolate_runs``
    keys resume and report on ``run_id`` as well, so runs with different
    settings can share one log folder without mixing. ``reader`` (response column to
    letter column) replaces the mode's own reader in the report; ``mode`` still
    shapes the prompts. ``commits`` is the number of buckets whose answers are committed
    one after another. ``aside`` columns of the items go to the responder beside the
    prompt. ``context_length`` (probability backend) cuts contexts from the left so that
    they fit with their option, in tokens of ``tokenizer`` (``functions.tokens``).
    ``mixed_log`` resumes from and reports on ``<subset>_out.jsonl`` files in the log
    folder as well, whose torn last lines are answered again. ``most_commits`` ends a
    run after so many buckets with ``RunPaused``; the next run goes on from there.
    """
    if isolate_runs and run_id is None:
        raise ValueError("isolate_runs needs a run_id")
    if not isinstance(subsets, str):
        subsets = ",".join(subsets)
    # run-shaping defaults handed to the user's client factory (overridable)
    options = {
        "max_tokens": DEFAULT_MAX_TOKENS,
        "temperature": DEFAULT_TEMPERATURE,
        "timeout": DEFAULT_TIMEOUT,
        **options,
    }
    check_k(k, None)  # bounded by the dev split, which build_prompts checks
    cot = mode == "cot"
    if style is None:
        style = BACKEND_STYLE.get(backend or "openai", "suffix")
    to_input = model_input(backend, cot, chat_template)

    if isinstance(items, ExamItems):
        everything, dev_all = items.all, items.dev
    else:
        everything, dev_all = items, dev_items(items)
    catalog = catalog_of(everything)
    names = validate_subsets(spark, subsets, catalog)
    test = select_subsets(test_items(everything), names)
    dev = select_subsets(dev_all, names)

    def this_log():
        if mixed_log:
            log, _ = read_mixed_logs(spark, log_path, names)
        else:
            log = read_log(spark, log_path, names, log_format)
        return log.where(F.col("run_id") == run_id) if isolate_runs else log

    if context_length is not None and (backend != "hf" or tokenizer is None):
        raise ValueError("context_length needs the probability backend and a tokenizer")
    if backend == "vllm" and stop is None:
        stop = [QUESTION_TAG]

    # items answered before, in the log or by a run that broke off, are dropped while
    # they are bare items; prompts are rendered after the last shuffle
    progress = Progress(spark, log_path, run_id, STAGED)
    answered = progress.answered(None if overwrite else this_log())
    open_items = test if overwrite else pending(test, this_log())
    if answered is not None:
        answered = select_subsets(answered, names)
        open_items = pending(open_items, answered)
    bucket = F.pmod(F.xxhash64("subset", "id"), F.lit(commits)).cast("int")
    work_path = scratch_path(spark, "open-items")
    # an open question shows no explanation
    open_items = open_items.drop("split", "explanation")
    open_items.withColumn("bucket", bucket).write.partitionBy("bucket").option("compression", "zstd").parquet(work_path)
    work_schema = T.StructType([*open_items.schema.fields, T.StructField("bucket", T.IntegerType())])
    work = spark.read.schema(work_schema).parquet(work_path)
    # a row a subset and bucket
    asked = work.groupBy("subset", "bucket").count().collect()

    options_kept = tuple(OPTION_LETTERS) if backend == "hf" else ()
    keep = (*options_kept, *aside)
    prefill = _prefill(backend, cot)

    def prompts_of(items):
        if max_length is None:
            return build_prompts(items, dev, k, style, cot, topic, keep=keep)
        if callable(chat_template):  # charged as it wraps an empty prompt
            wrapper = spark.range(1).select(chat_template(F.lit(""))).first()[0] + prefill
        elif isinstance(chat_template, tuple):
            wrapper = template_text(prefill, True, chat_template)
        else:
            wrapper = template_text(prefill, chat_template)
        return build_prompts_budget(
            items, dev, k, max_length, wrapper, style, cot, topic, token_len, keep=keep
        ).drop("budget_left")

    def responses_of(number):
        items = spark.read.schema(open_items.schema).parquet(f"{work_path}/bucket={number}")
        # calls are the slow part: spread them over every core by item key. The many
        # files of a large bucket are spread already, in bounded splits
        if partitions is not None or len(items.inputFiles()) < parallelism(spark):
            items = items.repartition(partitions or parallelism(spark), "subset", "id")
        todo = prompts_of(items)
        carry = ("seq", "prompt", "gold_answer")
        if backend == "hf":
            # probability path: every option present is scored by the model and
            # the arg-max label "X)" becomes the logged response
            rows = todo.withColumn("context", _wrapped(F.col("prompt"), prefill, chat_template)).withColumn(
                "n_options", F.size(take_present(option_array())))
            return score_items(rows, factory, max_tries=max_tries, backoff=backoff, carry=carry, aside=aside,
                               tokenizer=tokenizer, max_length=context_length, **options)
        rows = respond(
            todo.withColumn("model_input", to_input(F.col("prompt"))),
            factory,
            input_col="model_input",
            max_tries=max_tries,
            carry=carry,
            threads=threads,
            call_timeout=call_timeout,
            backoff=backoff,
            aside=aside,
            **options,
        )
        return rows.withColumn("full_response", cut_at_stops(F.col("full_response"), stop)) if stop else rows

    for done, number in enumerate(sorted({r["bucket"] for r in asked})):
        if most_commits is not None and done >= most_commits:
            raise RunPaused(f"{done} buckets are answered; the next run goes on from there")
        progress.commit(responses_of(number), number)
    fresh = progress.rows()

    # every open item must have come back, answered or failed; the log is unchanged yet
    expected: dict[str, int] = {}
    for r in asked:
        expected[r["subset"]] = expected.get(r["subset"], 0) + r["count"]
    back = {r["subset"]: r for r in fresh.groupBy("subset").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error").isNull()).alias("answers")).collect()}
    short = sorted(s for s, n in expected.items() if s not in back or back[s]["rows"] != n)
    if short:
        raise RuntimeError(f"not every item came back in subsets {short}")
    counts = spark.createDataFrame(
        [(s, n, back[s]["answers"], n - back[s]["answers"]) for s, n in expected.items()],
        "subset string, n_expected long, n_answered long, n_missing long")
    staged = fresh if answered is None else fresh.unionByName(answered)

    if names is None:
        # ALL: every subset with test items is in the staged rows or already
        # in the log, and the cached dev side covers the rest; no extra pass
        # over the items just to list subset names
        evaluated = staged.select("subset").unionByName(dev_all.select("subset")).distinct()
        requested = evaluated.unionByName(this_log().select("subset")).distinct()
    else:
        requested = requested_table(spark, subsets, catalog)
        evaluated = requested

    ok = staged.where(F.col("error").isNull())
    if strict:
        ok = prefix_commit(staged.withColumn("failed", F.col("error").isNotNull()), "failed", "seq")
    if overwrite:
        targets = names or [r["subset"] for r in evaluated.collect()]
        overwrite_log(spark, ok, log_path, targets, run_id, log_format, target_rows_per_file, isolate_runs)
    else:
        append_log(ok, log_path, run_id, log_format, target_rows_per_file)

    failed = [s for s, r in back.items() if r["answers"] < r["rows"]]
    # answers behind a failure stay in the progress folder of a strict run
    if not (strict and failed and not overwrite):
        progress.finish()
    if strict:
        if failed:
            raise RuntimeError(f"calls failed in subsets {sorted(failed)}; only earlier items were logged")

    result = report_for(rescore(this_log(), None, reader or mode), requested)
    return EvalResult(result, fresh.where(F.col("error").isNotNull()), counts, fresh)
