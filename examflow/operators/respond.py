"""Handing prompts to a user-supplied responder, in Arrow batches.

A responder is built once per task by ``factory(**options)`` (so clients and
models live on the executors, never in the driver) and is either

* a callable ``prompt -> text`` (one call per row, like a chat API),
* an object with ``attempt(prompt, number) -> text``, which is told the number of the
  attempt (from 1), or
* an object with ``batch(prompts: list[str]) -> list[str]`` (an engine that
  takes the whole batch at once).

Per row, a failed call is retried up to ``max_tries`` attempts in total; when
they are exhausted the row comes out with ``error`` set and no response,
instead of failing the task (a failed task would re-issue every call of its
partition). The rows are keyed by ``(subset, id)``, never by position.

``partitions`` fixes how many tasks call the service concurrently; rows are
spread by a hash of the key, so a large subset does not serialise its calls.
``threads`` > 1 additionally keeps that many calls in flight per task (the
responder must then be thread-safe); outputs keep the input order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
import queue
import random
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package, small_batches

RESPONSE_SCHEMA = T.StructType(
    [
        T.StructField("subset", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("full_response", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
    ]
)


MAX_BACKOFF = 30.0


def _timed(fn: Callable[[str], str], prompt: str, seconds: float) -> str:
    """One call on a thread of its own: its clock starts with the call, and a call
    that hangs costs no other call its thread."""
    done: queue.SimpleQueue = queue.SimpleQueue()

    def work():
        try:
            done.put((fn(prompt), None))
        except BaseException as e:  # noqa: BLE001 - handed to the caller
            done.put((None, e))

    threading.Thread(target=work, daemon=True).start()
    try:
        text, error = done.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds} s") from None
    if error is not None:
        raise error
    return text


def _back_off(attempt: int, first: float) -> None:
    """Wait before the next attempt: doubled each time, with jitter, bounded."""
    if first > 0:
        time.sleep(min(first * 2 ** (attempt - 1), MAX_BACKOFF) * random.uniform(0.5, 1.0))


def _call_with_retries(
    fn: Callable[[str], str], prompt: str, max_tries: int, call_timeout=None, backoff: float = 0.0
):
    last = None
    numbered = getattr(fn, "attempt", None)
    for attempt in range(1, max(max_tries, 1) + 1):
        call = fn if numbered is None else (lambda p, n=attempt: numbered(p, n))
        try:
            if call_timeout is None:
                return call(prompt), None, attempt
            return _timed(call, prompt, call_timeout), None, attempt
        except PermissionError as e:  # a refused key is not retried
            return None, f"{type(e).__name__}: {e}", attempt
        except Exception as e:  # noqa: BLE001 - any other client error (or timeout) is retried
            last = e
            if attempt < max_tries:
                _back_off(attempt, backoff)
    return None, f"{type(last).__name__}: {last}", max(max_tries, 1)


def _in_request_order(outputs) -> list:
    """Batch engines may hand back ``(request_id, text)`` pairs in completion
    order; put them back in request order (numeric ids, not lexical)."""
    outputs = list(outputs)
    if outputs and isinstance(outputs[0], tuple):
        outputs = [text for _rid, text in sorted(outputs, key=lambda o: int(o[0]))]
    return outputs


def respond(
    df: DataFrame,
    factory: Callable[..., object],
    input_col: str = "prompt",
    max_tries: int = 1,
    partitions: int | None = None,
    keys: tuple[str, str] = ("subset", "id"),
    carry: tuple[str, ...] = (),
    threads: int = 1,
    call_timeout: float | None = None,
    backoff: float = 0.0,
    aside: tuple[str, ...] = (),
    **options,
) -> DataFrame:
    """``subset, id, full_response, error, attempts`` (+ ``carry`` columns,
    passed through untouched) for every input row.

    With ``aside`` columns the responder gets ``{"input": prompt, column: value, ...}``
    instead of the prompt alone.

    ``call_timeout`` (seconds) stops waiting for a call that hangs and counts
    it as a failed attempt, for clients without a timeout of their own
    (``options`` such as ``timeout`` go to the factory for clients that have one).
    ``backoff`` is the wait in seconds after a first failed attempt; it doubles with
    each further one. A ``PermissionError`` is final at once.
    """
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    payload = df.select(*keys, F.col(input_col).alias("__input"), *aside, *carry)
    out_schema = T.StructType(RESPONSE_SCHEMA.fields + [df.schema[c] for c in carry])
    if partitions:
        payload = payload.repartition(partitions, *keys)
    k0, k1 = keys

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        responder = factory(**options)
        batch_fn = getattr(responder, "batch", None)
        for pdf in batches:
            prompts = pdf["__input"].tolist()
            if aside:
                rows = pdf[list(aside)].to_dict("records")
                prompts = [{"input": p, **row} for p, row in zip(prompts, rows, strict=True)]
            if batch_fn is not None:
                texts, errors, tries = None, None, 0
                for attempt in range(1, max(max_tries, 1) + 1):
                    tries = attempt
                    try:
                        texts = _in_request_order(batch_fn(prompts))
                        errors = [None] * len(prompts)
                        break
                    except Exception as e:  # noqa: BLE001
                        errors = [f"{type(e).__name__}: {e}"] * len(prompts)
                        if attempt < max_tries:
                            _back_off(attempt, backoff)
                if texts is not None and len(texts) != len(prompts):
                    raise ValueError(
                        f"responder returned {len(texts)} outputs for {len(prompts)} prompts"
                    )
                texts = texts if texts is not None else [None] * len(prompts)
                attempts = [tries] * len(prompts)
            else:
                def one(p):
                    return _call_with_retries(responder, p, max_tries, call_timeout, backoff)

                if threads > 1:
                    with ThreadPoolExecutor(max_workers=threads) as pool:
                        results = list(pool.map(one, prompts))
                else:
                    results = [one(p) for p in prompts]
                texts = [r[0] for r in results]
                errors = [r[1] for r in results]
                attempts = [r[2] for r in results]
            out = pd.DataFrame(
                {
                    "subset": pdf[k0],
                    "id": pdf[k1],
                    "full_response": texts,
                    "error": errors,
                    "attempts": pd.array(attempts, dtype="int32"),
                }
            )
            for c in carry:
                out[c] = pdf[c]
            yield out

    return payload.mapInPandas(run, out_schema)


LOGLIK_SCHEMA = T.StructType(
    [
        T.StructField("subset", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("choice", T.StringType()),
        T.StructField("loglik", T.DoubleType()),
    ]
)


def score_options(
    requests: DataFrame, factory: Callable[..., object], partitions: int | None = None,
    max_tries: int = 1, backoff: float = 0.0, **options
) -> DataFrame:
    """``subset, id, choice, loglik`` from a model's ``loglik(contexts,
    continuations) -> list[float]`` (the summed log-probability of each
    continuation after its context), called once per Arrow batch.

    All options of an item travel together (rows are spread by item key),
    so an engine can share the context's work between them.
    """
    ship_package(requests.sparkSession)
    small_batches(requests.sparkSession)
    payload = requests.select("subset", "id", "choice", "context", "continuation")
    if partitions:
        payload = payload.repartition(partitions, "subset", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory(**options)
        for pdf in batches:
            for attempt in range(1, max(max_tries, 1) + 1):
                try:
                    scores = list(model.loglik(pdf["context"].tolist(), pdf["continuation"].tolist()))
                    break
                except Exception:  # noqa: BLE001 - retried, then the task fails
                    if attempt >= max_tries:
                        raise
                    _back_off(attempt, backoff)
            if len(scores) != len(pdf):
                raise ValueError(f"model returned {len(scores)} scores for {len(pdf)} requests")
            yield pd.DataFrame(
                {
                    "subset": pdf["subset"],
                    "id": pdf["id"],
                    "choice": pdf["choice"],
                    "loglik": pd.array(scores, dtype="float64"),
                }
            )

    return payload.mapInPandas(run, LOGLIK_SCHEMA)


def score_items(
    items: DataFrame, factory: Callable[..., object], max_tries: int = 1, backoff: float = 0.0,
    carry: tuple[str, ...] = (), aside: tuple[str, ...] = (), tokenizer=None, max_length: int | None = None, **options
) -> DataFrame:
    """``subset, id, full_response, error, attempts`` (+ ``carry``): the label ``X)`` of
    the option with the highest score, for rows ``subset, id, context, n_options``.

    An item is one row; its options (A, B, ...) are laid out inside the Arrow batch, so
    the context is neither copied through a shuffle nor joined back. ``max_length`` cuts
    each context with ``tokenizer`` so that it fits with its option. Ties go to the
    earlier letter, NaN counts as the highest. An item without options has no response.
    With ``aside`` columns the model gets them as a third list, a dict an option.
    """
    from ..functions.tokens import cuts_left

    ship_package(items.sparkSession)
    small_batches(items.sparkSession)
    payload = items.select("subset", "id", "context", "n_options", *aside, *carry)
    out_schema = T.StructType(RESPONSE_SCHEMA.fields + [items.schema[c] for c in carry])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory(**options)
        for pdf in batches:
            owner, contexts, letters = [], [], []
            for k, (context, n) in enumerate(zip(pdf["context"], pdf["n_options"], strict=True)):
                own = [chr(65 + option) for option in range(n)]
                owner += [k] * n
                letters += own
                contexts += [context] * n if max_length is None else [
                    cut[0] for cut in cuts_left(context, own, max_length, tokenizer)]
            args = [contexts, letters]
            if aside:
                rows = pdf[list(aside)].to_dict("records")
                args.append([rows[k] for k in owner])
            for attempt in range(1, max(max_tries, 1) + 1):
                try:
                    scores = list(model.loglik(*args)) if owner else []
                    break
                except Exception:  # noqa: BLE001 - retried, then the task fails
                    if attempt >= max_tries:
                        raise
                    _back_off(attempt, backoff)
            if len(scores) != len(owner):
                raise ValueError(f"model returned {len(scores)} scores for {len(owner)} requests")
            best: dict[int, tuple] = {}
            for k, letter, x in zip(owner, letters, scores, strict=True):
                key = (x != x, x if x == x else 0.0)  # NaN first, then the number
                if k not in best or key > best[k][0]:
                    best[k] = (key, letter + ")")
            out = pd.DataFrame({
                "subset": pdf["subset"], "id": pdf["id"],
                "full_response": [best[k][1] if k in best else None for k in range(len(pdf))],
                "error": [None] * len(pdf), "attempts": pd.array([attempt] * len(pdf), dtype="int32")})
            for c in carry:
                out[c] = pdf[c]
            yield out

    return payload.mapInPandas(run, out_schema)


def reconcile(expected: DataFrame, responses: DataFrame) -> DataFrame:
    """``subset, n_expected, n_answered, n_missing`` in one aggregation.

    Both sides are tagged and unioned, so there is one shuffle with partial
    counts rather than two aggregations and a join.
    """
    tagged = expected.select("subset", F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(
        responses.select(
            "subset",
            F.lit(0).alias("e"),
            F.when(F.col("error").isNull(), 1).otherwise(0).alias("a"),
        )
    )
    return tagged.groupBy("subset").agg(
        F.sum("e").cast("long").alias("n_expected"),
        F.sum("a").cast("long").alias("n_answered"),
        (F.sum("e") - F.sum("a")).cast("long").alias("n_missing"),
    )


def prefix_commit(df: DataFrame, failed: str = "failed", order: str = "seq") -> DataFrame:
    """Rows of each subset strictly before its first failure (in ``order``).

    The first failure per subset is a partial-aggregated ``min`` (one small
    row per subset), attached by a size-checked broadcast; no window sorts a
    whole subset in one task.
    """
    from .joins import attach_small

    first_fail = (
        df.where(F.col(failed))
        .groupBy("subset")
        .agg(F.min(order).alias("__first_fail"))
    )
    joined = attach_small(df, first_fail, ["subset"], "left", salt_by=F.col("id"))
    keep = F.col("__first_fail").isNull() | (F.col(order) < F.col("__first_fail"))
    return joined.where(keep).drop("__first_fail")
