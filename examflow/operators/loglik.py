"""Probability-based choice from a logits table.

Input rows: ``subset, id, choice, pos, token_id, logits array<double>`` —
one row per scored continuation position of an option, where ``logits`` is
the model's score vector at the position that predicts ``token_id``.

choice log-likelihood = sum over its positions of log_softmax(logits)[token_id]
prediction            = the option with the highest log-likelihood; ties go
                        to the earliest letter, NaN counts as the highest.

Everything is array arithmetic on columns; the only shuffle is on the item key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    A column expression referenced inside a higher-order function's lambda is
    re-evaluated for every element; binding it first keeps array maths linear.
    """
    return F.get(F.transform(F.array(value), body), 0)


def log_sum_exp(arr) -> Column:
    """``max + ln(sum(exp(x - max)))``: the max comes from the compiled
    ``array_max`` and is bound once, so the lambda does plain double
    arithmetic per element (linear, as fast as NumPy on a 4k vocabulary in
    our probe). NaN propagates; an empty array gives null."""
    a = _c(arr)
    zero = F.lit(0.0).cast("double")
    return _let(
        F.array_max(a),
        lambda m: m + F.log(F.aggregate(a, zero, lambda acc, x: acc + F.exp(x - m))),
    )


def log_softmax(logits) -> Column:
    """``x - logsumexp(x)`` element-wise (linear in the vocabulary size)."""
    arr = _c(logits)
    return _let(log_sum_exp(arr), lambda lse: F.transform(arr, lambda x: x - lse))


def token_logprob(logits, token_id) -> Column:
    """log_softmax(logits)[token_id]; a token id out of range raises."""
    arr = _c(logits)
    return _score_at(arr, _c(token_id)) - log_sum_exp(arr)


def _score_at(arr: Column, token_id: Column) -> Column:
    bad = arr.isNotNull() & ((token_id < 0) | (token_id >= F.size(arr)))
    return F.when(bad, F.raise_error(F.concat(F.lit("token id out of range: "), token_id.cast("string"))).cast("double")
                  ).otherwise(F.get(arr, token_id))


def shifted_pairs(logits_seq, token_ids, n) -> Column:
    """For the last ``n`` tokens, pair each with the logits of the position
    before it (position t predicts token t+1): ``array<struct<logits, token_id>>``.

    ``logits_seq`` holds one score vector per input position of the
    sequence without its last token; ``token_ids`` is the full sequence.
    """
    seq, toks = _c(logits_seq), _c(token_ids)
    n = F.lit(n) if isinstance(n, int) else _c(n)
    # fewer positions than tokens to score would score a part only
    k = F.when(n > F.size(seq), F.raise_error(F.lit("fewer logits than tokens to score")).cast("int")).otherwise(n)
    return F.arrays_zip(
        F.slice(seq, F.size(seq) - k + 1, k).alias("logits"),
        F.slice(toks, F.size(toks) - k + 1, k).alias("token_id"),
    )


def continuation_logprob(logits_seq, token_ids, n) -> Column:
    """Sum of the log-probabilities of the last ``n`` tokens of a sequence."""
    pairs = shifted_pairs(logits_seq, token_ids, n)
    return F.aggregate(
        pairs,
        F.lit(0.0).cast("double"),
        lambda acc, p: acc + token_logprob(p["logits"], p["token_id"]),
    )


def _token_rows(logits_table: DataFrame) -> DataFrame:
    return logits_table.select(
        "subset", "id", "choice", token_logprob("logits", "token_id").alias("lp")
    )


def choice_loglik(logits_table: DataFrame) -> DataFrame:
    """``subset, id, choice, loglik`` (partial sums before one shuffle)."""
    return (
        _token_rows(logits_table)
        .groupBy("subset", "id", "choice")
        .agg(F.sum("lp").alias("loglik"))
    )


def _best(pairs: Column) -> Column:
    """Arg-max over ``array<struct<loglik, neg>>``: highest log-likelihood,
    then the earliest letter (largest ``neg``); NaN sorts above numbers."""
    return F.array_max(pairs)


def choose(loglik: DataFrame) -> DataFrame:
    """``subset, id, prediction ('X)'), loglik`` from per-choice sums."""
    best = F.max(F.struct(F.col("loglik"), (-F.ascii("choice")).alias("neg")))
    return (
        loglik.groupBy("subset", "id")
        .agg(best.alias("b"))
        .select(
            "subset",
            "id",
            F.concat(F.char(-F.col("b.neg")), F.lit(")")).alias("prediction"),
            F.col("b.loglik").alias("loglik"),
        )
    )


def choose_from_logits(logits_table: DataFrame) -> DataFrame:
    """``subset, id, prediction, loglik`` straight from the logits table with a
    single shuffle on the item key.

    An item's rows (options x scored positions, a handful) are gathered per
    item, summed per option and reduced to the arg-max with array
    functions. Items are never hot keys, so the gathered groups stay small.
    """
    per_item = _token_rows(logits_table).groupBy("subset", "id").agg(
        F.collect_list(F.struct("choice", "lp")).alias("rows")
    )
    choices = F.array_sort(F.array_distinct(F.transform("rows", lambda r: r["choice"])))
    sums = F.transform(
        choices,
        lambda c: F.struct(
            F.aggregate(
                F.filter("rows", lambda r: r["choice"] == c),
                F.lit(0.0).cast("double"),
                lambda acc, r: acc + r["lp"],
            ).alias("loglik"),
            (-F.ascii(c)).alias("neg"),
        ),
    )
    best = _best(sums)
    return per_item.select(
        "subset",
        "id",
        F.concat(F.char(-best["neg"]), F.lit(")")).alias("prediction"),
        best["loglik"].alias("loglik"),
    )


def left_truncate(tokens, n) -> Column:
    """Python's ``tokens[-n:]``: the last n when n > 0, all when n == 0, and
    everything after the first |n| when n < 0."""
    a, n = _c(tokens), _c(n) if not isinstance(n, int) else F.lit(n)
    size = F.size(a)
    keep_last = F.slice(a, F.greatest(size - n, F.lit(0)) + 1, F.greatest(F.least(n, size), F.lit(0)))
    drop_first = F.slice(a, F.least(-n, size) + 1, F.greatest(size + n, F.lit(0)))
    return F.when(n > 0, keep_last).when(n == 0, a).otherwise(drop_first)


def continuation(context_tokens, whole_tokens) -> Column:
    """Tokens of ``encode(context + continuation)`` after the context's own tokens."""
    ctx, whole = _c(context_tokens), _c(whole_tokens)
    n = F.greatest(F.size(whole) - F.size(ctx), F.lit(0))
    return F.slice(whole, F.size(ctx) + 1, n)


def loglik_requests(prompts: DataFrame, prefill: str = "") -> DataFrame:
    """What a model must score: one row per option present (take-while over
    ``A``..``F``), with the context (prompt + prefill) and the continuation
    (the option letter). ``prompts`` must carry the option columns."""
    from ..functions.templates import option_array, take_present, with_prefill

    opts = prompts.select(
        "subset",
        "id",
        with_prefill(F.col("prompt"), prefill).alias("context"),
        F.posexplode(take_present(option_array())).alias("pos", "option_text"),
    )
    return opts.select(
        "subset", "id", F.char(F.col("pos") + 65).alias("choice"), "context",
        F.char(F.col("pos") + 65).alias("continuation"),
    )


def loglik_responses(logits_table: DataFrame) -> DataFrame:
    """``subset, id, full_response``: the chosen label ``X)`` as the response
    of the probability path, to be logged and scored like generated text."""
    return choose_from_logits(logits_table).select(
        "subset", "id", F.col("prediction").alias("full_response")
    )


def continuation_scores(logits: DataFrame, tokens: DataFrame) -> DataFrame:
    """``subset, id, n, loglik``: the summed log-probability of each sequence's last ``n``
    tokens, with one row a position: ``logits(subset, id, pos, logits)`` and
    ``tokens(subset, id, pos, token_id, n)``.

    Position t predicts token t + 1, so the tables meet on the position shifted by one:
    long sequences are spread over tasks by position, and only partial sums meet. A token
    without a score vector before it raises.
    """
    keys = ["subset", "id"]
    ends = tokens.groupBy(*keys).agg((F.max("pos") + 1).alias("length"))
    scored = tokens.join(ends, keys).filter(F.col("pos") >= F.col("length") - F.col("n"))
    aligned = scored.join(logits.select(*keys, (F.col("pos") + 1).alias("pos"), "logits"), [*keys, "pos"], "left")
    missing = F.raise_error(F.lit("fewer logits than tokens to score")).cast("double")
    lp = F.when(F.col("logits").isNull(), missing).otherwise(token_logprob("logits", "token_id"))
    return aligned.select(*keys, "n", lp.alias("lp")).groupBy(*keys, "n").agg(F.sum("lp").alias("loglik"))
