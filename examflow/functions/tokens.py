"""Token counting for the few-shot budget.

A token counter is any ``Column -> Column`` giving an integer per string.
The default counts characters (code points) natively; a real tokenizer runs
as a vectorised pandas UDF (Arrow batches, the tokenizer loaded once per
Python worker), never a row-at-a-time UDF.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def char_len(c) -> Column:
    """Characters (code points), as Python's ``len``."""
    return F.length(_c(c))


def whitespace_len(c) -> Column:
    """Words separated by ASCII whitespace, natively."""
    words = F.filter(F.split(_c(c), r"\s+", -1), lambda w: w != "")
    return F.size(words)


# text -> (id, start, end) of its tokens; the places are code points
Spans = list[tuple[int, int, int]]


class PatternTokenizer:
    """Tokens are the matches of a pattern; an id is the match's place in the text."""

    def __init__(self, pattern: str):
        self.pattern = re.compile(pattern)

    def spans(self, text: str) -> Spans:
        return [(k, *m.span()) for k, m in enumerate(self.pattern.finditer(text))]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(self.pattern.findall(t)) for t in texts]

    def bounds(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, starts and ends of the tokens."""
        found = [] if self.pattern.groups else self.pattern.findall(text)
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        if len(found) and lengths.sum() == len(text):  # the matches lie side by side
            ends = np.cumsum(lengths, dtype=np.int32)
            return np.arange(len(ends), dtype=np.int32), ends - lengths, ends
        return _arrays(self.spans(text))


def _arrays(spans: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = np.asarray(spans, np.int32).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def _bounds(tokenizer, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = getattr(tokenizer, "bounds", None)
    return _arrays(tokenizer.spans(text)) if own is None else own(text)


class FileTokenizer:
    """A ``tokenizers`` JSON file, without added special tokens. Loaded once a worker;
    counts are kept for texts that come again (few-shot examples, topic lines). Texts are
    encoded some ``AT_ONCE`` characters at a time, as an encoding is many times its text."""

    KEPT = 10_000
    KEPT_CHARS = 8_000_000
    AT_ONCE = 1_000_000
    _loaded: dict[str, tuple] = {}

    def __init__(self, path: str):
        self.path = path

    def _get(self):
        if self.path not in self._loaded:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer  # optional dependency

            self._loaded[self.path] = (Tokenizer.from_file(self.path), {})
        return self._loaded[self.path]

    def spans(self, text: str) -> Spans:
        e = self._get()[0].encode(text, add_special_tokens=False)
        return [(i, *o) for i, o in zip(e.ids, e.offsets, strict=True)]

    def counts(self, texts: list[str]) -> list[int]:
        tok, known = self._get()
        new = list(set(texts) - known.keys())
        chars = sum(map(len, new))
        if len(known) + len(new) > self.KEPT or sum(map(len, known)) + chars > self.KEPT_CHARS:
            kept, known = known, {}
            self._loaded[self.path] = (tok, known)
        else:
            kept = known
        fresh, part, size = {}, [], 0
        for k, text in enumerate(new, start=1):
            part.append(text)
            size += len(text)
            if size >= self.AT_ONCE or k == len(new):
                fresh.update(zip(part, (len(e.ids) for e in tok.encode_batch(part, add_special_tokens=False)), strict=True))
                part, size = [], 0
        out = [kept[t] if t in kept else fresh[t] for t in texts]
        if len(fresh) <= self.KEPT and chars <= self.KEPT_CHARS:
            known.update(fresh)
        return out


def cut_left(context: str, continuation: str, max_length: int, tokenizer) -> tuple[str, int, int]:
    """(text, tokens kept, tokens of the continuation): the last tokens of ``context``
    that leave room for the continuation's within ``max_length``, as ``[-n:]`` takes them
    (all if n is 0). The continuation's tokens are those of the whole after the
    context's. A code point that is cut through is dropped."""
    return cuts_left(context, [continuation], max_length, tokenizer)[0]


def cuts_left(context: str, continuations: list[str], max_length: int, tokenizer) -> list[tuple[str, int, int]]:
    """``cut_left`` for several continuations of one context, which is taken apart once."""
    _, starts, ends = _bounds(tokenizer, context)
    size, out = len(starts), []
    for whole in tokenizer.counts([context + c for c in continuations]) if continuations else []:
        own = max(whole - size, 0)
        n = max_length - own
        first = max(size - n, 0) if n > 0 else 0 if n == 0 else min(-n, size)
        if first == 0:
            out.append((context, size, own))
        elif first == size:
            out.append(("", 0, own))
        else:
            out.append((context[max(int(starts[first]), int(ends[first - 1])) :], size - first, own))
    return out


def _ready() -> None:
    from pyspark.sql import SparkSession

    from ..session import ship_package, small_batches

    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)
        small_batches(active)


_SPAN = pa.struct([("id", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def token_spans(tokenizer) -> Callable[[Column], Column]:
    """Column of ``array<struct<id, start, end>>``, in Arrow batches; a text that a batch
    has several times is taken apart once."""
    @F.arrow_udf("array<struct<id:int,start:int,end:int>>")
    def _spans(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        parts = [_bounds(tokenizer, t.as_py()) for t in coded.dictionary]
        columns = [np.concatenate(c) if c else np.zeros(0, np.int32) for c in (zip(*parts) if parts else ([], [], []))]
        offsets = np.cumsum([0, *(len(p[0]) for p in parts)], dtype=np.int32)
        fields = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], fields=list(_SPAN))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields).take(coded.indices)

    def apply(c) -> Column:
        _ready()
        return _spans(_c(c))

    return apply


def text_of_last(text: Column, spans: Column, n: Column | int) -> Column:
    """The text of the last ``n`` tokens (``loglik.left_truncate``) of ``token_spans``."""
    from ..operators.loglik import left_truncate

    kept = left_truncate(spans, n)
    dropped = F.get(spans, F.size(spans) - F.size(kept) - 1)["end"]
    start = F.greatest(F.get(kept, 0)["start"], dropped)  # greatest skips null
    return F.when(F.size(kept) == F.size(spans), text).when(F.size(kept) == 0, F.lit("")).otherwise(
        F.substring(text, start + 1, F.char_length(text)))


def cut_contexts(tokenizer, max_length: int) -> Callable[[Column, Column], Column]:
    """Column ``struct<text, n_kept, n_conti>`` of contexts cut for their continuations."""
    @F.arrow_udf("struct<text:string,n_kept:int,n_conti:int>")
    def _cut(contexts: pa.Array, continuations: pa.Array) -> pa.Array:
        # the requests of one context together
        coded = contexts.dictionary_encode()
        codes = np.asarray(coded.indices)
        order = np.argsort(codes, kind="stable")
        cuts: list = [None] * len(contexts)
        own = continuations.to_pylist()
        for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else []:
            context = coded.dictionary[int(codes[rows[0]])].as_py()
            for k, cut in zip(rows, cuts_left(context, [own[k] for k in rows], max_length, tokenizer), strict=True):
                cuts[k] = cut
        return pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*cuts) if cuts else ([], [], []), (pa.string(), pa.int32(), pa.int32()), strict=True)],
            names=["text", "n_kept", "n_conti"])

    def apply(context, continuation) -> Column:
        _ready()
        return _cut(_c(context), _c(continuation))

    return apply


def tokenizer_len(tokenizer) -> Callable[[Column], Column]:
    """A counter backed by a tokenizer object, a batch at a time."""
    @F.pandas_udf("int")
    def _count(texts: pd.Series) -> pd.Series:
        there = texts.dropna()
        return pd.Series(tokenizer.counts(there.tolist()), index=there.index, dtype="Int32").reindex(texts.index)

    def apply(c) -> Column:
        _ready()
        return _count(_c(c))

    return apply


def token_len_udf(make_encoder: Callable[[], Callable[[str], list]]) -> Callable[[Column], Column]:
    """A counter backed by a tokenizer: ``make_encoder()`` is called once per
    worker process and returns ``encode(text) -> list of ids``."""
    state: dict[str, Callable[[str], list]] = {}

    @F.pandas_udf("int")
    def _count(texts: pd.Series) -> pd.Series:
        enc = state.get("enc")
        if enc is None:
            enc = state["enc"] = make_encoder()
        return texts.map(lambda t: None if t is None else len(enc(t))).astype("Int32")

    def apply(c) -> Column:
        _ready()
        return _count(_c(c))

    return apply


def tokenizer_file_len(path: str) -> Callable[[Column], Column]:
    """Counter for a ``tokenizers`` JSON file (no special tokens added)."""
    return tokenizer_len(FileTokenizer(path))
