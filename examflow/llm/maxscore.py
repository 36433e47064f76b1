"""Exact top-k by inner product with MaxScore.

A term is a dimension; its postings are the candidates' components, and for a query it
can add at most the larger of its products with the shard's extreme components. The
terms of each query are sorted by that bound. Once k candidates are scored, the low
terms that together stay below a small part of the k-th best score are non-essential:
only the essential postings are traversed, for a chunk of queries at once, and the
candidates that could still reach the k-th score are probed in the other terms, group by
group, while they stay competitive. A shard is traversed in parts, each twice as long as
the one before, so that most of it meets a high k-th score. Every pair of a block of
queries and a shard of candidates is one group of bounded size; the tops of the shards
are merged by a window limit.

* Components are floor(64 * x) by default; vectors that are null or hold null, NaN
  or infinite components take no part, nor do rows without an id. A shorter vector
  counts as padded with 0. Repeated rows are candidates of their own; equal repeated
  query rows are one query, and a query's own id is never its candidate.
* Ties go to the smaller vec_id. Scores beyond 64 bits are held at its ends, and so
  are scaled components beyond the range of doubles.
* Empty table: no rows. Extra columns are dropped.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import python_ready

QUERY_BLOCK = 8192
SHARD = 8192
CHUNK = 512  # queries that traverse the postings together
FIRST = 1024  # candidates of the first part of a shard
PAIRS = 1 << 17  # probed at a time
# Dense vectors have every term, so a rest of the bounds just under the k-th score would
# leave half of them to be probed: non-essential terms add less than this part of it.
SHARE = 16
_TOP = (1 << 63) - 1
_MOST = sys.float_info.max


def top_of_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
                 step: int = 8, first: int = FIRST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, ids, scores): the k best candidates of one shard for each query, ties
    to smaller ids, by query row and rank."""
    n, d = vectors.shape
    most = np.maximum(queries * vectors.max(0, initial=0), queries * vectors.min(0, initial=0))
    order = np.argsort(-most, axis=1, kind="stable")
    most = np.take_along_axis(most, order, 1)
    rest = np.zeros((len(queries), d + 1), most.dtype)  # what terms i.. can add
    rest[:, :d] = np.cumsum(most[:, ::-1], 1)[:, ::-1]
    # no score is as low
    least = -(np.abs(queries) @ np.abs(vectors).max(0, initial=0)) - 1
    q, c, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, most.dtype)
    a, b = 0, min(first, n)
    while a < b:
        done = (rest[:, :d] * SHARE >= least[:, None]).sum(1)
        weight = np.zeros_like(queries)
        np.put_along_axis(weight, order, np.where(np.arange(d) < done[:, None], np.take_along_axis(queries, order, 1), 0), 1)
        used = (weight != 0).any(0)
        part = weight[:, used] @ vectors[a:b, used].T
        same = np.flatnonzero(np.isin(ids[a:b], query_ids))
        own, at = np.nonzero(query_ids[:, None] == ids[a:b][same])
        part[own, same[at]] = -np.inf
        if not a and b > k:
            least = np.maximum(least, np.partition(part, b - k, axis=1)[:, b - k])
        new_q, new_c, new_score = _probe(vectors, queries, order, rest, least, done, part, a, step)
        q, c, score = np.append(q, new_q), np.append(c, new_c), np.append(score, new_score)
        best = np.lexsort((ids[c], -score, q))
        q, c, score = q[best], c[best], score[best]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < k
        full = place == k - 1
        least[q[full]] = np.maximum(least[q[full]], score[full])
        q, c, score = q[keep], c[keep], score[keep]
        a, b = b, min(2 * b, n)
    return q, ids[c], score


def _probe(vectors: np.ndarray, queries: np.ndarray, order: np.ndarray, rest: np.ndarray, least: np.ndarray,
           done: np.ndarray, part: np.ndarray, first: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, places, scores) of the candidates from ``first`` on that reach the k-th
    score; ``part`` has what the first ``done`` terms of each query add."""
    d = queries.shape[1]
    rows = np.arange(len(queries))
    q, c = np.nonzero(part >= (least - rest[rows, done])[:, None])
    score, at, c = part[q, c], done[q], c + first
    found = []
    for i in range(0, len(q), PAIRS):
        x, y, s, t = (v[i : i + PAIRS] for v in (q, c, score, at))
        while (t < d).any():
            terms = t[:, None] + np.arange(step)
            cols = order[x[:, None], np.minimum(terms, d - 1)]
            gain = queries[x[:, None], cols] * vectors[y[:, None], cols]
            s = s + np.where(terms < d, gain, 0).sum(1)
            t = np.minimum(t + step, d)
            keep = s + rest[x, t] >= least[x]
            x, y, s, t = x[keep], y[keep], s[keep], t[keep]
        found.append((x, y, s))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (q, c, score)


def _matrix(values: pa.ChunkedArray, width: int) -> np.ndarray:
    lengths = pc.list_value_length(values).to_numpy()
    flat = pc.list_flatten(values).to_numpy()
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    python_ready(spark)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    # floor of a double stays a double here, so that huge values don't overflow
    held = lambda x: F.greatest(F.least(x, F.lit(_MOST)), F.lit(-_MOST))
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(held(x * scale))
    vecs = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite)
    ).withColumn("v", F.transform("v", whole))
    queries = vecs.filter(is_query).distinct()
    n, q = vecs.count(), queries.count()
    shards, blocks = -(-n // SHARD) or 1, -(-q // QUERY_BLOCK) or 1
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("block", deal(blocks)).withColumn("shard", every(shards))
    right = vecs.withColumn("shard", deal(shards)).withColumn("block", every(blocks))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        width = max([pc.max(pc.list_value_length(x["v"])).as_py() or 0 for x in (a, b) if len(x)], default=0)
        sides = [(x["vec_id"].to_numpy(), _matrix(x["v"], width)) for x in (a, b)]
        # rows whose products might leave the integers that doubles hold go by themselves
        small = [np.abs(m).max(1, initial=0) < (2**52 / max(width, 1)) ** 0.5 / 2 for _, m in sides]
        for of_a, of_b in ((x, y) for x in (small[0], ~small[0]) for y in (small[1], ~small[1])):
            (query_ids, qs), (ids, c) = ((i[x], m[x]) for (i, m), x in zip(sides, (of_a, of_b), strict=True))
            if not len(ids) or not len(query_ids):
                continue
            high = float(np.abs(c).max(initial=1)) * float(np.abs(qs).max(initial=1)) * max(width, 1)
            if high < 2**23:
                c, qs = c.astype(np.float32), qs.astype(np.float32)
            elif high >= 2**52:  # exact in Python integers
                turn = np.vectorize(int, otypes=[object])
                c, qs = (turn(c), turn(qs)) if width else (c, qs)
            chunk = CHUNK if c.dtype != object else CHUNK // 16
            for at in range(0, len(qs), chunk):
                some = query_ids[at : at + chunk]
                rows, got, score = top_of_shard(ids, c, some, qs[at : at + chunk], k)
                if score.dtype == object:
                    score = np.asarray([min(max(s, -_TOP - 1), _TOP) for s in score], np.int64)
                found.append((some[rows], got, score.astype(np.int64)))
        cols = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((),) * 3)]
        return pa.table([pa.array(x, pa.int64()) for x in cols], names=["query_id", "vec_id", "score"])

    tops = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return tops.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
