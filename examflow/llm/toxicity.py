"""Toxicity as severity grades: cumulative-link ordinal regression on word features.

A word gives up to four features: itself and its first 4, 5 and 6 bytes (A-Z in
lower case), as 64-bit hashes. ``P(grade > j) = 1 / (1 + exp(t_j - w . x))`` with one
weight vector for all thresholds ``t_0 < t_1 < ...``; ``x`` is log(1 + count) of the
features that separate toxic from other documents. The score is the expected
severity, the sum of ``P(grade > j)``; from ``REJECT`` on a document is toxic.

The labels say toxic or not. Grades: 0 for the others; toxic documents get 1 or 2,
by whether the number of their words with a chosen feature is below the median of
the labelled toxic documents or not. Chosen features speak for toxicity, so weights
are kept from falling below 0.

Training reads at most ``sample`` labelled documents (those of the least hashed ids,
whole texts). Document frequencies are summed in Spark; the driver gets at most
``most_features`` features and ``sample`` sparse rows of these.

* Null and empty texts have no features. Without labels of both kinds nothing can be
  learned: every severity is 0. A doc_id with several labels takes the highest; null
  labels and labels without a document are left out. Repeated rows are scored one by
  one. Extra columns are dropped. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import python_ready
from .words import _LOWER, _base_powers, blocks, mix

SAMPLE = 12_000
MOST_FEATURES = 4096
PREFIXES = (4, 5, 6)
LEAST_G2 = 22.0
RATIO = 6.0
REJECT = 0.5
_SIEVE = 22  # bits of the first look-up


@dataclass
class SeverityModel:
    features: np.ndarray  # sorted 64-bit hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        if not len(self.features):
            return np.zeros(n)
        z = np.bincount(rows, self.weights[columns] * values, minlength=n)
        return (1 / (1 + np.exp(self.thresholds[:, None] - z[None, :]))).sum(0)


def word_features(data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> list[tuple]:
    """(word numbers, feature hashes) for whole words and for each prefix length."""
    out = [(np.arange(len(starts)), hashes)]
    buf, total = np.frombuffer(data, np.uint8), np.zeros(len(starts), np.uint64)
    power = _base_powers(max(PREFIXES))
    for j in range(max(PREFIXES)):
        at = np.flatnonzero(ends - starts > j)
        total[at] += _LOWER[buf[starts[at] + j]] * power[j]
        if j + 1 in PREFIXES:
            out.append((at, mix(total[at] ^ np.uint64(0xC0FFEE * (j + 1)))))
    return out


def _find(features: np.ndarray, sieve: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``hashes`` that hold a chosen feature, and which."""
    at = np.flatnonzero(sieve[(hashes >> np.uint64(64 - _SIEVE)).astype(np.int64)])
    place = np.minimum(np.searchsorted(features, hashes[at]), len(features) - 1)
    hit = features[place] == hashes[at]
    return at[hit], place[hit]


def sparse_rows(texts: list, features: np.ndarray):
    """Yield (first, n, rows, columns, counts, hits) per block of texts."""
    sieve = np.zeros(1 << _SIEVE, bool)
    sieve[(features >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True
    for first, data, starts, ends, hashes, bounds in blocks(texts, lower=True):
        n = len(bounds) - 1
        owner = np.repeat(np.arange(n), np.diff(bounds))
        keys, marked = [], np.zeros(len(starts), bool)
        if len(features):
            for words, values in word_features(data, starts, ends, hashes):
                at, column = _find(features, sieve, values)
                keys.append(owner[words[at]] * len(features) + column)
                marked[words[at]] = True
        cells, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
        size = max(len(features), 1)
        yield (first, n, cells // size, cells % size, counts,
               np.bincount(owner[marked], minlength=n))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray,
                n_features: int, rounds: int = 1200, ridge: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model by Adam on all rows."""
    n, steps = len(grades), int(grades.max(initial=0))
    above = (grades[None, :] > np.arange(steps)[:, None]).astype(float)
    share = np.clip(above.mean(1), 1e-4, 1 - 1e-4)
    first = np.log((1 - share[0]) / share[0])
    gaps = np.diff(np.log((1 - share) / share))
    theta = np.concatenate([np.zeros(n_features), [first], np.log(np.maximum(gaps, 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        w, gap = theta[:n_features], np.exp(theta[n_features + 1 :])
        cut = np.concatenate([[theta[n_features]], theta[n_features] + np.cumsum(gap)])
        z = np.bincount(rows, w[columns] * values, minlength=n)
        p = 1 / (1 + np.exp(np.clip(cut[:, None] - z[None, :], -40, 40)))
        # P(grade = y) = p[y - 1] - p[y], with p[-1] = 1 and p[steps] = 0
        full = np.concatenate([np.ones((1, n)), p, np.zeros((1, n))])
        at = np.arange(n)
        hi, lo = full[grades, at], full[grades + 1, at]
        mass = np.maximum(hi - lo, 1e-12)
        slope = full * (1 - full)
        dz = (slope[grades, at] - slope[grades + 1, at]) / mass  # of the log likelihood
        dcut = np.zeros(steps)
        np.add.at(dcut, grades[grades > 0] - 1, -(slope[grades, at] / mass)[grades > 0])
        np.add.at(dcut, grades[grades < steps], (slope[grades + 1, at] / mass)[grades < steps])
        grad = np.concatenate([
            np.bincount(columns, dz[rows] * values, minlength=n_features) - ridge * w,
            [dcut.sum()], np.cumsum(dcut[::-1])[::-1][1:] * gap])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        np.maximum(theta[:n_features], 0, out=theta[:n_features])
    gap = np.exp(theta[n_features + 1 :])
    return theta[:n_features], np.concatenate([[theta[n_features]], theta[n_features] + np.cumsum(gap)])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE,
          most_features: int = MOST_FEATURES) -> SeverityModel:
    """Fit on at most ``sample`` rows of ``labels(doc_id, toxic)`` that have a text."""
    python_ready(docs.sparkSession)
    none = SeverityModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    chosen = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
              .agg(F.max("toxic").cast("int").alias("_toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most ``sample`` pairs of numbers are broadcast
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "_toxic")

    def frequencies(batches):
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            toxic = np.asarray(batch.column(1).to_pylist(), np.int64)
            found, kinds = [], []
            for first, data, starts, ends, hashes, bounds in blocks(texts, lower=True):
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                sets = word_features(data, starts, ends, hashes)
                words = owner[np.concatenate([w for w, _ in sets])]
                values = np.concatenate([h for _, h in sets])
                order = np.lexsort((values, words))
                words, values = words[order], values[order]
                new = np.append(True, (words[1:] != words[:-1]) | (values[1:] != values[:-1]))[: len(words)]
                found.append(values[new])
                kinds.append(toxic[first + words[new]])
            keys, back = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_inverse=True)
            kind = np.concatenate(kinds) if kinds else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({
                "f": keys.view(np.int64),
                "a": np.bincount(back[kind > 0], minlength=len(keys)).astype(np.int64),
                "b": np.bincount(back[kind <= 0], minlength=len(keys)).astype(np.int64)})

    totals = known.groupBy((F.col("_toxic") > 0).alias("t")).count().collect()
    n = {r.t: r["count"] for r in totals}
    na, nb = n.get(True, 0), n.get(False, 0)
    if not na or not nb:
        return none
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    share = (a + b) / (na + nb)
    g2 = 2 * (part(a, share * na) + part(b, share * nb)
              + part(na - a, (1 - share) * na) + part(nb - b, (1 - share) * nb))
    best = (known.mapInArrow(frequencies, "f long, a long, b long").groupBy("f")
            .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
            .filter((a >= 2) & (a / na >= RATIO * (b + 0.5) / nb)).withColumn("g2", g2)
            .filter(F.col("g2") >= F.least(F.lit(LEAST_G2), F.lit(1.2 * na)))
            .orderBy(F.desc("g2"), "f").limit(most_features).select("f").collect())
    features = np.sort(np.asarray([r.f for r in best], np.int64).view(np.uint64))
    if not len(features):
        return none

    def project(batches):
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            toxic = batch.column(1).to_pylist()
            for first, count, rows, columns, counts, hits in sparse_rows(texts, features):
                cuts = np.searchsorted(rows, np.arange(count + 1))
                yield pa.RecordBatch.from_pydict({
                    "toxic": pa.array(toxic[first : first + count], pa.int32()),
                    "hits": hits.astype(np.int64),
                    "columns": pa.array([columns[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.list_(pa.int64())),
                    "counts": pa.array([counts[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.list_(pa.int64()))})

    table = known.mapInArrow(project, "toxic int, hits long, columns array<long>, counts array<long>").toArrow()
    toxic, hits_ = table["toxic"].to_numpy() > 0, table["hits"].to_numpy()
    grades = np.where(toxic, 1 + (hits_ >= np.median(hits_[toxic])), 0)
    if (grades == 1).sum() == 0:
        grades = np.minimum(grades, 1)
    lengths = [len(x) for x in table["columns"]]
    rows = np.repeat(np.arange(len(lengths)), lengths)
    flat = lambda c: np.concatenate([np.asarray(x.values.to_numpy(), np.int64) for x in table[c]] or [np.zeros(0, np.int64)])
    weights, thresholds = fit_ordinal(rows, flat("columns"), np.log1p(flat("counts")), grades.astype(np.int64), len(features))
    return SeverityModel(features, weights, thresholds)


def score(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, severity (expected grade), toxic."""
    python_ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            parts = [model.severity(rows, columns, np.log1p(counts), n)
                     for _, n, rows, columns, counts, _ in sparse_rows(texts, model.features)]
            severity = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity), pa.array(severity >= REJECT)],
                                             names=["doc_id", "severity", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, severity double, toxic boolean")


def drop_toxic(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """The rows of ``docs`` under ``REJECT``, all columns, scored where they lie."""
    python_ready(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            parts = [model.severity(rows, columns, np.log1p(counts), n)
                     for _, n, rows, columns, counts, _ in sparse_rows(texts, model.features)]
            severity = np.concatenate(parts) if parts else np.zeros(0)
            yield batch.filter(pa.array(severity < REJECT))

    return docs.mapInArrow(run, docs.schema)
