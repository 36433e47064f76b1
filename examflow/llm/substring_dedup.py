"""Removal of passages that start earlier in the corpus, by suffix automata.

A window is ``width`` consecutive words. A word goes if it lies in a window whose
word sequence also starts earlier (smaller doc_id, or same document, earlier start).

1. Every text gives its word count, the digest of its words and its minimizers: the
   least hash of the grams in each window. Equal windows have equal minimizers, so
   only windows whose minimizer occurs twice can repeat. Later texts with the words
   of an earlier one are settled here: all or nothing goes.
2. The windows left are counted by hash, and each learns the first document that
   holds it. This only finds which texts must meet. Hashes of rare minimizers are
   ranked in their bounded groups; those of frequent ones (over ``HOT``) are summed
   before the shuffle and joined back, so no frequent passage meets in one task.
3. The first documents' candidate passages are the reference, one shard per
   document. A task builds the suffix automaton of a shard over its words and
   streams the passages of other documents (and its own) through it. Matching
   statistics of at least ``width`` give the earliest start in the shard from the
   state; windows that start later than that are joined to maximal spans. A shard
   that many passages ask for is copied to several tasks, some thousand passages each.

The reference grows with the corpus, so its automata are not broadcast: each is
built where the passages that can match it are sent.

* Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null: no words. Texts shorter than a
  window keep all. Repeated rows of one doc_id don't remove each other. A null
  doc_id counts as larger than all. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import partitions, python_ready, written, written_by
from .words import blocks, mix, rolling

WIDTH, GRAM = 20, 6
HOT = 1000
PASSAGES = 2000  # streamed through one copy of a shard's automaton
LAST_ID = 2**63 - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_SALT = np.uint64(0x2545F4914F6CDD1D)


def _sliding(values: np.ndarray, span: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over every ``span`` neighbours."""
    have = 1
    while have < span:  # over 2, 4, 8, ... neighbours
        step = min(have, span - have)
        values = best(values[:-step], values[step:]) if len(values) > step else values[:0]
        have += step
    return values


def window_minima(hashes: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The least gram hash in every window of ``width`` words; and for every gram its
    hash if it is the least of a window that lies in one text, else 0."""
    grams = mix(rolling(hashes, gram) ^ _SALT)
    span = width - gram + 1
    least = _sliding(grams, span, np.minimum)
    inside = np.zeros(len(least) + 1, np.int8)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            inside[a : b - width + 1] = 1
    valid = np.where(inside[:-1], least, 0)
    if not len(valid):
        return least, grams[:0]
    around = np.zeros(span - 1, np.uint64)
    most = _sliding(np.concatenate([around, valid, around]), span, np.maximum)
    return least, np.where(grams == most, grams, 0)


def per_document(texts: list, width: int, gram: int):
    """Yield (index, data, starts, ends, window hashes, window minima, chosen grams)
    per text."""
    for first, data, starts, ends, hashes, bounds in blocks(texts):
        whole = rolling(hashes, width)
        least, chosen = window_minima(hashes, bounds, width, gram)
        for i in range(len(bounds) - 1):
            a, b = bounds[i], bounds[i + 1]
            to = max(a, b - width + 1)
            yield first + i, data, starts[a:b], ends[a:b], whole[a:to], least[a:to], chosen[a : max(a, b - gram + 1)]


def _binary(column) -> list:
    return column.cast(pa.binary()).to_pylist()


def profiles(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, id (never null), n_words, sha, minima, twice (minima of two places)."""
    python_ready(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()),
                        ("minima", pa.list_(pa.int64())), ("twice", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), _binary(batch.column(1))
            rows: list[list] = [[] for _ in schema]
            for i, _, starts, _, _, _, chosen in per_document(texts, width, gram):
                values, counts = np.unique(chosen[chosen > 0], return_counts=True)
                sha = hashlib.sha256(b" ".join((texts[i] or b"").split())).hexdigest()
                for c, v in zip(rows, (ids[i], LAST_ID if ids[i] is None else ids[i], len(starts), sha,
                                       values.view(np.int64), values[counts > 1].view(np.int64)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, id long, n_words long, sha string, minima array<long>, twice array<long>")


def candidates(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """(id, text, some, hot) -> id, text, cold, hot: the distinct window hashes whose
    minimizer is in ``some``, apart for minimizers in ``hot``."""
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("cold", pa.list_(pa.int64())),
                        ("hot", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            texts_ = _binary(batch.column("text"))
            lists = [batch.column(n).to_pylist() for n in ("some", "hot")]
            rows: list[list] = [[], []]
            for i, _, _, _, whole, least, _ in per_document(texts_, width, gram):
                own = least.view(np.int64)
                hot = np.isin(own, np.asarray(lists[1][i], np.int64))
                cold = np.isin(own, np.asarray(lists[0][i], np.int64)) & ~hot
                rows[0].append(np.unique(whole[cold]).view(np.int64))
                rows[1].append(np.unique(whole[hot]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text"), *[pa.array(r, pa.list_(pa.int64())) for r in rows]],
                schema=schema)

    return texts.mapInArrow(run, "id long, text string, cold array<long>, hot array<long>")


def passages(found: DataFrame, width: int, gram: int) -> DataFrame:
    """(id, text, cold, hot, hashes, firsts, is_first) -> rows (shard, streamed, id,
    tag, start, words). ``firsts`` has the first document of each of ``hashes``."""
    out = "shard long, streamed int, id long, tag string, start long, words string"
    schema = pa.schema([("shard", pa.int64()), ("streamed", pa.int32()), ("id", pa.int64()),
                        ("tag", pa.string()), ("start", pa.int64()), ("words", pa.string())])

    def run(batches):
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 500):
                batch = whole_batch.slice(at, 500)
                texts, ids = _binary(batch.column("text")), batch.column("id").to_pylist()
                cols = {n: batch.column(n) for n in ("cold", "hot", "hashes", "firsts")}
                is_first = batch.column("is_first").to_pylist()
                rows: list[tuple] = []
                for i, data, starts, ends, windows, _, _ in per_document(texts, width, gram):
                    if not len(windows):
                        continue
                    get = {n: (c[i].values.to_numpy() if c[i].is_valid else np.zeros(0, np.int64)) for n, c in cols.items()}
                    own, tag = windows.view(np.int64), hashlib.sha256(b" ".join(texts[i].split())).hexdigest()[:16]
                    # windows that occur before in this very text belong to its own shard
                    _, first_at, back = np.unique(own, return_index=True, return_inverse=True)
                    home = np.where(first_at[back] < np.arange(len(own)), ids[i], -1)
                    again = home != -1
                    ask = again.copy()
                    if len(get["hashes"]):
                        order = np.argsort(get["hashes"])
                        keys = get["hashes"][order]
                        place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                        hit = keys[place] == own
                        home[hit] = get["firsts"][order][place[hit]]
                        ask |= hit
                    def emit(wanted, shard, streamed):
                        at = np.flatnonzero(wanted)
                        if not len(at):
                            return
                        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(shard[at]) != 0)) + 1
                        for part in np.split(at, cut):
                            a, b = int(part[0]), int(part[-1]) + width
                            rows.append((int(shard[a]), streamed, ids[i], tag, a,
                                         b" ".join(data[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)).decode()))
                    emit(ask, home, 1)
                    refers = np.isin(own, np.concatenate([get["cold"], get["hot"]])) if is_first[i] else np.zeros(len(own), bool)
                    if again.any():
                        refers |= np.isin(own, own[again])
                    emit(refers, np.full(len(own), ids[i], np.int64), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, schema, strict=True)],
                    schema=schema)

    return found.mapInArrow(run, out)


class SuffixAutomaton:
    """Over words, of several passages; a state knows where it ended first."""

    def __init__(self) -> None:
        self.step: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]

    def add(self, words: list, start: int) -> None:
        """Passages are to come in the order of their start."""
        step, link, size, first = self.step, self.link, self.size, self.first
        last = 0
        for at, w in enumerate(words, start):
            q = step[last].get(w)
            if q is not None:  # known from an earlier passage
                if size[q] == size[last] + 1:
                    last = q
                    continue
                last = self._clone(q, last, w)
                continue
            new = len(size)
            step.append({})
            link.append(0)
            size.append(size[last] + 1)
            first.append(at)
            p = last
            while p != -1 and w not in step[p]:
                step[p][w] = new
                p = link[p]
            if p != -1:
                q = step[p][w]
                link[new] = q if size[q] == size[p] + 1 else self._clone(q, p, w)
            last = new

    def _clone(self, q: int, p: int, w) -> int:
        step, link, size, first = self.step, self.link, self.size, self.first
        copy = len(size)
        step.append(step[q].copy())
        link.append(link[q])
        size.append(size[p] + 1)
        first.append(first[q])
        link[q] = copy
        while p != -1 and step[p].get(w) == q:
            step[p][w] = copy
            p = link[p]
        return copy

    def earliest(self, words: list, width: int):
        """Yield (i, s): the window that ends at word i starts first at s here."""
        step, link, size, first = self.step, self.link, self.size, self.first
        state = match = 0
        for i, w in enumerate(words):
            nxt = step[state].get(w)
            while nxt is None and state:
                state = link[state]
                match = size[state]
                nxt = step[state].get(w)
            if nxt is None:
                continue
            state, match = nxt, match + 1
            if match >= width:
                match = width  # the state of the last ``width`` words
                while size[link[state]] >= width:
                    state = link[state]
                yield i, first[state] - width + 1


def later_spans(rows: DataFrame, width: int) -> DataFrame:
    """Passage rows, together by (shard, salt) and sorted, -> id, tag, start, end."""
    schema = pa.schema([("id", pa.int64()), ("tag", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        key, automaton = None, SuffixAutomaton()
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 1000):
                out: list[tuple] = []
                batch = whole_batch.slice(at, 1000)
                cols = [batch.column(n).to_pylist() for n in ("shard", "salt", "streamed", "id", "tag", "start", "words")]
                for shard, salt, streamed, id_, tag, start, words in zip(*cols, strict=True):
                    if (shard, salt) != key:
                        key, automaton = (shard, salt), SuffixAutomaton()
                    tokens = words.split(" ")
                    if not streamed:
                        automaton.add(tokens, start)
                        continue
                    a = b = -1
                    for i, s in automaton.earliest(tokens, width):
                        if shard < id_ or s < start + i - width + 1:
                            if i - width + 1 > b:  # not next to the span so far
                                if b > a:
                                    out.append((id_, tag, start + a, start + b))
                                a = i - width + 1
                            b = i + 1
                    if b > a:
                        out.append((id_, tag, start + a, start + b))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, schema, strict=True)],
                    schema=schema)

    return rows.mapInArrow(run, "id long, tag string, start long, end long")


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, spans, texts): profiles with ``copy`` (all words go), spans id, tag,
    spans (array of [start, end) words), texts id, text of what has candidates."""
    spark = docs.sparkSession
    n = partitions(spark)
    base = written(profiles(docs, width, gram), "profiles")
    firsts = base.filter(F.col("n_words") >= width).groupBy("sha").agg(F.min("id").alias("first_id"))
    # a text of fewer words than a window has nothing to lose
    seen = base.select("doc_id", "id", "n_words", "sha").join(firsts, "sha", "left").withColumn(
        "copy", F.coalesce(F.col("id") > F.col("first_id"), F.lit(False)))
    originals = base.join(firsts, (base["sha"] == firsts["sha"]) & (base["id"] == firsts["first_id"]), "left_semi")
    grams = originals.select("id", F.explode("minima").alias("m"))
    again = originals.select(F.explode(F.concat("minima", "twice")).alias("m")).groupBy("m").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1")
    lists = grams.join(again, "m").groupBy("id").agg(
        F.collect_list("m").alias("some"), F.collect_list(F.when(F.col("n") > HOT, F.col("m"))).alias("hot"))
    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "text")
    # texts move once: the join deals them by id into the buckets they stay in
    texts = written_by(candidates(keyed.join(lists, "id"), width, gram), "id", "candidates", n)

    # the first document of each window hash, for the other documents that hold it
    marked = lambda c, flag: F.transform(c, lambda h: F.struct(h.alias("h"), F.lit(flag).alias("hot")))
    every = texts.select("id", F.explode(F.concat(marked("cold", False), marked("hot", True))).alias("w"))
    cold = every.filter("not w.hot").select("id", F.col("w.h").alias("h"))
    rank = Window.partitionBy("h")
    cold = cold.withColumn("first_id", F.min("id").over(rank)).filter("id > first_id")
    hot = every.filter("w.hot").select("id", F.col("w.h").alias("h"))
    low = hot.groupBy("h").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("last_id > first_id")
    hot = hot.join(low.drop("last_id"), "h").filter("id > first_id").select("id", "h", "first_id")
    later = written(cold.select("id", "h", "first_id").unionByName(hot), "later")
    asked = later.groupBy("id").agg(F.collect_list("h").alias("hashes"), F.collect_list("first_id").alias("firsts"))
    named = later.select(F.col("first_id").alias("id")).distinct().withColumn("is_first", F.lit(True))
    met = texts.join(asked, "id", "left").join(named, "id", "left").withColumn(
        "is_first", F.coalesce("is_first", F.lit(False)))
    rows = written(passages(met, width, gram), "passages")

    # copies of a shard's automaton, some thousand passages each
    asks = rows.filter("streamed = 1").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    asks = asks.select("shard", F.expr(f"n div {PASSAGES} + 1").alias("copies"))
    dealt = rows.join(asks, "shard")
    salts = F.when(F.col("streamed") == 1, F.array(F.pmod(F.xxhash64("id", "start"), "copies"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    dealt = dealt.withColumn("salt", F.explode(salts)).drop("copies")
    spans = later_spans(dealt.repartition(n, "shard", "salt").sortWithinPartitions(
        "shard", "salt", "streamed", "start"), width)
    spans = spans.groupBy("id", "tag").agg(F.collect_list(F.array("start", "end")).alias("spans"))
    return seen, written(spans, "spans"), texts.select("id", "text")


def covered(n: int, spans: list) -> np.ndarray:
    """Which of n words lie in a span."""
    out = np.zeros(n + 1, np.int64)
    for a, b in spans:
        out[a] += 1
        out[b] -= 1
    return np.cumsum(out[:-1]) > 0


def dedup_words(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_words, n_removed, kept_sha256."""
    seen, spans, texts = repeated_spans(docs, width)

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in ("id", "text", "tag", "spans")]
            for id_, text, tag, found in zip(*cols, strict=True):
                words = text.encode().split()
                if hashlib.sha256(b" ".join(words)).hexdigest()[:16] != tag:
                    continue  # another text of the same doc_id
                gone = covered(len(words), found)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                out.append((id_, tag, int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4,
                                                (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)],
                names=["id", "tag", "gone", "kept"])

    cut = texts.join(spans, "id").mapInArrow(run, "id long, tag string, gone long, kept string").distinct()
    tag = F.substring("sha", 1, 16)
    return seen.withColumn("tag", tag).join(cut, ["id", "tag"], "left").select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def dedup_texts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``; all rows and columns
    stay. White space between kept words is unchanged, a cut leaves one blank; the
    text of a copy is empty, an untouched text is the same. ``n_chars`` follows."""
    seen, spans, _ = repeated_spans(docs, width)
    whole = seen.filter("copy").select("id", F.substring("sha", 1, 16).alias("tag"), F.array(
        F.array(F.lit(0).cast("long"), F.col("n_words"))).alias("spans")).distinct()
    cuts = spans.unionByName(whole).groupBy("id").agg(F.collect_list(F.struct("tag", "spans")).alias("_cuts"))

    def run(batches):
        for batch in batches:
            texts = _binary(batch.column("text"))
            cuts_, out = batch.column("_cuts").to_pylist(), []
            for i, data, starts, ends, _, _, _ in per_document(texts, width, GRAM):
                spans_ = []
                if cuts_[i] is not None and texts[i] is not None:
                    tag_ = hashlib.sha256(b" ".join(texts[i].split())).hexdigest()[:16]
                    spans_ = [s for c in cuts_[i] if c["tag"] == tag_ for s in c["spans"]]
                if not spans_:
                    out.append(texts[i])
                    continue
                keep = np.flatnonzero(~covered(len(starts), spans_))
                parts = np.split(keep, np.flatnonzero(np.diff(keep) != 1) + 1) if len(keep) else []
                out.append(b" ".join(data[starts[p[0]] : ends[p[-1]]] for p in parts))
            yield batch.set_column(batch.schema.get_field_index("text"), "text",
                                   pa.array(out, pa.binary()).cast(pa.string()))

    joined = docs.withColumn("_id", F.coalesce("doc_id", F.lit(LAST_ID))).join(
        cuts.withColumnRenamed("id", "_cut_id"), F.col("_id") == F.col("_cut_id"), "left").drop("_id", "_cut_id")
    kinds = joined.schema
    cut = joined.mapInArrow(run, kinds).drop("_cuts")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)
