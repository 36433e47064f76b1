"""Hard negatives from Hilbert-ordered blocks with zone maps.

1. Candidates are sorted along a Hilbert curve through their dimensions of largest
   spread and cut into blocks of ``BLOCK`` rows, written as Parquet; blocks that follow
   one another lie in one range, the unit that is read by a task. A block's zone map is
   the least and the largest value of every dimension, with its rows a label.
2. Interval arithmetic on a zone map bounds the scores of an anchor with the rows of a
   block from below and above. An anchor reads the block of the largest upper bound that
   holds its label first; the score of its ``n``-th best row there is a floor, and only
   blocks whose upper bound reaches the floor can hold a positive.
3. The positives give each anchor its windows ``[low, score]``. The blocks that hold
   another label and whose bounds meet a window are read for it, all in one pass.

Anchors meet the zone maps in blocks of both; anchors go to the ranges they chose, with
the numbers of the chosen blocks, and only those blocks are scored. Tops of ranges are
merged by a window limit.

* Rows with a null vec_id, label or vector, or a null or non-finite component, take no
  part. Rows equal in id, label and vector count once; other rows that share an id are
  rows of their own, but an anchor's id is never its candidate. Several anchor rows of
  one id are anchors of their own, and their results stand side by side.
* A shorter vector counts as padded with 0. Scores are exact whole numbers; beyond 64
  bits they are held at its ends in the result. Ties go to the smaller id.
* A negative positive score leaves an empty window. Empty table: no rows. Extra columns
  are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examflow.operators.rowindex import ranges

from .frames import python_ready, written

BLOCK = 256
RANGE_ROWS = 8192
ANCHORS = 1024  # anchors that meet zone maps at a time
ZONES = 4096  # zone maps that anchors meet at a time
CURVE_BITS = 63
_TOP = (1 << 63) - 1
_EXACT = 2.0**52


# --- the curve ----------------------------------------------------------------------


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve of points with ``bits`` bits in each of d dimensions
    (bits * d at most 63): the axes are turned and flipped level by level, and the bits
    of the result are read across the dimensions."""
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(d):
            set_ = (x[i] >> level & 1).astype(bool)
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[d - 1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            out = out << 1 | x[i] >> level & 1
    return out


# --- numbers ------------------------------------------------------------------------


def whole(values: list, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of padded vectors: doubles, or Python integers where a double
    may not hold a score exactly."""
    raw = np.zeros((len(values), width))
    for i, v in enumerate(values):
        raw[i, : len(v)] = v
    high = np.abs(raw).max(initial=0)
    if (high * scale + 1) ** 2 * max(width, 1) < _EXACT:
        return np.floor(raw * scale)
    # a double of 2^52 or more is whole, and times a whole scale it stays so
    exact = np.vectorize(lambda x: int(x) * int(scale) if abs(x) >= _EXACT else int(np.floor(x * scale)), otypes=[object])
    return exact(raw) if raw.size else np.zeros(raw.shape, object)


def doubles(numbers: np.ndarray) -> np.ndarray:
    """``whole`` numbers as doubles, infinite where a double cannot hold them."""
    if numbers.dtype != object:
        return numbers
    near = np.vectorize(lambda x: float(x) if abs(x) < 10**300 else float("inf") if x > 0 else -float("inf"), otypes=[float])
    return near(numbers) if numbers.size else np.zeros(numbers.shape)


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each anchor (rows) with any point of each box (columns).
    Where doubles may round, the bounds say nothing."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    with np.errstate(all="ignore"):
        least, most = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
        size = np.abs(anchors).max(1, initial=0)[:, None] * np.maximum(np.abs(lo), np.abs(hi)).max(1, initial=0)[None, :]
        sure = np.isfinite(size) & (size * max(anchors.shape[1], 1) < _EXACT)
    return np.where(sure, least, -np.inf), np.where(sure, most, np.inf)


# --- tables -------------------------------------------------------------------------


def clean_rows(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, v (array<double>), uid: the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select("vec_id", label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    return rows.distinct().withColumn("uid", F.xxhash64("vec_id", "label", "v"))


class Blocks:
    """The written candidate table and its zone maps."""

    def __init__(self, rows: DataFrame, scale: float, block: int = BLOCK, range_rows: int = RANGE_ROWS):
        spark = rows.sparkSession
        python_ready(spark)
        self.scale, self.block = scale, block
        rows = written(rows, "rows")
        self.width = rows.agg(F.max(F.size("v"))).first()[0] or 0
        keyed = self._keyed(rows) if self.width else rows.withColumn("key", F.lit(0).cast("long"))
        dealt = ranges(keyed, F.col("key"), F.col("uid"), range_rows)
        order = Window.partitionBy("_r", "_s").orderBy("_k", "vec_id", "uid")
        dealt = dealt.withColumn("block", F.floor((F.row_number().over(order) - 1) / block).cast("int"))
        self.rows = written(dealt.select(F.struct("_r", "_s").alias("range"), "block", "vec_id", "uid", "label", "v")
                            .repartition("range").sortWithinPartitions("range", "block"), "blocks")
        self.zones = written(self._zones(), "zones")

    def _keyed(self, rows: DataFrame) -> DataFrame:
        # spread of each dimension, and the borders of its cells
        width = self.width
        at = [F.coalesce(F.get("v", i), F.lit(0.0)) for i in range(width)]
        spread = rows.agg(*[F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(at)]).first()
        deviations = np.nan_to_num(np.asarray([x or 0.0 for x in spread], float))
        bits = max(1, min(3, CURVE_BITS // max(width, 1)))
        dims = np.argsort(-deviations, kind="stable")[: CURVE_BITS // bits].tolist()
        shares = [k / (1 << bits) for k in range(1, 1 << bits)]
        borders = rows.agg(*[F.percentile_approx(at[i], shares, 1000).alias(f"d{i}") for i in dims]).first()
        cuts = [np.asarray(b or [0.0] * len(shares), float) for b in borders]

        def key(batches):
            for pdf in batches:
                raw = np.zeros((len(pdf), width))
                for i, v in enumerate(pdf["v"]):
                    raw[i, : len(v)] = v
                cells = np.stack([np.searchsorted(c, raw[:, i], "right") for i, c in zip(dims, cuts, strict=True)], 1)
                pdf["key"] = hilbert_index(cells, bits)
                yield pdf

        return rows.mapInPandas(key, "vec_id long, label long, v array<double>, uid long, key long")

    def _zones(self) -> DataFrame:
        """range, block, lo, hi, labels, counts: one row a block."""
        scale, width = self.scale, self.width

        def zone(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for block, part in pdf.groupby("block", sort=True):
                m = doubles(whole(list(part["v"]), width, scale))
                labels, counts = np.unique(part["label"].to_numpy(), return_counts=True)
                out.append((pdf["_r"].iloc[0], pdf["_s"].iloc[0], block, m.min(0), m.max(0), labels, counts))
            return pd.DataFrame(out, columns=["_r", "_s", "block", "lo", "hi", "labels", "counts"])

        flat = self.rows.select("range._r", "range._s", "block", "label", "v")
        zones = flat.groupBy("_r", "_s").applyInPandas(
            zone, "_r long, _s int, block int, lo array<double>, hi array<double>, labels array<long>, counts array<long>")
        return zones.select(F.struct("_r", "_s").alias("range"), "block", "lo", "hi", "labels", "counts")


def choose(anchors: DataFrame, blocks: Blocks, pick, extra: list[str]) -> DataFrame:
    """uid, range, blocks, upper: what ``pick`` chooses for each anchor. ``pick(anchors,
    least, most, zones)`` gives a mask of (anchor, zone) from pandas frames and bounds."""
    n, m = anchors.count(), blocks.zones.count()
    groups, parts = -(-n // ANCHORS) or 1, -(-m // ZONES) or 1
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select("uid", "label", "v", *extra).withColumn("g", deal("uid", groups)).withColumn("p", every(parts))
    right = blocks.zones.select(F.col("range._r").alias("_r"), F.col("range._s").alias("_s"), "block", "lo", "hi",
                                "labels", "counts").withColumn("p", F.pmod(F.xxhash64("_r", "_s", "block"), F.lit(parts)).cast("int")
                                                               ).withColumn("g", every(groups))
    width, scale = blocks.width, blocks.scale

    def meet(a: pd.DataFrame, z: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(z):
            z = z.sort_values(["_r", "_s", "block"], ignore_index=True)
            least, most = bounds(doubles(whole(list(a["v"]), width, scale)), np.stack(z["lo"]), np.stack(z["hi"]))
            mask = pick(a, least, most, z)
            keys = z[["_r", "_s"]].to_numpy()
            edges = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1)
            number = z["block"].to_numpy()
            for i, uid in enumerate(a["uid"]):
                chosen = np.flatnonzero(mask[i])
                for group in np.split(chosen, np.searchsorted(chosen, edges[1:])):
                    if len(group):
                        out.append((uid, *keys[group[0]], number[group], most[i, group].max()))
        return pd.DataFrame(out, columns=["uid", "_r", "_s", "blocks", "upper"])

    return left.groupBy("g", "p").cogroup(right.groupBy("g", "p")).applyInPandas(
        meet, "uid long, _r long, _s int, blocks array<int>, upper double").select(
        "uid", F.struct("_r", "_s").alias("range"), "blocks", "upper")


def read_blocks(anchors: DataFrame, chosen: DataFrame, blocks: Blocks, extra: list[str], score, ddl: str) -> DataFrame:
    """``score(anchor, ids, labels, scores)`` over the rows of each anchor's chosen blocks,
    range by range. Anchors that ask one range meet it in parts of bounded size."""
    per_range = chosen.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("parts"))
    asked = chosen.select("uid", "range", "blocks").join(per_range, "range").withColumn(
        "part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).drop("parts")
    asked = asked.join(anchors.select("uid", "vec_id", "label", "v", *extra), "uid").select(
        "range._r", "range._s", "part", "uid", "vec_id", "label", "v", "blocks", *extra)
    # blocks that no anchor chose stay where they are
    wanted = chosen.select("range", F.explode("blocks").alias("block")).distinct()
    held = blocks.rows.join(wanted, ["range", "block"], "left_semi").join(per_range, "range").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "range._r", "range._s", "part", "block", "vec_id", "label", "v")
    width, scale = blocks.width, blocks.scale
    names = [c.split()[0] for c in ddl.split(", ")]

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            b = b.sort_values("block", kind="stable", ignore_index=True)
            rows, asks = whole(list(b["v"]), width, scale), whole(list(a["v"]), width, scale)
            if rows.dtype != asks.dtype or (rows.dtype != object and np.abs(rows).max(initial=0) * np.abs(asks).max(
                    initial=0) * max(width, 1) >= _EXACT):
                turn = np.vectorize(int, otypes=[object])
                rows, asks = (x if x.dtype == object or not x.size else turn(x) for x in (rows, asks))
            ids, labels, block = b["vec_id"].to_numpy(), b["label"].to_numpy(), b["block"].to_numpy()
            wants = np.zeros((len(a), int(block.max()) + 1), bool)
            for i, own in enumerate(a["blocks"]):
                wants[i, own[own < wants.shape[1]]] = True
            for at in range(0, len(a), 64):  # together over the blocks that any of them chose
                near = np.flatnonzero(wants[at : at + 64].any(0)[block])
                scores = rows[near] @ asks[at : at + 64].T
                if scores.dtype != object:
                    scores = scores.astype(np.int64)
                for i, anchor in enumerate(a.iloc[at : at + 64].itertuples(index=False)):
                    mine = np.flatnonzero(wants[at + i][block[near]] & (ids[near] != anchor.vec_id))
                    if len(mine):
                        out += score(anchor, ids[near[mine]], labels[near[mine]], scores[mine, i])
        return pd.DataFrame(out, columns=names)

    keys = ["_r", "_s", "part"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(search, ddl)


def held(score) -> int:
    return min(max(int(score), -_TOP - 1), _TOP)


def _best(ids: np.ndarray, scores: np.ndarray, n: int) -> list[int]:
    """Places of the ``n`` largest scores, ties to smaller ids."""
    if scores.dtype == object:
        return sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:n]
    if len(ids) > 4 * n:  # all that reach the n-th score
        floor = np.partition(scores, len(scores) - n)[len(scores) - n]
        near = np.flatnonzero(scores >= floor)
        return near[np.lexsort((ids[near], -scores[near]))[:n]].tolist()
    return np.lexsort((ids, -scores))[:n].tolist()


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5,
         low: int = 80, scale: float = 256.0, block: int = BLOCK, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` -> anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score. A negative scores from ``low`` hundredths of its
    positive's score up to that score."""
    rows = clean_rows(vectors, F.col("label") if label is None else label)
    blocks = Blocks(rows, scale, block, range_rows)
    anchors = written(blocks.rows.filter(is_anchor).select("uid", "vec_id", "label", "v"), "anchors")

    # a floor for each anchor's positives: from the block that promises most
    def seed(a, least, most, z):
        has = _has_label(a, z)
        mask = np.zeros(most.shape, bool)
        if len(z):
            value = np.where(has, most, -np.inf)
            best = value.argmax(1)
            mask[np.arange(len(a)), best] = has[np.arange(len(a)), best]
        return mask

    def same_label(anchor, ids, labels, scores):
        own = np.flatnonzero(labels == anchor.label)
        return [(anchor.uid, int(ids[own[i]]), held(scores[own[i]]))
                for i in _best(ids[own], scores[own], positives)]

    first = written(choose(anchors, blocks, seed, []), "seeds")
    # one block an anchor: the first of the parts' offers
    one = Window.partitionBy("uid").orderBy(F.desc("upper"), "range")
    first = first.withColumn("k", F.row_number().over(one)).filter("k = 1").drop("k")
    ddl = "uid long, positive_id long, score long"
    tops = written(read_blocks(anchors, first, blocks, [], same_label, ddl), "tops")
    floors = tops.groupBy("uid").agg(F.count(F.lit(1)).alias("m"), F.min("score").alias("floor")).filter(
        F.col("m") >= positives).drop("m")
    floored = anchors.join(floors, "uid", "left")

    def reach(a, least, most, z):
        floor = a["floor"].to_numpy(dtype=float, na_value=np.nan)
        return _has_label(a, z) & ((most >= floor[:, None]) | np.isnan(floor)[:, None])

    best = Window.partitionBy("uid").orderBy(F.desc("score"), "positive_id")
    found = read_blocks(floored, choose(floored, blocks, reach, ["floor"]), blocks, [], same_label, ddl)
    found = written(found.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= positives), "positives")

    # every positive is a window of scores
    windows = found.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("k", "positive_id", "score"))).alias("w"))
    asking = anchors.join(windows.select("uid", F.col("w.positive_id").alias("ps"), F.col("w.score").alias("tops")), "uid")

    def meets(a, least, most, z):
        mask = np.zeros(most.shape, bool)
        other = ~_only_label(a, z)
        for i, tops in enumerate(a["tops"]):
            for t in np.asarray(tops, float):
                mask[i] |= (100.0 * most[i] >= low * t * (1 - 1e-9) - 100) & (least[i] <= t * (1 + 1e-9) + 1)
        return mask & other

    def in_windows(anchor, ids, labels, scores):
        other = np.flatnonzero(labels != anchor.label)
        ids, scores = ids[other], scores[other]
        out = []
        for k, (p, t) in enumerate(zip(anchor.ps, anchor.tops, strict=True)):
            fit = np.flatnonzero((low * int(t) <= 100 * scores) & (scores <= int(t)))
            out += [(anchor.uid, k, int(p), int(t), int(ids[fit[i]]), held(scores[fit[i]]))
                    for i in _best(ids[fit], scores[fit], negatives)]
        return out

    ddl = "uid long, k int, positive_id long, positive_score long, negative_id long, negative_score long"
    offered = read_blocks(asking, choose(asking, blocks, meets, ["tops"]), blocks, ["ps", "tops"], in_windows, ddl)
    order = Window.partitionBy("uid", "k").orderBy(F.desc("negative_score"), "negative_id")
    kept = offered.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return kept.join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _has_label(a: pd.DataFrame, z: pd.DataFrame) -> np.ndarray:
    """Whether each zone (columns) holds a row of each anchor's label."""
    out = np.zeros((len(a), len(z)), bool)
    label = a["label"].to_numpy()
    for j, labels in enumerate(z["labels"]):
        out[:, j] = np.isin(label, labels)
    return out


def _only_label(a: pd.DataFrame, z: pd.DataFrame) -> np.ndarray:
    """Whether each zone holds rows of each anchor's label alone."""
    out = np.zeros((len(a), len(z)), bool)
    label = a["label"].to_numpy()
    for j, labels in enumerate(z["labels"]):
        if len(labels) == 1:
            out[:, j] = label == labels[0]
    return out
