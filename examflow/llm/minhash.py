"""Near-duplicate groups: MinHash, banding, confirmation, connected components.

1. One pass hashes every document's set of word shingles: its size, a 128-bit sum of
   the set (equal sets are one class from here on), ``rows * bands`` universal hash
   minima folded to one key a band, and one bit of each of 128 minima.
2. Classes that share a band key are candidates. A bucket gives each member a pair
   with its smallest and its largest member, not all pairs.
3. Pairs pass a size test, a signature test on the 128 bits and one on the parities
   of the sets' members in 1024 cells (each differing member turns one cell, so these
   tell sets just under the threshold), then the exact test on the full sets:
   ``num * intersection >= den * union``.
4. Links become components by alternating large-star and small-star.
5. Only buckets that now hold several components can hide a link. While these still
   have far more pairs than members, and the last round found links, another round gives each member a pair with the
   bucket's member of the least hash, and links extend the components. In what is
   left, members of different components are compared by the tests of 3 inside the
   join, and pairs that pass are confirmed; so no bucket is capped and none gives all
   its pairs.

A pair over the threshold shares no band with a chance of (1 - s^rows)^bands: 7e-6
at s = 0.8, 2e-8 at 0.85 for 5 x 30. The signature tests err below 1e-7.

* A word is ``[^\\x20\\x09-\\x0D]+``, lower-cased A-Z. With fewer than ``width`` words
  the whole sequence is the one shingle. Null, empty and blank texts have no set,
  are linked with nothing and are kept.
* Rows that share a doc_id count as one document: those that have words are in one
  component, and so is what any of them is linked with. Rows without a doc_id take no
  part: no component, kept. ``keep_one`` judges rows, not documents.
* Very long texts: a signature is one pass over their shingles, 1,024 at a time.
* An empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examflow.operators.rowindex import row_numbers

from .frames import python_ready, written
from .words import blocks, mix, powers, rolling

WIDTH, ROWS, BANDS = 5, 5, 30
SKETCH_BITS = 128
PARITY_CELLS = 1024
STAR_ROUNDS = 6
PAIRS_A_MEMBER = 8  # below this, pairs are compared instead of another round
# 1-bit minima of sets with similarity s differ in (1 - s) / 2 of the bits
_rng = np.random.default_rng(77003)
_FACTORS = _rng.integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ONE = np.uint64(0x5851F42D4C957F2D)


def max_differing_bits(num: int, den: int) -> int:
    """Bits that two sets of similarity den/num may differ in, at 5.5 sigma."""
    p = (1 - den / num) / 2
    return int(SKETCH_BITS * p + 5.5 * (SKETCH_BITS * p * (1 - p)) ** 0.5) + 1


def shingle_set(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a document from its word hashes."""
    if len(hashes) >= width:
        return np.unique(rolling(hashes, width))
    if not len(hashes):
        return hashes
    total = (hashes * powers(len(hashes), _ONE)).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return mix(np.asarray([total], np.uint64))


def minima(items: np.ndarray) -> np.ndarray:
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 1024):
        np.minimum(out, (_FACTORS[:, None] * items[None, at : at + 1024]).min(1), out=out)
    return out


_BAND_WEIGHTS = powers(ROWS, _ONE)
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                     ("s", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n (set size), k1, k2 (set sum), s (two words of bits of the minima,
    then the parities), bands."""
    python_ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows: list[list] = [[] for _ in _SIGNED]
            for first, _, _, _, hashes, bounds in blocks(texts, lower=True):
                for i in range(len(bounds) - 1):
                    items = shingle_set(hashes[bounds[i] : bounds[i + 1]], width)
                    if len(items):
                        low = mix(minima(items))
                        bands = mix((low.reshape(BANDS, ROWS) * _BAND_WEIGHTS).sum(1, dtype=np.uint64) + _BAND_SALT)
                        sketch = np.packbits((low[:SKETCH_BITS] & np.uint64(1)).astype(np.uint8)).view(np.int64)
                        odd = np.bincount(items.view(np.int64) & (PARITY_CELLS - 1), minlength=PARITY_CELLS) & 1
                        sketch = np.append(sketch, np.packbits(odd.astype(np.uint8)).view(np.int64))
                        key = [items.sum(dtype=np.uint64), mix(items ^ _ONE).sum(dtype=np.uint64)]
                        values = [*np.asarray(key).view(np.int64).tolist(), sketch, bands.view(np.int64)]
                    else:
                        values = [0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)]
                    for c, v in zip(rows, [ids[first + i], len(items), *values], strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(rows, _SIGNED, strict=True)], schema=_SIGNED)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, k1 long, k2 long, s array<long>, bands array<long>")


def full_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, items: the whole shingle set as an array of longs."""
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("items", pa.list_(pa.int64()))])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for first, _, _, _, hashes, bounds in blocks(texts, lower=True):
                sets = [shingle_set(hashes[bounds[i] : bounds[i + 1]], width).view(np.int64)
                        for i in range(len(bounds) - 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first : first + len(sets)], pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                    schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, items array<long>")


def components(links: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` -> node, component (its smallest node), for linked nodes.

    Alternates large-star and small-star until the links stop changing; every round
    is written to the shared folder. Minima are summed before their shuffle and
    joined back, so a node with many links is not gathered in one place.
    """
    def sized(df):
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter("a <> b").distinct(), name)
    seen = sized(edges)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        edges = written(small, name)
        now = sized(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_duplicates(docs: DataFrame, num: int = 100, den: int = 80, width: int = WIDTH) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_shingles, component_id, kept. Documents
    are linked if ``num * |A & B| >= den * |A | B|``."""
    signed = written(signatures(docs, width), "signatures")
    classes = written(
        signed.filter("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(
            F.min("doc_id").alias("rep"), F.first("s").alias("s"), F.first("bands").alias("bands")),
        "classes")
    members = classes.select(F.explode("bands").alias("key"), "rep")
    ends = members.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi")
    buckets = written(members.join(ends, "key"), "buckets")
    shared = buckets.select("rep").distinct()
    sets = written(full_sets(docs.join(shared, docs["doc_id"] == shared["rep"], "left_semi"), width)
                   .distinct(), "sets")
    words = 2 + PARITY_CELLS // 64
    brief = classes.join(shared, "rep", "left_semi").select(
        "rep", "n", *[F.col("s")[i].alias(f"s{i}") for i in range(words)])
    limit = max_differing_bits(num, den)

    def alike(x: str, y: str):
        n1, n2 = F.col(f"{x}.n"), F.col(f"{y}.n")
        bits = [F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(words)]
        # members that may differ, and the odd cells that so many leave
        apart = (n1 + n2) * (num - den) / (num + den)
        left = F.exp(-2.0 * apart / PARITY_CELLS)
        odd = PARITY_CELLS / 2 * (1 - left) + 5.5 * F.sqrt(PARITY_CELLS / 4 * (1 - left * left)) + 1
        return ((F.least(n1, n2) * num >= F.greatest(n1, n2) * den) & (sum(bits[:2]) <= limit)
                & (sum(bits[2:]) <= F.least(apart + 1e-6, odd)))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose full sets are alike."""
        one = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
        two = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
        inner = F.size(F.array_intersect("x", "y")).cast("long")
        return (pairs.join(one, "a").join(two, "b")
                .select("a", "b", inner.alias("i"), (F.size("x") + F.size("y")).cast("long").alias("t"))
                .filter(F.col("i") * num >= (F.col("t") - F.col("i")) * den).select("a", "b"))

    def linked(pairs: DataFrame) -> DataFrame:
        near = pairs.distinct().join(brief.alias("p"), F.col("a") == F.col("p.rep")).join(
            brief.alias("q"), F.col("b") == F.col("q.rep")).filter(alike("p", "q")).select("a", "b")
        return written(confirmed(near), "links")

    both = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    links = linked(buckets.select("rep", F.explode(F.array("lo", "hi")).alias("hub"))
                   .filter("rep <> hub").select(*both("rep", "hub")))
    found = components(links)

    # what the stars can have missed: members of one bucket in different components
    fruitless = False
    for k in range(STAR_ROUNDS + 1):
        place = shared.join(found, shared["rep"] == found["node"], "left").select(
            "rep", F.coalesce("component", "rep").alias("c"))
        rows = buckets.select("key", "rep").join(place, "rep")
        mixed = rows.groupBy("key").agg(
            F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m"),
            F.min_by("rep", F.xxhash64("rep", F.lit(k))).alias("hub"),
            F.min_by("c", F.xxhash64("rep", F.lit(k))).alias("hub_c")).filter("lo <> hi")
        rows = written(rows.join(mixed.select("key", "m", "hub", "hub_c"), "key"), "mixed")
        size = rows.agg(F.count(F.lit(1)).alias("members"), F.sum("m").alias("pairs")).first()
        if not size.members:
            break
        final = fruitless or k == STAR_ROUNDS or size.pairs <= PAIRS_A_MEMBER * size.members
        if final:
            full = rows.select("key", "rep", "c").join(brief, "rep")
            p, q = full.alias("p"), full.alias("q")
            last = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.rep") < F.col("q.rep"))
                          & (F.col("p.c") != F.col("q.c")) & alike("p", "q")).select(
                F.col("p.rep").alias("a"), F.col("q.rep").alias("b")).distinct()
            more = written(confirmed(last), "links")
        else:
            more = linked(rows.filter("c <> hub_c").select(*both("rep", "hub")))
        fruitless = more.isEmpty()
        if not fruitless:
            joined = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
            found = components(joined)
        if final:
            break

    # the classes of one document, where rows share a doc_id
    several = signed.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(
        *[F.min(c).alias(f"lo_{c}") for c in ("n", "k1", "k2")], *[F.max(c).alias(f"hi_{c}") for c in ("n", "k1", "k2")]
    ).filter("lo_n <> hi_n or lo_k1 <> hi_k1 or lo_k2 <> hi_k2").select("doc_id")
    if not several.isEmpty():
        one = signed.join(several, "doc_id").filter("n > 0").select("doc_id", "n", "k1", "k2").distinct()
        joined = one.join(classes.select("n", "k1", "k2", "rep"), ["n", "k1", "k2"]).select(
            F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(joined))

    top = classes.select("n", "k1", "k2", "rep").join(found, F.col("rep") == F.col("node"), "left").select(
        "n", "k1", "k2", F.coalesce("component", "rep").alias("c"))
    own = signed.join(top, ["n", "k1", "k2"], "left").withColumn("c", F.coalesce("c", "doc_id"))
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("c"))
                      .alias("component_id"), F.coalesce(F.col("doc_id") == F.col("c"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, num: int = 100, den: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near copies, all columns.

    Rows are judged, not doc_ids: rows that share one but not their text stay, and of
    equal rows one does: the row of the smallest doc_id, and of rows that share it the
    first by place in the table. Rows without words or doc_id stay.
    """
    ids = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if ids.isEmpty():
        gone = near_duplicates(docs, num, den).filter("not kept").select(F.col("doc_id").alias("_gone"))
        return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    # every row gets a number of its own, ascending with doc_id, written down so that it
    # stays the same; ids alone are sorted
    placed = written(docs.withColumn("_place", F.monotonically_increasing_id()), "rows")
    numbers = row_numbers(placed.select("doc_id", "_place"), ("doc_id", "_place"), "_row")
    rows = written(placed.join(numbers.select("_place", "_row"), "_place").drop("_place"), "rows")
    gone = near_duplicates(rows.filter("doc_id is not null").select(F.col("_row").alias("doc_id"), "text"), num, den
                           ).filter("not kept").select(F.col("doc_id").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)
