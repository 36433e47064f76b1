"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line or, in a line of any length, a part that ends at a sentence end or
after a word (what lies between blanks) whose hash has six zero bits, one word in 64: so
runs without sentence ends are cut by their content too, and an edit moves only the cuts
beside it.
A text is the set of its paragraphs' 64-bit digests. A sketch has three tables
of ``s`` cells; each digest is added to one cell of each table, and a cell holds
(count, xor of digests, xor of check hashes). Subtracting the sketches of two
versions cancels what they share. Peeling takes digests from cells that hold just
one (its check hash fits) out of their other cells, until nothing is left: then the
differing digests of both sides are known. If digests remain, the comparison is
tried again with a larger sketch: first 3 * 4 cells; then 3 * 4 in each of so many
sub-sketches that some 4 digests meet in one; then 3 * 16 and 3 * 64 for those of
them that still fail; digests that share all cells even there are compared as such.

Everything is a DataFrame expression on one row; no Python runs on executors.

* Null is the empty text. No paragraphs on either side: likeness 1. Equal texts have
  equal fingerprints. Blank lines are left out, repeated paragraphs count once.
* The next document is the next row by (doc_id, text), null ids first, and the first
  row after the last. One row is its own next. Repeated rows each get a result. An
  empty table gives no rows; extra columns are dropped.
* A run without blanks is one word and is never cut, however long; neither is a line of
  few different words none of which is chosen.
* Very long texts: work grows with the paragraphs, times their groups of some 128.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import partitions

SMALL, SUB, RETRIES = 4, 4, (16, 64)  # cells of one table
SHARE = 4  # digests that meet in a sub-sketch, on average
ROUNDS = 10
GROUP = 64  # words of a group, on average
RANGES = 65_536  # at most so many ranges of doc_id
_ID = "_id"


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), f)[0]


def digests(text: Column) -> Column:
    """Distinct paragraph digests of a text, as array<long>."""
    ends = lambda w: F.xxhash64(w, F.lit("end")).bitwiseAND(F.lit(GROUP - 1)) == 0
    marked = F.transform(F.split(text, " "), lambda w: F.when(ends(w), F.concat(w, F.lit("\n"))).otherwise(w))
    paragraphs = F.split(F.array_join(marked, " "), r"\n ?|(?<=[.!?]) ")
    return F.array_distinct(F.transform(F.filter(paragraphs, lambda x: x != ""), lambda x: F.xxhash64(x)))


def _entry(key: Column, count: Column, s: int) -> Column:
    # its cell in each of the three tables, which lie one after another: as bits of a
    # long where they fit
    places = [(F.pmod(F.xxhash64(key, F.lit(j)), F.lit(s)) + j * s).cast("int") for j in range(3)]
    if 3 * s < 64:
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places]
        where = bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])
    else:
        where = F.array(*places)
    return F.struct(count.alias("n"), key.alias("k"), F.xxhash64(key, F.lit("check")).alias("c"), where.alias("p"))


def _lies_in(entry: Column, cell: Column, s: int) -> Column:
    if 3 * s < 64:
        return F.getbit(entry["p"], cell) == F.lit(1).cast("byte")
    return F.array_contains(entry["p"], cell)


def _cell(count: Column, keys: Column, checks: Column) -> Column:
    return F.struct(count.alias("n"), keys.alias("k"), checks.alias("c"))


def _xor(start: Column, entries: Column, field: str) -> Column:
    return F.aggregate(entries, start, lambda a, x: a.bitwiseXOR(x[field]))


def sketch(keys: Column, s: int) -> Column:
    """The 3 * s cells of a set of digests: array<struct<n, k, c>>."""
    zero = F.lit(0).cast("long")
    entries = F.transform(keys, lambda k: _entry(k, F.lit(1), s))
    return _let(entries, lambda e: F.transform(F.lit(list(range(3 * s))), lambda t: _let(
        F.filter(e, lambda x: _lies_in(x, t, s)), lambda f: _cell(F.size(f), _xor(zero, f, "k"), _xor(zero, f, "c")))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(
        x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


def peel(cells: Column, s: int) -> Column:
    """struct<cells, found>: ``found`` the recovered (n, k): n = 1 only in the first
    version, -1 only in the second. Complete if ``cells`` is empty; else null ``found``
    or cells that are left."""
    none = F.array().cast("array<struct<n: int, k: bigint>>")
    over = F.array().cast("array<struct<n: int, k: bigint, c: bigint>>")

    def one_round(state: Column, _: Column) -> Column:
        single = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (
            F.xxhash64(c["k"], F.lit("check")) == c["c"]))
        items = F.array_distinct(F.transform(single, lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"))))

        def without(c: Column, f: Column) -> Column:
            return F.when(F.size(f) == 0, c).otherwise(_cell(
                F.aggregate(f, c["n"], lambda a, x: a - x["n"]), _xor(c["k"], f, "k"), _xor(c["c"], f, "c")))

        def take(found: Column) -> Column:
            rest = _let(F.transform(found, lambda i: _entry(i["k"], i["n"], s)), lambda e: F.transform(
                state["cells"], lambda c, at: _let(
                    F.filter(e, lambda x: _lies_in(x, at, s)), lambda f: without(c, f))))
            return F.struct(rest.alias("cells"), F.concat(state["found"], found).alias("found"))

        empty = F.forall(state["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0))
        stop = F.struct(over.alias("cells"), F.when(empty, state["found"]).alias("found"))
        return F.when(F.size(state["cells"]) == 0, state).otherwise(
            _let(items, lambda found: F.when(F.size(found) == 0, stop).otherwise(take(found))))

    start = F.struct(cells.alias("cells"), none.alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round)


def _recovered(cells: Column, s: int) -> Column:
    """Number of differing digests, null if peeling stops short."""
    return _let(peel(cells, s), lambda r: F.when(
        (F.size(r["cells"]) == 0) & r["found"].isNotNull(), F.size(r["found"])))


def differing(a: Column, b: Column, small: Column) -> Column:
    """How many digests of ``a`` and ``b`` differ; ``small`` is the difference of
    their small sketches."""
    gap = F.abs(F.size(a) - F.size(b))
    attempt = lambda x, y, s: _recovered(subtract(sketch(x, s), sketch(y, s)), s)

    def cut(x: Column, y: Column, share: int, shift: int, then) -> Column:
        """Sum of ``then`` over parts that hold some ``share`` digests each, by the
        digests' own bits from ``shift`` on."""
        part = lambda z, n, t: F.filter(z, lambda k: F.pmod(F.shiftright(k, shift), n) == t)
        return _let(((F.size(x) + F.size(y)) / share).cast("long") + 1, lambda n: F.aggregate(
            F.sequence(F.lit(0).cast("long"), n - 1), F.lit(0),
            lambda total, t: total + _let(part(x, n, t), lambda v: _let(part(y, n, t), lambda w: then(v, w)))))

    def sub(x: Column, y: Column) -> Column:
        return F.coalesce(*[attempt(x, y, s) for s in (SUB, *RETRIES)],
                          F.size(F.array_except(x, y)) + F.size(F.array_except(y, x)))

    # in two steps, so that a long text is not searched once for each sub-sketch
    spread = cut(a, b, 16 * SHARE, 0, lambda x, y: cut(x, y, SHARE, 32, sub))
    return F.coalesce(F.when(gap <= 3 * SMALL, _recovered(small, SMALL)), spread)


def likeness(a: Column, b: Column, small: Column) -> Column:
    """Shared over all digests, from the sizes and the recovered difference."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(_let(
        differing(a, b, small), lambda d: (total - d).cast("double") / (total + d)))


def as_text(keys: Column, cells: Column) -> Column:
    """The fingerprint as a string: set size, then count.digests.checks of each cell."""
    cell = lambda c: F.concat_ws(".", c["n"].cast("string"), F.hex(c["k"]), F.hex(c["c"]))
    return F.concat_ws("/", F.size(keys).cast("string"), F.array_join(F.transform(cells, cell), "/"))


def _numbers(values: list[int]) -> Column:
    return F.lit(values).cast("array<long>")


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Add next_<c> for each carried column: that of the next row by (doc_id, text).

    Rows are dealt to ranges of doc_id, some thousand in each; the rows of the first
    id of a range are copied to the range before, so every range finds its last
    row's next without a total order in one task.
    """
    spark = rows.sparkSession
    rows = rows.withColumn(_ID, F.coalesce("doc_id", F.lit(-(2**63))))
    count = rows.count()
    n = min(max(8 * partitions(spark), count // 4096 + 1), RANGES)
    cuts = rows.agg(F.percentile_approx(_ID, [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] or []
    cuts = sorted(set(cuts))
    halves = [2**k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    table = _numbers(cuts)
    # number of cuts at or under the id, by halving
    search = F.aggregate(_numbers(halves), F.lit(0).cast("long"), lambda lo, h: F.when(
        (lo + h <= len(cuts)) & (F.get(table, (lo + h - 1).cast("int")) <= F.col(_ID)), lo + h).otherwise(lo))
    rows = rows.withColumn("_range", search if cuts else F.lit(0).cast("long"))
    firsts = rows.groupBy("_range").agg(F.min(_ID).alias("m")).orderBy("_range").collect()  # one row a range
    low, before = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for i, r in enumerate(firsts):
        low[r["_range"]] = r["m"]
        before[r["_range"]] = firsts[i - 1]["_range"]
    own = F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy"))
    place = F.col("_range").cast("int")
    copy = F.struct(F.get(_numbers(before), place).alias("r"), F.lit(1).alias("copy"))
    dealt = rows.withColumn("_at", F.explode(F.when(
        F.get(_numbers(low), place) == F.col(_ID), F.array(own, copy)).otherwise(F.array(own))))
    dealt = dealt.withColumn("_r", F.col("_at.r")).withColumn("_copy", F.col("_at.copy")).drop("_at", "_range")
    order = Window.partitionBy("_r").orderBy("_copy", _ID, "text")
    for c in carried:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(order))
    return dealt.filter("_copy = 0").drop("_r", "_copy", _ID)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("d", digests(F.col("text")))
    rows = with_next(base.withColumn("sd", sketch(F.col("d"), SMALL)), ["text", "d", "sd"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select(
        "doc_id", "d", "sd", F.col("next_d").alias("x"), F.col("next_sd").alias("sx"), n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - half),
                 F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    rows = rows.select("doc_id", "n_chars", "d", "x", "sd", "sx", digests(F.col("edited")).alias("e"),
                       F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    rows = rows.withColumn("se", sketch(F.col("e"), SMALL))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("d"), F.col("sd")).alias("fingerprint"),
        as_text(F.col("e"), F.col("se")).alias("edited_fingerprint"),
        likeness(F.col("d"), F.col("e"), subtract(F.col("sd"), F.col("se"))).alias("near_edited"),
        likeness(F.col("d"), F.col("x"), subtract(F.col("sd"), F.col("sx"))).alias("near_next"))
