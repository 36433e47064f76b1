"""Token ids of a corpus in shard files: a wavelet matrix per shard.

Documents are encoded, each with an end id, and laid one after another in ascending
doc_id order. Rows are dealt to ascending ranges of doc_id; the task that has a range
streams its documents in order and cuts their ids into shards of at most
``shard_tokens``, whatever the documents' borders. A shard file (Parquet, one row, zstd)
holds its range and number, the planes of a wavelet matrix (one bit of each id a plane,
most significant first; each plane sorts the ids stably by its bit), their numbers of
zeros, a directory of the ones before every 512 bits, and its documents' pieces. From one
file ``Wavelet`` gives

* ``access``: the ids at any places,
* ``rank``: how often an id occurs before a place, and ``count``,
* ``select``: the place of the k-th occurrence, and so all ``occurrences``,
* ``ids``: the whole sequence, all planes undone.

``token_at``, ``count_tokens`` and ``occurrences`` ask the files of a whole corpus. Where
a shard lies in the corpus follows from the numbers of ids of those before it: the sums
of the ranges, a bounded table, and a running sum inside each range.

* Null text: empty, only the end id. Null doc_ids come first. Rows with equal doc_id
  follow one another by their place in the table; a doc_id that fills ranges of its own is
  split along these places. Repeated rows are documents of their own. An empty table
  gives no rows. Extra columns are not read.
* Very long texts span several shards; their crc is combined from those of the pieces.
* Special tokens' strings in a text are special tokens, as in the tokenizers library.
* The table has to be one that Spark reads from files, whose rows keep their places when
  a task is run again.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examflow.operators.rowindex import ranges
from examflow.session import scratch_path

from .frames import byte_letters, python_ready, written

END_ID = 2
SHARD_TOKENS = 1 << 22
RANGE_ROWS = 8192
DIRECTORY_BITS = 512
CACHE = 300_000  # runs whose ids a worker keeps
CACHE_BYTES = 16 << 20
SLICE_BYTES = 4 << 20  # text encoded at a time, but whole documents
QUESTIONS = 65_536  # places asked of one shard at a time
_loaded: dict[str, tuple] = {}


# --- encoding -----------------------------------------------------------------------


# Words of Latin-1 letters in lower case have the bytes a-z, C3 and, behind it, 9F and
# A0-BF. Each byte, and each last byte of a word but C3, has an ASCII sign of its own.
_INSIDE, _ENDING = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_SIGNS = iter([x for x in range(1, 128) if x != ord(" ")])
for _b in [*range(ord("a"), ord("z") + 1), 0x9F, *range(0xA0, 0xC0)]:
    _INSIDE[_b], _ENDING[_b] = next(_SIGNS), next(_SIGNS)
_INSIDE[0xC3] = next(_SIGNS)
_LETTER = _INSIDE > 0
# ASCII signs behind a word; an apostrophe may open a token with letters
_TAIL = np.zeros(256, bool)
_TAIL[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) != "'"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# white space of one byte ends a run, as a line end
_ENDED = np.arange(256, dtype=np.uint8)
_ENDED[[9, 11, 12, 13, 32]] = 10


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces of ``flat``, one after another."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets from 0 on) of a string or binary array without nulls."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    values = values.cast(pa.large_binary())
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def _array_of(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [
        None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class PlainWords:
    """Byte-pair encoding of many words at once: of Latin-1 letters, with ASCII signs
    behind them. A word's last byte has a sign of its own, as the vocabulary has tokens of
    its own for the ends of words, so the words are one text whose tokens tell where each
    word ends."""

    def __init__(self, vocabulary: dict[str, int]):
        import tiktoken

        letters, ranks = byte_letters(), {}
        for token, rank in vocabulary.items():
            ends = token.endswith("</w>") and len(token) > 4
            data = np.asarray([letters.get(c, 0) for c in (token[:-4] if ends else token)], np.uint8)
            if _LETTER[data].all() and not (ends and data[-1] == 0xC3):
                signs = _INSIDE[data]
                if ends:
                    signs[-1] = _ENDING[data[-1]]
                ranks[signs.tobytes()] = rank
        # every sign is a token, so that all words can be written
        self.usable = sum(len(x) == 1 for x in ranks) == np.count_nonzero(_INSIDE) + np.count_nonzero(_ENDING)
        if self.usable:
            self.core = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[r for x, r in ranks.items() if x[-1] in set(_ENDING.tolist()) - {0}]] = True

    def encode(self, data: np.ndarray, offsets: np.ndarray, tail_ids, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, numbers of ids, ids) of the plain words among ``data[offsets[i]:
        offsets[i + 1]]``, each with a line end; ``tail_ids`` gives the ids of the signs
        behind the letters."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
        start, at_end = offsets[:-1], offsets[1:] - 1
        if not len(start):
            return none
        # lower case of A-Z and, behind C3, of 80-9E without the sign 97
        lead = data == 0xC3
        lowered = _LOWER[data]
        capital = lead[:-1] & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        lowered[1:][capital] += 32
        data = lowered
        letter, tail = _LETTER[data], _TAIL[data]
        # C3 B7 is a sign of its own
        division = np.flatnonzero(lead[:-1] & (data[1:] == 0xB7))
        other = ~(letter | tail)
        other[at_end] = False
        other[division] = True
        # 9F and A0-BF are letters behind C3 only, and C3 is one before them only
        follows = (data >= 0x80) & (data < 0xC3)
        other[1:] |= follows[1:] != lead[:-1]
        other[0] |= follows[0]
        back = np.append(False, tail[:-1] & letter[1:])  # a letter behind a sign
        good = ~np.logical_or.reduceat(other | back, start) & letter[start] & (at_end > start)
        plain = np.flatnonzero(good)
        if not len(plain):
            return none
        n_tail = np.add.reduceat(tail, start, dtype=np.int64)[plain]
        here = np.repeat(good, at_end + 1 - start)
        last = at_end[plain] - n_tail - 1
        signs = _INSIDE[data]
        signs[last] = _ENDING[data[last]]
        signs[at_end] = ord(" ")
        tails = _array_of(data[here & tail], np.append(0, np.cumsum(n_tail))).dictionary_encode()
        letter[at_end] = True
        ids = np.asarray(self.core.encode_ordinary(signs[here & letter].tobytes().decode("ascii")), kind)
        cut = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
        behind = [tail_ids(t.decode()) if t else [] for t in tails.dictionary.to_pylist()]
        n_behind = np.asarray([len(t) for t in behind], np.int64)
        of = tails.indices.to_numpy()
        # of each word its letters, then its signs
        starts = np.stack([cut[:-1], (len(ids) + np.cumsum(n_behind) - n_behind)[of]], 1).ravel()
        lengths = np.stack([np.diff(cut), n_behind[of]], 1).ravel()
        flat = np.concatenate([ids, *(np.asarray(t, kind) for t in behind)])
        return plain, lengths.reshape(-1, 2).sum(1), gather(flat, starts, lengths)


class KnownRuns:
    """The ids of runs that were encoded before: ``flat[starts[i]:starts[i] + lengths[i]]``
    of the i-th of ``runs``."""

    def __init__(self, kind):
        self.runs, self.flat = pa.array([], pa.binary()), np.zeros(0, kind)
        self.starts = self.lengths = np.zeros(0, np.int64)

    def add(self, runs: pa.Array, lengths: np.ndarray, flat: np.ndarray) -> None:
        self.runs = pa.concat_arrays([self.runs, runs])
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lengths) - lengths)
        self.lengths, self.flat = np.append(self.lengths, lengths), np.append(self.flat, flat)

    def full(self) -> bool:
        return len(self.runs) > CACHE or self.runs.nbytes + self.flat.nbytes > CACHE_BYTES


def load_tokenizer(path: str) -> tuple:
    """(tokenizer, encoder of plain words or None, known runs in a list, bytes an id)."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        model = json.loads(tok.to_str())["model"]
        vocabulary = model["vocab"] if model.get("end_of_word_suffix") == "</w>" else {}
        # ids of merged tokens ascend with their merges, so an id is a rank
        merged = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model.get("merges", [])]
        plain = PlainWords(vocabulary) if vocabulary and None not in merged and merged == sorted(merged) else None
        width = 2 if tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        _loaded[path] = (tok, plain if plain and plain.usable else None, [KnownRuns(f"<u{width}")], width)
    return _loaded[path]


def encode_column(texts: pa.Array, path: str, end_id: int = END_ID) -> pa.Array:
    """The ids of each text and the end id, 2 or 4 bytes an id, little-endian."""
    tok, plain, cache, width = load_tokenizer(path)
    kind = f"<u{width}"
    data, offsets = _bytes_of(texts.fill_null(""))
    # no token spans white space, so runs between it are encoded by themselves; each run
    # has the line end behind it, as every text gets one
    data = _ENDED[np.insert(data, offsets[1:], 10)]
    cuts = np.append(0, np.flatnonzero(data == 10) + 1)
    found = _array_of(data, cuts).dictionary_encode()
    if cache[0].full():
        cache[0] = KnownRuns(kind)
    known = cache[0]
    place = pc.index_in(found.dictionary, value_set=known.runs)
    new = found.dictionary.filter(place.is_null())
    size, ids = np.zeros(len(new), np.int64), np.zeros(0, kind)
    if len(new):
        encode = lambda t: tok.encode(t, add_special_tokens=False).ids
        plainly, n, ids = plain.encode(*_bytes_of(new), encode, kind) if plain is not None else (np.zeros(0, np.int64), size[:0], ids)
        rest = np.delete(np.arange(len(new)), plainly)
        slow = [x[:-1].decode() for x in new.take(pa.array(rest)).to_pylist()]
        more = [e.ids for e in tok.encode_batch(slow, add_special_tokens=False)]
        size[plainly], size[rest] = n, [len(x) for x in more]
        # runs in the order of ``known``: the plain ones, then the others
        order = np.append(plainly, rest)
        known.add(new.take(pa.array(order)), size[order], np.concatenate([ids, *(np.asarray(x, kind) for x in more)]))
        place = pc.index_in(found.dictionary, value_set=known.runs)
    of = place.to_numpy()[found.indices.to_numpy()]
    lengths = known.lengths[of]
    ids = gather(known.flat, known.starts[of], lengths)
    # the last run of each text ends where the next text begins
    last = np.searchsorted(cuts, offsets[1:] + np.arange(1, len(texts) + 1))
    ends = np.append(0, np.cumsum(lengths))[last]
    ids = np.insert(ids, ends, end_id)
    return _array_of(ids.view(np.uint8), np.append(0, ends + np.arange(1, len(texts) + 1)) * width)


def encode_texts(texts: list[str | None], path: str, end_id: int = END_ID) -> list[bytes]:
    """As ``encode_column``, of a list."""
    return encode_column(pa.array(texts, pa.string()), path, end_id).to_pylist()


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """``docs(..., text)`` -> the columns before ``text``, which is the last, and ids."""
    python_ready(docs.sparkSession)
    kept = docs.columns[:-1]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("ids", T.BinaryType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(len(kept))
            ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while at < len(texts):
                # whole texts, at least one
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
                part = batch.slice(at, to - at)
                ids = encode_column(part.column(len(kept)), path, end_id)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*kept, "ids"])
                at = to

    return docs.mapInArrow(run, schema)


# --- the matrix -----------------------------------------------------------------------


@dataclass
class Wavelet:
    """A wavelet matrix of ``n`` ids: packed planes, zeros of each, ones directory."""

    n: int
    planes: list[np.ndarray]  # packed bits, padded to whole directory blocks
    zeros: list[int]
    ones: list[np.ndarray]  # before every DIRECTORY_BITS

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> Wavelet:
        planes, zeros, ones = [], [], []
        now = ids
        step = DIRECTORY_BITS // 8
        for level in range(bits):
            up = (now & now.dtype.type(1 << (bits - 1 - level))).astype(bool)
            packed = np.packbits(up)
            packed = np.append(packed, np.zeros(-len(packed) % step, np.uint8))
            planes.append(packed)
            counts = np.bitwise_count(packed.view("<u8")).reshape(-1, step // 8).sum(1, dtype=np.int64)
            ones.append(np.cumsum(counts) - counts)
            zeros.append(int(len(now) - np.count_nonzero(up)))
            now = np.concatenate([now[~up], now[up]])
        return cls(len(ids), planes, zeros, ones)

    def bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1

    def ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place (0 to n)."""
        block = at // DIRECTORY_BITS
        total = np.append(self.ones[level], self.n - self.zeros[level])[block]
        step = DIRECTORY_BITS // 8
        inside = at - block * DIRECTORY_BITS
        rows = self.planes[level].reshape(-1, step)[np.minimum(block, len(self.ones[level]) - 1)]
        bits = np.unpackbits(rows, axis=1)
        return total + np.where(np.arange(DIRECTORY_BITS)[None, :] < inside[:, None], bits, 0).sum(1, dtype=np.int64)

    def access(self, at: np.ndarray) -> np.ndarray:
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for level in range(len(self.planes)):
            up = self.bit(level, at).astype(bool)
            ones = self.ones_before(level, at)
            at = np.where(up, self.zeros[level] + ones, at - ones)
            out = out * 2 + up
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` before ``end`` lie below the last plane."""
        lo, hi = 0, end
        for level in range(len(self.planes)):
            a, b = self.ones_before(level, np.asarray([lo, hi])).tolist()
            if token >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, end: int) -> int:
        """Occurrences of ``token`` before place ``end``."""
        if not self.n or token < 0 or token >> len(self.planes):
            return 0
        lo, hi = self._range(token, end)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, ks: np.ndarray) -> np.ndarray:
        """Places of the k-th occurrences, k from 0 to count - 1."""
        at = self._range(token, self.n)[0] + np.asarray(ks, np.int64)
        for level in range(len(self.planes) - 1, -1, -1):
            up = bool(token >> (len(self.planes) - 1 - level) & 1)
            k = at - self.zeros[level] if up else at
            # the block that holds the k-th such bit, then the bit in it
            before = self.ones[level]
            if not up:
                before = np.arange(len(before)) * DIRECTORY_BITS - before
            block = np.searchsorted(before, k, "right") - 1
            rows = np.unpackbits(self.planes[level].reshape(-1, DIRECTORY_BITS // 8)[block], axis=1) == up
            nth = np.cumsum(rows, 1) == (k - before[block] + 1)[:, None]
            at = block * DIRECTORY_BITS + nth.argmax(1)
        return at

    def occurrences(self, token: int, step: int = 4096):
        """Places of all occurrences, ascending, in runs of ``step``."""
        total = self.count(token)
        for k in range(0, total, step):
            yield self.select(token, np.arange(k, min(k + step, total)))

    def ids(self) -> np.ndarray:
        """The whole sequence: the planes undone from the last to the first."""
        bits = len(self.planes)
        out = np.zeros(self.n, np.uint32 if bits > 16 else np.uint16)
        for level in range(bits - 1, -1, -1):
            up = np.unpackbits(self.planes[level], count=self.n).view(bool)
            back = np.empty_like(out)
            back[~up] = out[: self.zeros[level]]
            back[up] = out[self.zeros[level] :] | out.dtype.type(1 << (bits - 1 - level))
            out = back
        return out


# --- shard files ------------------------------------------------------------------------

_PIECE = pa.struct([("doc_id", pa.int64()), ("uid", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64()),
                    ("at", pa.int64()), ("length", pa.int64())])
_FILE = pa.schema([
    ("r", pa.int64()), ("s", pa.int32()), ("number", pa.int32()), ("tokens", pa.int64()), ("zeros", pa.list_(pa.int64())),
    ("planes", pa.list_(pa.binary())), ("ones", pa.list_(pa.binary())), ("docs", pa.list_(_PIECE))])
_FILE_DDL = ("r long, s int, number int, tokens long, zeros array<long>, planes array<binary>, ones array<binary>, "
             "docs array<struct<doc_id: long, uid: long, n_tokens: long, before: long, at: long, length: long>>")
_MATRIX = ["tokens", "zeros", "planes", "ones"]
KEY = ["r", "s", "number"]


class _Shard:
    """Ids and pieces of a shard that is being filled."""

    def __init__(self, r: int, s: int, number: int, width: int, bits: int, size: int):
        self.key, self.width, self.bits, self.room = (r, s, number), width, bits, size
        self.ids: list = []
        self.docs: list[tuple] = []
        self.tokens = 0

    def add(self, doc_id, uid: int, ids: memoryview, before: int) -> int:
        """Take what fits of a document from ``before`` on; how many ids that is."""
        n = len(ids) // self.width
        take = min(n - before, self.room)
        self.ids.append(ids[before * self.width : (before + take) * self.width])
        self.docs.append((doc_id, uid, n, before, self.tokens, take))
        self.tokens += take
        self.room -= take
        return take

    def row(self) -> pa.RecordBatch:
        w = Wavelet.of(np.frombuffer(b"".join(self.ids), f"<u{self.width}"), self.bits)
        docs = pa.StructArray.from_arrays(
            [pa.array(c, pa.int64()) for c in zip(*self.docs, strict=True)], fields=list(_PIECE))
        return pa.RecordBatch.from_arrays([
            *(pa.array([x], f.type) for x, f in zip(self.key, _FILE, strict=False)), pa.array([w.n], pa.int64()),
            pa.array([w.zeros], _FILE.field("zeros").type), pa.array([[p.tobytes() for p in w.planes]], _FILE.field("planes").type),
            pa.array([[o.astype("<u4").tobytes() for o in w.ones]], _FILE.field("ones").type),
            pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)], schema=_FILE)


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID,
              shard_tokens: int = SHARD_TOKENS, range_rows: int = RANGE_ROWS) -> None:
    """``docs(doc_id, text)`` -> shard files under ``path``."""
    tok, _, _, width = load_tokenizer(tokenizer_path)
    bits = max(tok.get_vocab_size(with_added_tokens=True) - 1, end_id).bit_length()
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("uid"))
    dealt = ranges(rows, F.coalesce("doc_id", F.lit(-(2**63))), F.col("uid"), range_rows)
    ids = encoded(dealt.select("_r", "_s", "_k", "uid", "doc_id", "text"), tokenizer_path, end_id)

    def build(batches):
        shard = None
        for batch in batches:
            cols = batch.select(["_r", "_s", "doc_id", "uid"]).to_pydict()
            data = batch.column(batch.schema.names.index("ids"))
            for k, (r, s, doc_id, uid) in enumerate(zip(*cols.values(), strict=True)):
                if shard is None or shard.key[:2] != (r, s):
                    if shard is not None:
                        yield shard.row()
                    shard = _Shard(r, s, 0, width, bits, shard_tokens)
                own, before = memoryview(data[k].as_buffer()), 0
                while before < len(own) // width:
                    if not shard.room:
                        yield shard.row()
                        shard = _Shard(r, s, shard.key[2] + 1, width, bits, shard_tokens)
                    before += shard.add(doc_id, uid, own, before)
        if shard is not None:
            yield shard.row()

    ordered = ids.repartition("_r", "_s").sortWithinPartitions("_r", "_s", "_k", "uid")
    (ordered.select("_r", "_s", "doc_id", "uid", "ids").mapInArrow(build, _FILE_DDL)
     .write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shard files under ``path``, a row each."""
    return spark.read.schema(_FILE_DDL).parquet(path)


def shard_places(spark: SparkSession, path: str) -> DataFrame:
    """r, s, number, tokens, first: where each shard begins in the corpus."""
    shards = read_shards(spark, path).select(*KEY, "tokens")
    before = Window.orderBy("r", "s").rowsBetween(Window.unboundedPreceding, -1)
    # a row a range: a bounded table
    sums = shards.groupBy("r", "s").agg(F.sum("tokens").alias("_sum")).withColumn(
        "_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("r", "s").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("_here", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(
        F.broadcast(sums), ["r", "s"]).select(*KEY, "tokens", (F.col("_before") + F.col("_here")).alias("first"))


def _matrix(batch: pa.RecordBatch, row: int) -> Wavelet:
    col = lambda name: batch.column(batch.schema.names.index(name))[row]
    return Wavelet(col("tokens").as_py(), [np.frombuffer(x.as_buffer(), np.uint8) for x in col("planes").values],
                   col("zeros").as_py(), [np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in col("ones").values])


def crc32_join(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings put together, from theirs and the second one's length:
    the first is multiplied by x^(8 * length) modulo the polynomial (reflected)."""
    def times(a: int, b: int) -> int:
        out = 0
        for _ in range(32):
            if a & 0x80000000:
                out ^= b
            a = a << 1 & 0xFFFFFFFF
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, base, n = 0x80000000, 0x00800000, length  # 1 and x^8
    while n:
        if n & 1:
            power = times(power, base)
        base, n = times(base, base), n >> 1
    return times(first, power) ^ second


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of 32-bit ids) of all documents in the files."""
    python_ready(spark)
    names = [*KEY, *_PIECE.names, "crc"]

    def decode(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids = memoryview(_matrix(batch, row).ids().astype("<u4").view(np.uint8))
                docs = batch.column(batch.schema.names.index("docs"))[row].values
                cols = [docs.field(k) for k in range(len(_PIECE))]
                crc = [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(*(c.to_pylist() for c in cols[4:]), strict=True)]
                key = [pa.repeat(batch.column(batch.schema.names.index(k))[row], len(docs)) for k in KEY]
                yield pa.RecordBatch.from_arrays([*key, *cols, pa.array(crc, pa.int64())], names=names)

    pieces = read_shards(spark, path).mapInArrow(
        decode, "r long, s int, number int, " + ", ".join(f"{c} long" for c in names[3:]))
    # narrow rows, read twice
    pieces = written(pieces, "pieces").join(shard_places(spark, path).select(*KEY, "first"), KEY).withColumn(
        "start", F.col("first") + F.col("at") - F.col("before"))

    @F.udf("long")
    def joined(parts) -> int:
        crc = 0
        for p in parts:
            crc = crc32_join(crc, p.crc, 4 * p.length)
        return crc

    # the pieces of a document that spans shards meet without their ids
    cut = pieces.filter("length < n_tokens").groupBy("r", "s", "uid", "doc_id", "start", "n_tokens").agg(
        F.sort_array(F.collect_list(F.struct("before", "length", "crc"))).alias("parts"))
    whole = pieces.filter("length = n_tokens").select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))
    return whole.unionByName(cut.select("doc_id", "start", "n_tokens", joined("parts").alias("ids_crc32")))


def token_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """``places(place)`` -> place, token, for each distinct place inside the corpus."""
    python_ready(spark)
    shards = read_shards(spark, path)
    # strips of places that no shard is longer than: a shard lies in two at most
    strip = shards.agg(F.max("tokens")).first()[0] or 1
    where = shard_places(spark, path)
    where = where.withColumn("strip", F.explode(F.array_distinct(F.array(
        F.expr(f"first div {strip}L"), F.expr(f"(first + tokens - 1) div {strip}L")))))
    asked = places.filter("place >= 0").select("place").distinct().withColumn("strip", F.expr(f"place div {strip}L"))
    asked = asked.join(where, "strip").filter("place >= first AND place < first + tokens")
    # at most QUESTIONS places a group, whatever a shard is asked for
    asked = asked.groupBy(*KEY, "first", F.expr(f"place div {QUESTIONS}L").alias("_part")).agg(
        F.collect_list("place").alias("places"))

    def answer(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                at = np.asarray(batch.column(batch.schema.names.index("places"))[row].values)
                token = _matrix(batch, row).access(at - batch.column(batch.schema.names.index("first"))[row].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(token, pa.int64())], names=["place", "token"])

    return shards.select(*KEY, *_MATRIX).join(asked, KEY).select("first", "places", *_MATRIX).mapInArrow(
        answer, "place long, token long")


def _each_token(spark: SparkSession, path: str, tokens: DataFrame, ddl: str, answer) -> DataFrame:
    """``answer(matrix, shard, token)`` for every shard and distinct token. The tokens are
    at most as many as the vocabulary has."""
    python_ready(spark)
    bits = F.max(F.size("planes"))
    limit = 1 << (read_shards(spark, path).agg(bits).first()[0] or 0)
    asked = [r.token for r in tokens.filter((F.col("token") >= 0) & (F.col("token") < limit))
             .select(F.col("token").cast("long").alias("token")).distinct().collect()]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                w = _matrix(batch, row)
                key = [batch.column(k)[row].as_py() for k in range(len(KEY))]
                for token in asked:
                    yield from answer(w, key, token)

    return read_shards(spark, path).select(*KEY, *_MATRIX).mapInArrow(run, ddl)


def count_tokens(spark: SparkSession, path: str, tokens: DataFrame) -> DataFrame:
    """``tokens(token)`` -> token, n: occurrences in the corpus of each distinct token
    of the vocabulary's range."""
    def answer(w: Wavelet, _key: list, token: int):
        yield pa.RecordBatch.from_pydict({"token": pa.array([token], pa.int64()), "n": pa.array([w.count(token)], pa.int64())})

    each = _each_token(spark, path, tokens, "token long, n long", answer)
    return each.groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, tokens: DataFrame) -> DataFrame:
    """``tokens(token)`` -> token, place: every place of each distinct token."""
    def answer(w: Wavelet, key: list, token: int):
        for at in w.occurrences(token):
            shard = [pa.array([x] * len(at), f.type) for x, f in zip(key, _FILE, strict=False)]
            yield pa.RecordBatch.from_arrays([*shard, pa.array([token] * len(at), pa.int64()), pa.array(at, pa.int64())],
                                             names=[*KEY, "token", "at"])

    found = _each_token(spark, path, tokens, "r long, s int, number int, token long, at long", answer)
    return found.join(shard_places(spark, path), KEY).select("token", (F.col("first") + F.col("at")).alias("place"))


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID,
               shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write ``docs(doc_id, text)`` as shard files in the shared folder and read the
    documents back from them."""
    path = scratch_path(docs.sparkSession, "wavelet")
    write_ids(docs, tokenizer_path, path, end_id, shard_tokens)
    return read_documents(docs.sparkSession, path)
