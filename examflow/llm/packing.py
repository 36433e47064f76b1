"""Packing token sequences: minimum bin slack over the lengths of the pieces.

A document's tokens are cut into pieces of ``capacity`` and one shorter rest. Full
pieces fill a sequence each. The rests are packed by minimum bin slack: a window
takes the longest rest left and, by subset-sum dynamic programming on a bitset of
reachable lengths, the multiset of other lengths that fills it closest to capacity;
the counts are backtracked, and the pattern is used as often as the counts allow.
If whole rests need more sequences than their sum does, the windows are run again with
cuts: what the best fill leaves free is taken from the front of another rest (the
longest left), whose remainder goes back into the histogram. Then all sequences but
the last are full. The ids of rests are written with the pieces for that, so that the
parts of a cut rest get their own crc.
The program sees only the histogram of rest lengths (below ``capacity`` rows,
whatever the input); which piece goes where follows from its rank among the pieces
of its length, found without one task per length.

* A null text is an empty one: it has the end id only. Repeated rows are documents
  of their own. Ties (equal lengths) go by doc_id, start, crc. An empty table gives
  no rows. Extra columns are dropped.
* Strings of added tokens (``<|endoftext|>``) are these tokens, as in the library.
* Very long texts are encoded by parts between blanks, never cut elsewhere.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import byte_letters, dense_rank, partitions, python_ready, written

CAPACITY = 1024
END_ID = 0
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
_WITH_IDS = _PIECES.append(pa.field("ids", pa.binary()))
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_loaded: dict[str, tuple] = {}
# A blank after a non-blank opens a new pre-token in byte-level BPE, whatever
# follows, so the parts of a long text between such blanks are encoded by themselves.
_CUT = re.compile(r"\S ")
PART = 1 << 20
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WIDE = re.compile(r"\s{20000}")  # more white space than the splitting pattern can take


def _rank_encoder(tok):
    """The vocabulary of a byte-level BPE tokenizer as ranks, or None if it is not one
    whose merges ascend with their ids (then an id is the rank of its merge)."""
    import json

    import tiktoken

    spec = json.loads(tok.to_str())
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if model["type"] != "BPE" or spec["normalizer"] or any(pre.get(k) != v for k, v in plain.items()):
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    vocab, letters = model["vocab"], byte_letters()
    merged = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
    if None in merged or merged != sorted(merged) or len([x for x in ranks if len(x) == 1]) < 256:
        return None
    return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})._core_bpe


def _load(tokenizer_path: str) -> tuple:
    if tokenizer_path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        added = [t.content for t in tok.get_added_tokens_decoder().values()]
        _loaded[tokenizer_path] = (tok, _rank_encoder(tok), added)
    return _loaded[tokenizer_path]


def token_bytes(texts: list[str | None], tokenizer_path: str) -> list[bytes]:
    """The ids of each text as unsigned 32-bit integers, little-endian (as the machines
    are). The strings of added tokens are those tokens, as in the library."""
    tok, ranks, added = _load(tokenizer_path)

    def ids(text: str) -> list[int]:
        if ranks is None or any(a in text for a in added) or _WIDE.search(text):
            return tok.encode(text, add_special_tokens=False).ids
        return ranks.encode_ordinary(text)

    out = []
    for text in texts:
        done, at = [], 0
        while text and len(text) - at > PART and (cut := _CUT.search(text, at + PART)):
            done.append(array("I", ids(text[at : cut.start() + 1])).tobytes())
            at = cut.start() + 1
        done.append(array("I", ids(text[at:])).tobytes() if text else b"")
        out.append(b"".join(done))
    return out


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, ids: one row per piece; ``ids`` are
    those of a rest, two bytes each if they fit and four if not, and null in a full piece."""
    python_ready(docs.sparkSession)
    end = np.asarray([END_ID], "<u4").tobytes()

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cols: list[list] = [[], [], [], [], [], []]
                ids = part.column(0).to_pylist()
                for doc_id, data in zip(ids, token_bytes(part.column(1).to_pylist(), tokenizer_path), strict=True):
                    data += end
                    n = len(data) // 4
                    view = memoryview(data)
                    for s in range(0, n, capacity):
                        e = min(s + capacity, n)
                        own = view[4 * s : 4 * e]
                        rest = narrow(own) if e - s < capacity else None
                        for c, v in zip(cols, (doc_id, s, e - s, zlib.crc32(own), n, rest), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(cols, _WITH_IDS, strict=True)], schema=_WITH_IDS)

    return docs.select("doc_id", "text").mapInArrow(cut, f"{_DDL}, ids binary")


def narrow(ids: memoryview) -> bytes:
    """32-bit ids as 16-bit ones if all of them fit."""
    a = np.frombuffer(ids, "<u4")
    return a.astype("<u2").tobytes() if a.max() < 1 << 16 else a.tobytes()


def widened(ids: bytes, length: int) -> memoryview:
    """The 32-bit ids that ``narrow`` got."""
    return memoryview(np.frombuffer(ids, "<u2" if len(ids) == 2 * length else "<u4").astype("<u4").tobytes())


def fill(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, longest first, of a multiset within ``counts`` whose sum comes
    closest to ``room`` without passing it: bitset subset sum, backtracked."""
    mask = (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # length, sums reachable before it, its count
    reach = 1
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        if reach >> room & 1:
            break
        most = min(counts[length], room // length)
        steps.append((length, reach, most))
        left, part = most, 1
        while left:  # binary splitting of the count
            part = min(part, left)
            reach |= (reach << (part * length)) & mask
            left -= part
            part *= 2
    target = reach.bit_length() - 1
    chosen = []
    for length, before, most in reversed(steps):
        for used in range(most + 1):
            rest = target - used * length
            if rest >= 0 and before >> rest & 1:
                chosen += [length] * used
                target = rest
                break
    return sorted(chosen, reverse=True)


def bin_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, number of such sequences) until no piece is left."""
    left = {x: c for x, c in counts.items() if c}
    out = []
    while left:
        top = max(left)
        left[top] -= 1
        lengths = [top, *fill(left, capacity - top)]
        left[top] += 1
        need = {x: len(list(g)) for x, g in groupby(lengths)}
        times = min(left[x] // n for x, n in need.items())
        out.append((lengths, times))
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def fewest(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that hold all tokens if pieces may be cut anywhere."""
    return -(-sum(x * c for x, c in counts.items()) // capacity)


def placements(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[np.ndarray]]:
    """For each length its levels of rows (first rank, start, part, first turn, per
    sequence, first sequence, offset), by first rank: what becomes of the pieces from that rank
    on. The part of a piece that begins at ``start`` goes to sequence
    ``first sequence + turn // per sequence``, ``turn`` counted from the first rank. A
    piece has a part in each level until its end; only cut pieces have more than one.
    """
    patterns = bin_patterns(counts, capacity)
    cuts = sum(times for _, times in patterns) > fewest(counts, capacity)
    # length -> runs of pieces that have it left: (piece length, first rank, how many, start, level)
    pool = {x: [(x, 0, c, 0, 0)] for x, c in counts.items() if c}
    left = Counter({x: c for x, c in counts.items() if c})
    plan: dict[int, list[list[tuple]]] = {}
    sequence = 0

    def place(x: int, part: int, number: int, each: int, offset: int) -> None:
        """The first ``part`` ids of ``number`` pieces with ``x`` left."""
        turn = 0
        while turn < number:
            piece, first, n, start, level = pool[x].pop()
            take = min(n, number - turn)
            if take < n:
                pool[x].append((piece, first + take, n - take, start, level))
            levels = plan.setdefault(piece, [])
            if level == len(levels):
                levels.append([])
            levels[level].append((first, start, part, turn, each, sequence, offset))
            if part < x:
                pool.setdefault(x - part, []).append((piece, first, take, start + part, level + 1))
            turn += take
        left[x] -= number
        if not left[x]:
            del left[x]
        if part < x:
            left[x - part] += number

    def windows():
        while left:
            top = max(left)
            left[top] -= 1
            lengths = [top, *fill(left, capacity - top)]
            left[top] += 1
            need = Counter(lengths)
            donor = max((x for x, c in left.items() if c > need[x]), default=0)
            if donor and sum(lengths) < capacity:  # whatever is left is longer than the slack
                need[donor] += 1
                yield lengths, min(left[x] // n for x, n in need.items() if n), donor
            else:
                yield lengths, min(left[x] // n for x, n in need.items() if n), 0

    for lengths, times, donor in windows() if cuts else ((*p, 0) for p in patterns):
        offset = 0
        for x, g in groupby(lengths):
            n = len(list(g))
            place(x, x, n * times, n, offset)
            offset += n * x
        if donor:
            place(donor, capacity - offset, times, 1, offset)
        sequence += times
    return {x: [np.asarray(sorted(rows), np.int64) for rows in levels] for x, levels in plan.items()}


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``docs(doc_id, text)`` -> the pieces, or the parts of cut ones, with sequence_id
    and offset."""
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, tokenizer_path, capacity), "pieces")
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    tables = placements(counts, capacity)
    cut = [x for x, levels in tables.items() if len(levels) > 1]

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            found: list[list[np.ndarray]] = []  # rows, start, part, sequence, offset
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                for t in tables[int(length[rows[0]])]:
                    entry = t[np.searchsorted(t[:, 0], rank[rows], "right") - 1]
                    first, start, part, turn, each, seq, off = entry.T
                    turn = turn + rank[rows] - first
                    found.append([rows, start, part, seq + turn // each, off + turn % each * part])
                    rows = rows[start + part < length[rows]]
                    if not len(rows):
                        break
            at, start, part, seq, off = (np.concatenate(c) for c in zip(*found, strict=True))
            out = batch.select(_PIECES.names).take(pa.array(at))
            crc = out.column("ids_crc32").to_numpy().copy()
            if cut:
                ids = batch.column("ids")
                for k in np.flatnonzero(part < length[at]):
                    own = widened(ids[at[k]].as_py(), int(length[at[k]]))
                    crc[k] = zlib.crc32(own[4 * start[k] : 4 * (start[k] + part[k])])
            yield pa.RecordBatch.from_arrays(
                [out.column("doc_id"), pa.array(out.column("start").to_numpy() + start), pa.array(part),
                 pa.array(crc), out.column("doc_tokens"), pa.array(seq), pa.array(off)],
                names=[*_PIECES.names, "sequence_id", "offset"])

    n = max(partitions(spark), sum(counts.values()) // 65_536)
    carried = pieces.withColumn("ids", F.when(F.col("length").isin(cut), F.col("ids"))) if cut else pieces.drop("ids")
    ranked = dense_rank(carried, ["length"], F.struct("doc_id", "start"),
                        ["doc_id", "start", "ids_crc32"], "rank", n)
    return ranked.mapInArrow(place, f"{_DDL}, sequence_id long, offset long")
