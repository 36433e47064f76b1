"""SentencePiece BPE encoding by a last-token table, and decoding.

Every prefix of a text has one last token: the last token of that prefix's own
encoding. A token that ends at position i (found by an Aho-Corasick automaton) is
that token if it is compatible with the last token of the prefix before it, that
is, if the two strings joined encode to just these two tokens. Going through the
matches from left to right fills the table; the ids are then read off backwards.
Compatibility is tested by plain merging of the two short strings, and remembered.

No piece of the model has a blank mark after another character, so no merge
crosses the start of a word: words are encoded apart and remembered by a worker.

* Null and empty texts have no ids and decode to the empty string. Characters
  without a piece become byte ids. Very long words cost time in proportion.
* Repeated rows give repeated rows; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import python_ready

MARK = "▁"
CACHE = 500_000
PAIRS = 2_000_000
_EDGE = re.compile(f"(?<=[^{MARK}])(?={MARK})")
_models: dict[str, "PieceModel"] = {}


class PieceModel:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes_id: dict[int, int] = {}
        self.out: list[bytes] = []  # what an id decodes to
        self.automaton = ahocorasick.Automaton()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_id[int(piece[3:5], 16)] = i
                self.out.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.out.append(b"")
            elif sp.is_unknown(i):
                self.out.append(" ⁇ ".encode())
            else:
                self.out.append(piece.replace(MARK, " ").encode())
                self.score[piece], self.ids[piece] = sp.get_score(i), i
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.cache: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Plain BPE: merge the best adjacent pair, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        hit = self.fits.get((a, b))
        if hit is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            hit = self.fits[a, b] = self.merged(a + b) == [a, b]
        return hit

    def tokens(self, text: str) -> list[str]:
        last: list[str | None] = [None] * (len(text) + 1)
        whole, fits = self.whole, self.fits
        for end, piece in self.automaton.iter(text):
            end += 1
            start = end - len(piece)
            if start == 0:
                good = whole.get(piece)
                if good is None:
                    good = whole[piece] = self.merged(piece) == [piece]
            else:
                # a position without a token ends in a character without a piece
                before = last[start] or text[start - 1]
                good = fits.get((before, piece))
                if good is None:
                    good = self.compatible(before, piece)
            if good:
                last[end] = piece
        out, end = [], len(text)
        while end:
            out.append(last[end] or text[end - 1])
            end -= len(out[-1])
        return out[::-1]

    def word(self, text: str) -> bytes:
        """The ids of ``text`` (marks in place) as unsigned 32-bit integers."""
        ids = []
        for t in self.tokens(text):
            if t in self.ids:
                ids.append(self.ids[t])
            else:
                ids += [self.bytes_id[b] for b in t.encode("utf-8")]
        return np.asarray(ids, np.uint32).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.apart and MARK not in text and "  " not in text and text[0] != " " != text[-1]:
            words = text.split(" ")
        else:
            marked = MARK + text.replace(" ", MARK)
            words = [w[1:] for w in _EDGE.split(marked)] if self.apart else [marked[1:]]
        cache, out = self.cache, []
        for w in words:
            b = cache.get(w)
            if b is None:
                b = self.word(MARK + w)
                if len(w) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[w] = b
            out.append(b)
        return np.frombuffer(b"".join(out), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text; the mark put before the first word goes again."""
        data = b"".join(map(self.out.__getitem__, ids.tolist()))
        data = data[1:] if data[:1] == b" " else data
        return data.decode("utf-8", "replace").encode("utf-8")


def load(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, model_path: str, ids: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_tokens, ids_sha256, decoded_sha256, and
    with ``ids`` also ids (array<int>) and decoded (string)."""
    python_ready(docs.sparkSession)

    def run(batches):
        model = load(model_path)
        names = [str(i) for i in range(len(model.out))]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cols: list[list] = [[] for _ in range(5 if ids else 3)]
                for text in part.column(1).to_pylist():
                    code = model.encode(text)
                    back = model.decode(code)
                    line = ",".join(map(names.__getitem__, code.tolist()))
                    row = [len(code), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(back).hexdigest()]
                    for c, v in zip(cols, row + [code.tolist(), back.decode()] if ids else row, strict=True):
                        c.append(v)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 1 + len(cols)])

    extra = ", ids array<int>, decoded string" if ids else ""
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + extra)
