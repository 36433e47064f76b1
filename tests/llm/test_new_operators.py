"""Spelling variants, wavelet files and hard negatives against brute force on awkward
rows: nulls, empty and long texts, ties, repeated rows, clashing names, no rows. Also
special tokens and rows that share a doc_id in the earlier operators."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from examflow.llm import hard_negatives, minhash, packing, spelling, wavelet
from examflow.llm.queries import public_tokenizer
from examflow.session import scratch_path

WORD_FILE, BYTE_FILE = "word_bpe_49k.json", "byte_bpe_50k.json"
BASE = ["planet", "planets", "plane", "planeta", "planer", "plänet", "mirror", "mirrors", "error", "errors", "errorss",
        "aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "babababa", "zürich", "zurich", "ünique", "unique", "uniqué",
        "x" * 300, "x" * 150 + "y" + "x" * 149, "x" * 301, "y" + "x" * 299, "x" * 299 + "y"]


def texts_of_words():
    rng = np.random.default_rng(8)
    rows, weight = [], rng.permutation(np.arange(1, len(BASE) + 1)) ** 3.0
    for k in range(60):
        words = rng.choice(BASE, 60, p=weight / weight.sum())
        rows.append((k // 2 if k < 50 else None, " ".join(w.title() if rng.random() < 0.2 else w for w in words)))
    rows += [(900, None), (901, ""), (902, "Ünique ÜNIQUE 12 a-b ×× ÷ " * 7), (903, "tiny tiny " * 9), (903, "tiny tiny " * 9)]
    rows.append((905, " ".join(["planetes"] * 5 + ["planetss"] * 4)))
    return rows


def test_spelling_variants(spark):
    rows = texts_of_words()
    df = spark.createDataFrame([(i, t, "w", 1, "f") for i, t in rows], "doc_id long, text string, word string, n int, form string")
    for every in (199, 3):
        count = collections.Counter()
        for i, t in rows:
            for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
                h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
                count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % every == 0 else w] += 1
        n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}

        def near(a, b):
            if abs(len(a) - len(b)) > 1 or a == b:
                return False
            if len(a) == len(b):
                return sum(x != y for x, y in zip(a, b)) == 1
            a, b = sorted((a, b), key=len)
            return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

        around = {w: [v for v in n if near(w, v)] for w in n}
        form = {}
        for w, vs in around.items():
            best = min(vs, key=lambda v: (-n[v], v), default=None)
            form[w] = best if best and n[best] >= 5 * n[w] else None

        def root(w):
            while form[w]:
                w = form[w]
            return w

        expect = {(w, form[w], root(w), n[w], len(around[w]), form[w] and n[form[w]]) for w in n}
        got = spelling.variants(df, drop_every=every).select("word", "form", "root", "n", "n_near", "form_n").collect()
        assert {tuple(r) for r in got} == expect and len(got) == len(expect)
        assert any(f for f in form.values())
    assert spelling.variants(df.limit(0)).count() == 0


def test_near_words_of_random_tries(spark):
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(2, 9))) for _ in range(700)})
    got = spelling.near_words(spark.createDataFrame([(w, k + 1) for k, w in enumerate(words)], "word string, n long")).collect()
    place = {w: k + 1 for k, w in enumerate(words)}
    known = set(words)
    expect = set()
    for w in words:
        edits = {w[:k] + w[k + 1 :] for k in range(len(w))}
        edits |= {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in "abc"}
        edits |= {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in "abc"}
        expect |= {(w, place[w], v, place[v]) for v in edits & known - {w}}
    pairs = [(r.word, r.n, r.near, r.near_n) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == expect


def test_roots_of_chains(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(13)] + [("a", "w5"), ("b", "c")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {**{f"w{k}": "w13" for k in range(13)}, "a": "w13", "b": "c"}


LONG = " ".join(f"Word{k % 997}, naïve" for k in range(3000))
DOCS = [(5, "The quick brown fox.\nIt's DON'T ends…"), (2, None), (3, ""), (4, " \n\t\x1c  "), (7, LONG), (6, "a<|endoftext|>b <|STARTOFTEXT|>"),
        (None, "no id"), (None, None), (5, "The quick brown fox.\nIt's DON'T ends…"), (1, "日本語 é 🎉 Σς İ ﬁ"), (-8, "x" * 5000), (9, LONG + " more")]


@pytest.mark.parametrize("shard_tokens, range_rows", [(1 << 22, 8192), (700, 2), (1, 3)])
def test_wavelet_files(spark, shard_tokens, range_rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizer(WORD_FILE))
    rows = DOCS if shard_tokens > 1 else [r for r in DOCS if len(r[1] or "") < 100]
    df = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], "doc_id long, text string, start int, shard string, n int").repartition(3)
    files = scratch_path(spark, "t-rows")
    df.write.parquet(files)
    df = spark.read.parquet(files)
    path = scratch_path(spark, "t-shards")
    wavelet.write_ids(df, public_tokenizer(WORD_FILE), path, shard_tokens=shard_tokens, range_rows=range_rows)
    got = wavelet.read_documents(spark, path).orderBy("start").collect()
    ids = {t: tok.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows}
    crc = lambda x: zlib.crc32(np.asarray(x, "<u4").tobytes())
    # ascending ids, null first; equal ids in any order, one after another
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter(
        (i, len(ids[t]), crc(ids[t])) for i, t in rows)
    at, whole = 0, []
    for r in got:
        assert r.start == at
        at += r.n_tokens
        whole += next(ids[t] for i, t in rows if (i, len(ids[t]), crc(ids[t])) == (r.doc_id, r.n_tokens, r.ids_crc32))
    assert max(r.tokens for r in wavelet.read_shards(spark, path).collect()) <= shard_tokens
    asked = spark.createDataFrame([(k,) for k in (0, 1, at - 1, at // 2, at, at + 7, -1, 0, None)], "place long")
    assert {r.place: r.token for r in wavelet.token_at(spark, path, asked).collect()} == {
        k: whole[k] for k in (0, 1, at - 1, at // 2)}
    tokens = spark.createDataFrame([(2,), (2,), (whole[0],), (49_000,), (10**9,), (-1,), (None,)], "token long")
    counts = collections.Counter(whole)
    assert {r.token: r.n for r in wavelet.count_tokens(spark, path, tokens).collect()} == {
        k: counts[k] for k in (2, whole[0], 49_000)}
    found = collections.defaultdict(list)
    for r in wavelet.occurrences(spark, path, tokens).collect():
        found[r.token].append(r.place)
    assert {k: sorted(v) for k, v in found.items()} == {
        k: [p for p, x in enumerate(whole) if x == k] for k in {2, whole[0]}}


def test_wavelet_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert wavelet.round_trip(none, public_tokenizer(WORD_FILE)).count() == 0


def test_wavelet_hot_id_and_only_null_ids(spark):
    """A third of the rows has one id; a table without any id."""
    rows = [(7 if k % 3 == 0 else k, f"text {k} {'y ' * (k % 5)}") for k in range(400)]
    for table in (rows, [(None, t) for _, t in rows]):
        files = scratch_path(spark, "t-rows")
        spark.createDataFrame(table, "doc_id long, text string").repartition(4).write.parquet(files)
        path = scratch_path(spark, "t-shards")
        wavelet.write_ids(spark.read.parquet(files), public_tokenizer(WORD_FILE), path, shard_tokens=50, range_rows=20)
        got = wavelet.read_documents(spark, path).orderBy("start").collect()
        assert [r.doc_id for r in got] == sorted((i for i, _ in table), key=lambda i: (i is not None, i))
        assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_word_encoding_equals_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizer(WORD_FILE))
    rng = np.random.default_rng(6)
    parts = [*"aAbzZ eé'’sStT.,!?0123<|>\x1c\x1f\x85\xa0ßΣσİÀÖ×ØÞ÷ÿ\t\n\r\x00", "<|endoftext|>", "'ll", "don't", " the ", "́", "日本", "***", "naïve"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 15))) for _ in range(4000)]
    texts += [w[:-4] for w in tok.get_vocab() if w.endswith("</w>") and w[:-4].isascii() and w[:-4].isalpha()]
    got = wavelet.encode_texts(texts, public_tokenizer(WORD_FILE))
    expect = [e.ids + [2] for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == expect


@pytest.mark.parametrize("limit", [10**6, 50])
def test_columns_of_words_equal_the_library(monkeypatch, limit):
    """Whole columns at once: nulls, slices, runs known from an earlier call, a full cache,
    capitals whose lower case is a plain letter, white space of several bytes."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(wavelet, "CACHE", limit)
    tok = Tokenizer.from_file(public_tokenizer(WORD_FILE))
    rng = np.random.default_rng(7)
    words = ["The", "the", "THE***", "İstanbul", "K", "Å", "ÀÉÞ×Þ", "÷", "Ÿ", "été,", "isn't", "'", "<|ENDOFTEXT|>", "a\xa0b",
             "c\u3000d", "\x1c", "9th", "日本", "word" * 40, "***", "x.y", "Straße!", "ẞ", "Ã", "\x85", "é"]
    texts = [None, "", " ", "\n\n", *(rng.choice([" ", "\t", "\r\n", "  "]).join(rng.choice(words, rng.integers(0, 9)))
                                    for _ in range(600)), None]
    expect = [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    column = pa.array([*texts, "the end"], pa.string())
    for at in range(0, len(texts), 70):
        part = column.slice(at, min(70, len(texts) - at))
        got = wavelet.encode_column(part, public_tokenizer(WORD_FILE)).to_pylist()
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == expect[at : at + 70]
    assert wavelet.encode_texts([], public_tokenizer(WORD_FILE)) == []


def vectors_with_odd_rows(n=400, width=6):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, width))
    rows = [(k, (centres[k % 8] + rng.normal(size=width) * 0.1).tolist() if k % 3 else rng.normal(size=width).tolist(), k % 4)
            for k in range(n)]
    rows += [(n + 1, None, 1), (n + 2, [1.0, None], 1), (n + 3, [float("nan")] * width, 1), (n + 4, [float("inf")], 2),
             (None, [1.0] * width, 1), (n + 5, [0.5], 3), (n + 6, [], 0), (n + 7, [1.0] * width, None),
             (100, rows[100][1], rows[100][2]), (100, rows[7][1], rows[7][2]), (n + 8, rows[3][1], rows[3][2])]
    return rows


def brute_negatives(rows, scale=256):
    seen = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        seen[i, y, tuple(v)] = [int(np.floor(x * scale)) if abs(x) < 2**52 else int(x) * scale for x in v]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = collections.Counter()
    for (i, y, _), a in seen.items():
        if i % 100:
            continue
        scored = sorted(((-dot(a, b), j, z) for (j, z, _), b in seen.items() if j != i))
        for s, p, _ in [x for x in scored if x[2] == y][:5]:
            fit = [(-t, q) for t, q, z in scored if z != y and 80 * -s <= 100 * -t <= 100 * -s][:5]
            for k, (t, q) in enumerate(fit, 1):
                out[i, p, k, q, -s, t] += 1
    return out


@pytest.mark.parametrize("block, range_rows", [(256, 8192), (8, 32), (1, 5)])
def test_hard_negatives(spark, block, range_rows):
    rows = vectors_with_odd_rows()
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "vec_id long, embedding array<double>, label int, rank int, block string")
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, block=block, range_rows=range_rows)
    found = collections.Counter(tuple(r) for r in got.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert found == brute_negatives(rows) and found


def test_hard_negatives_without_rows_and_at_the_ends(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert hard_negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    huge = [(0, [1e200, 1.0], 0), (1, [1.7e308, 2.0], 0), (2, [1.7e308, 1.0], 1), (3, [-1e9, 0.1], 1), (4, [2.0**40, 3.0], 0),
            (100, [2.0**30, 5.0], 1), (5, [2.0**31, 7.0], 1), (6, [2.0**30 + 1, 7.0], 0)]
    got = hard_negatives.mine(spark.createDataFrame(huge, schema), F.col("vec_id") % 100 == 0).collect()
    top = 2**63 - 1
    assert all(-top - 1 <= r.negative_score <= r.positive_score <= top for r in got)
    small = [r for r in huge if r[0] >= 4]  # scores within 64 bits
    got = collections.Counter(tuple(r) for r in hard_negatives.mine(spark.createDataFrame(small[1:], schema), F.col("vec_id") % 100 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute_negatives(small[1:])


def test_hilbert_curve_visits_neighbours():
    for d, bits in ((2, 4), (3, 3), (6, 1), (5, 2)):
        axes = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        index = hard_negatives.hilbert_index(axes, bits)
        assert sorted(index.tolist()) == list(range(1 << bits * d))
        walk = axes[np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_zone_bounds_hold():
    rng = np.random.default_rng(2)
    boxes = [rng.normal(size=(30, 9)) for _ in range(20)]
    anchors = rng.normal(size=(15, 9))
    least, most = hard_negatives.bounds(anchors, np.stack([b.min(0) for b in boxes]), np.stack([b.max(0) for b in boxes]))
    for i, b in enumerate(boxes):
        scores = anchors @ b.T
        assert (least[:, i] <= scores.min(1) + 1e-9).all() and (scores.max(1) <= most[:, i] + 1e-9).all()


def test_packing_takes_special_tokens_as_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizer(BYTE_FILE)
    tok = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x" * 100_000, " " * 60_000 + "y", "\n" * 50_000, None, "ok  done", "é " * 2000]
    got = packing.token_bytes(texts, path)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    rows = packing.pack_documents(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"), path).collect()
    assert rows[0].ids_crc32 == zlib.crc32(np.asarray([64, 220, 50256, 275, 0], "<u4").tobytes())
    long = "word and " * 200_000  # cut into parts
    assert packing.token_bytes([long], path)[0] == np.asarray(tok.encode(long, add_special_tokens=False).ids, "<u4").tobytes()


A, B = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")


def test_rows_of_one_id_are_linked(spark):
    rows = [(3, A), (5, A), (5, B), (7, B), (8, "other words here"), (8, None), (None, A)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = collections.Counter((r.doc_id, r.component_id, r.kept) for r in got)
    assert found == collections.Counter([(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (8, 8, True), (8, 8, True), (None, None, True)])


def test_keep_one_judges_rows(spark):
    schema = "doc_id long, text string, kept boolean, _gone int"
    keep = lambda rows: collections.Counter(tuple(r) for r in minhash.keep_one(
        spark.createDataFrame(rows, schema).coalesce(1)).collect())
    rows = [(1, A, True, 1), (1, B, True, 1), (2, None, False, 2), (2, "another text", None, 3)]
    assert keep(rows) == collections.Counter(rows)
    near = B + " tail"
    rows = [(4, A, True, 1), (4, A, True, 1), (6, near, True, 2), (5, B, True, 3), (None, A, True, 4), (7, "", True, 5)]
    got = keep(rows)
    assert sum(got.values()) == 4 and got[rows[0]] == 1 and got[rows[4]] == 1 and got[rows[5]] == 1
    rows = [(4, A, True, 1), (3, A, True, 2), (5, near, True, 2), (6, B, True, 3)]
    assert keep(rows) == collections.Counter([rows[1], rows[2]])
