"""Each operator against brute force on a small table of awkward rows: nulls, empty
and long texts, ties, repeated rows, extra columns with clashing names, no rows."""

import base64
import collections
import hashlib
import re
import sys
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from examflow.llm import (
    iblt, maxscore, minhash, packing, piece_bpe, sharding, substring_dedup, toxicity, url_filter, warc)
from examflow.llm.queries import public_tokenizer

PASSAGE = " ".join(f"word{i}" for i in range(30))
LONG = " ".join(f"tok{i % 997}" for i in range(6000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog.\nA second line here."), (2, None), (3, ""), (4, " \n\t "),
    (5, "one two"), (6, "One TWO"), (7, LONG), (8, "x " + PASSAGE + " y"), (9, "other start " + PASSAGE),
    (10, PASSAGE), (11, PASSAGE), (12, LONG + " more"), (13, "é 日本語 🎉 ▁a\x00b  c   d \r\n e"),
    (14, "a b " * 40), (15, "nospace" * 300), (None, "no id here at all"), (None, None), (1, "The quick brown fox jumps over the lazy dog.\nA second line here."),
]
SCHEMA = "doc_id long, text string, sha string, id long, n string, length int, rep int, shard int, sequence_id int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", 1, "n", 2, 3, 4, 5) for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def paragraphs(text):
    """Lines, cut after sentence ends and after words whose hash has six zero bits."""
    def ends(w):
        return xxhash.xxh64_intdigest(b"end", xxhash.xxh64_intdigest(w.encode(), 42)) % 64 == 0

    marked = " ".join(w + "\n" if ends(w) else w for w in (text or "").split(" "))
    return set(re.split(r"\n ?|(?<=[.!?]) ", marked)) - {""}


def test_fingerprints(docs, none):
    rows = iblt.fingerprints(docs).collect()
    assert len(rows) == len(TEXTS) and iblt.fingerprints(none).collect() == []
    order = sorted(TEXTS, key=lambda x: (-(2**63) if x[0] is None else x[0], x[1] or ""))
    expect = collections.Counter()
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        near = [len(a & b) / len(a | b) if a | b else 1.0 for a, b in
                ((paragraphs(t), paragraphs(edited)), (paragraphs(t), paragraphs(nxt)))]
        expect[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *(round(x, 9) for x in near)] += 1
    got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)
    assert got == expect


def test_line_cuts_do_not_depend_on_length(spark):
    """A line that an edit makes shorter or longer keeps the digests of its sentences."""
    parts = [f"Sentence {i} of one line stands here." for i in range(120)]
    rows = [(n, " ".join(parts[:n])) for n in (2, 10, 53, 54, 55, 56, 120)]  # 2,000 code points lie at 54
    got = {r.n: set(r.d) for r in spark.createDataFrame(rows, "n int, text string").select(
        "n", iblt.digests(F.col("text")).alias("d")).collect()}
    assert all(len(d) == len(paragraphs(t)) and d <= got[120] for (n, t), d in zip(rows, (got[n] for n, _ in rows)))
    near = {r.doc_id: r.near_next for r in iblt.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sizes = {n: len(paragraphs(t)) for n, t in rows}
    assert near[53] == pytest.approx(sizes[53] / sizes[54]) and near[56] == pytest.approx(sizes[56] / sizes[120])


def test_runs_without_sentence_ends_are_cut(spark):
    """A line of 60,000 words is nearly that line with one word more, anywhere."""
    line = [f"w{i * i % 40009}" for i in range(60_000)]
    more = line[:30_000] + ["another"] + line[30_000:]
    rows = spark.createDataFrame([(1, " ".join(line)), (2, " ".join(more)), (3, "end")], "doc_id long, text string")
    got = {r.doc_id: r for r in iblt.fingerprints(rows).collect()}
    assert 0.99 < got[1].near_next < 1 and got[1].near_edited > 0.3 and got[2].near_next == 0


def test_peeling_many_differences(spark):
    """Differences beyond the small sketches are recovered by the larger ones."""
    a, b = list(range(700)), list(range(300, 900))
    df = spark.createDataFrame([(a, b), (a, a), ([], b), ([], [])], "a array<long>, b array<long>")
    small = iblt.subtract(iblt.sketch(F.col("a"), 4), iblt.sketch(F.col("b"), 4))
    got = [r[0] for r in df.select(iblt.differing(F.col("a"), F.col("b"), small)).collect()]
    assert got == [500, 0, 600, 0]


def test_url_rules(spark):
    urls = [(1, "http://WWW.Example.com/en/x?q#f"), (2, "https://a.example.com/en/"), (3, "http://xexample.com/en/"),
            (4, "http://example.com"), (5, None), (6, "no scheme"), (7, "ftp://b.net/es/1"), (7, "ftp://b.net/es/1"),
            (8, "http://net/fr/"), (9, "http://a..com/"), (10, "x://y://z.net/fr/")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in urls], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
                                   ("net", "/es/", "block"), ("net", "/fr/", "block")], "host string, path string, action string")
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect())
    expect = collections.Counter([
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "a.example.com", "/en/", "example.com/en/", "block"),
        (3, "xexample.com", "/en/", "com/", "allow"), (4, "example.com", "", None, "allow"), (5, "", "", None, "allow"),
        (6, "", "", None, "allow"), (7, "b.net", "/es/1", "net/es/", "block"), (7, "b.net", "/es/1", "net/es/", "block"),
        (8, "net", "/fr/", "net/fr/", "block"), (9, "a..com", "/", "com/", "allow"), (10, "y:", "//z.net/fr/", None, "allow")])
    assert got == expect
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_near_duplicates(docs, none):
    rows = minhash.near_duplicates(docs, 100, 80).collect()
    sets = {i: shingles(t) for i, t in TEXTS if i is not None}
    own = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            u = len(sets[a] | sets[b])
            if a < b and u and 100 * len(sets[a] & sets[b]) >= 80 * u:
                low, high = sorted((own[a], own[b]))
                own = {k: low if v == high else v for k, v in own.items()}
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), own[r.doc_id], own[r.doc_id] == r.doc_id)
    assert len(rows) == len(TEXTS) and minhash.near_duplicates(none).count() == 0
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i in own if own[i] == i)


def test_components_of_long_chains(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    links = links.unionByName(spark.createDataFrame([(100, 101), (101, 100), (7, 7)], "a long, b long"))
    got = {r.node: r.component for r in minhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_packing(docs, none):
    path = public_tokenizer("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path).collect()
    expect, got = collections.Counter(), collections.Counter()
    for i, t in TEXTS:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for s in range(0, len(ids), 1024):
            part = ids[s : s + 1024]
            expect[i, s, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()), len(ids)] += 1
    for r in rows:
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    assert got == expect
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(none, path).count() == 0


def test_bin_slack_fills_to_capacity():
    rng = np.random.default_rng(3)
    counts = collections.Counter(rng.integers(1, 1024, 5000).tolist())
    patterns = packing.bin_patterns(dict(counts))
    used = collections.Counter()
    for lengths, times in patterns:
        assert sum(lengths) <= 1024
        for x in lengths:
            used[x] += times
    assert used == counts
    total = sum(x * n for x, n in counts.items())
    assert sum(n for _, n in patterns) <= -(-total // 1024) * 1.01 + 1
    for _ in range(200):  # the fill is the best there is
        c = {int(x): int(n) for x, n in zip(rng.integers(1, 12, 4), rng.integers(1, 4, 4))}
        sums = {0}
        for x, n in c.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        assert sum(packing.fill(c, 20)) == max(s for s in sums if s <= 20)


def test_packing_cuts_rests_of_a_hot_length(spark):
    """Rests over half a sequence, many of one length, leave no slack but at the end."""
    from tokenizers import Tokenizer

    path = public_tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    sizes = [600] * 60 + [520] * 30 + [700] * 20 + [1, 2, 3, 900, 1500, 2500, 3000]
    texts = [(i // 2, f"n{i}" + "".join(f" w{(i + k) % 90}" for k in range(n // 2))) for i, n in enumerate(sizes)]
    hot = "hot" + " the" * 598
    texts += [(None, hot), (None, hot), *((1000 + i, hot) for i in range(60))]
    rows = packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), path).collect()
    ids = [(i, tok.encode(t, add_special_tokens=False).ids + [0]) for i, t in texts]
    total = sum(len(x) for _, x in ids)
    by, parts = collections.defaultdict(list), collections.defaultdict(collections.Counter)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id][r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    assert sorted(by) == list(range(-(-total // 1024)))
    full = 0
    for p in by.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at and length > 0
            at += length
        full += at == 1024
        assert at <= 1024
    assert full >= len(by) - 1
    assert any(r.start % 1024 for r in rows)
    # the parts of each id's documents: each token once, with the right crc
    for i, left in parts.items():
        own = [x for j, x in ids if j == i]
        assert collections.Counter(at for (s, n, _, _), c in left.items() for at in range(s, s + n) for _ in range(c)) == \
            collections.Counter(at for x in own for at in range(len(x)))
        for (s, n, crc, all_n), _ in left.items():
            assert crc in [zlib.crc32(np.asarray(x[s : s + n], "<u4").tobytes()) for x in own if len(x) == all_n]


def test_placements_need_the_fewest_sequences():
    rng = np.random.default_rng(4)
    for _ in range(20):
        counts = collections.Counter(rng.choice([520, 600, 700, 513, 1024, int(rng.integers(1, 1024))], 400).tolist())
        held = collections.Counter()
        for x, levels in packing.placements(dict(counts)).items():
            for rank in range(counts[x]):
                at = 0
                for t in levels:
                    first, start, part, turn, each, seq, off = t[np.searchsorted(t[:, 0], rank, "right") - 1].tolist()
                    assert start == at
                    turn += rank - first
                    begin = off + turn % each * part
                    held.update((seq + turn // each, k) for k in range(begin, begin + part))
                    at += part
                    if at == x:
                        break
                assert at == x
        total = sum(x * c for x, c in counts.items())
        assert len(held) == total and set(held.values()) == {1}
        assert {s for s, _ in held} == set(range(-(-total // 1024))) and max(k for _, k in held) < 1024


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = toxicity.train(docs, labels.filter(~held))
    rows = toxicity.score(docs.join(labels.filter(held), "doc_id", "left_semi"), model).withColumnRenamed(
        "toxic", "said").join(labels, "doc_id").select("said", "toxic").collect()
    toxic, clean = [r.said for r in rows if r.toxic], [r.said for r in rows if not r.toxic]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02


def test_toxicity_awkward_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (99, 0), (5, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == len(TEXTS)
    assert toxicity.score(none, model).count() == 0
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r.severity for r in toxicity.score(docs, nothing).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, nothing).columns == docs.columns


def test_ordinal_thresholds_share_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    grades = np.digitize(2 * x + rng.logistic(size=3000), [0.0, 2.0])
    w, t = toxicity.fit_ordinal(np.arange(3000), np.zeros(3000, np.int64), x, grades, 1)
    assert abs(w[0] - 2) < 0.3 and abs(t[0]) < 0.25 and abs(t[1] - 2) < 0.3


def brute_spans(texts, width=20):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: 2**63 if x[0] is None else x[0]):
        w = words(t)
        gone, own = [False] * len(w), set()
        for a in range(len(w) - width + 1):
            key = tuple(w[a : a + width])
            if key in seen or key in own:
                gone[a : a + width] = [True] * width
            own.add(key)
        seen |= own
        out[i, t] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def test_substring_dedup(docs, none):
    expect = brute_spans(dict.fromkeys(TEXTS))
    want = collections.Counter((i, *expect[i, t]) for i, t in TEXTS)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_words(docs).collect())
    assert got == want
    assert substring_dedup.dedup_words(none).count() == 0
    cut = substring_dedup.dedup_texts(docs)
    assert cut.columns == docs.columns
    for r in cut.collect():
        t = dict(TEXTS).get(r.doc_id) if r.doc_id is not None else r.text
        assert hashlib.sha256(b" ".join(words(r.text))).hexdigest() == expect.get((r.doc_id, t), (0, 0, ""))[2]


def test_automaton_matches_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        text = rng.integers(0, 3, 60).tolist()
        ref = [rng.integers(0, 3, 25).tolist() for _ in range(3)]
        auto, first, at = substring_dedup.SuffixAutomaton(), {}, 0
        for part in ref:
            auto.add(part, at)
            for a in range(len(part) - 3):
                first.setdefault(tuple(part[a : a + 4]), at + a)
            at += 100
        expect = [(i, first[tuple(text[i - 3 : i + 1])]) for i in range(3, 60) if tuple(text[i - 3 : i + 1]) in first]
        assert list(auto.earliest(text, 4)) == expect


def test_warc_round_trip(spark, scratch):
    big = "line é\r\nWARC/1.1\r\n\r\nx" * 20_000
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""),
            (5, "u", big), (6, "u", "\r\n\r\nWARC/1.0\r\n\n"), (7, "u", big), (7, "u", big),
            # the first row twice, without another, with one, and rows without an id
            (8, "u", "two"), (8, "v", "two"), (1, "http://a", "<p>x</p>"), (None, "u", "no id"), (None, "v", "no id"),
            (None, None, "two")]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, sha string")
    for least in (0, 100):
        path = scratch("warc")
        warc.write_warc(pages, path, least, segment_bytes=4096)
        chunks = warc.read_warc(spark, path, chunk_bytes=1000)
        assert chunks.agg(F.max("chunk_bytes")).first()[0] < 4200
        first, seen = {}, set()
        for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            first.setdefault((h or "").encode(), i)
        expect = collections.Counter()
        for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            b = (h or "").encode()
            again = len(b) >= least and b in seen
            seen.add(b)
            expect[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[b] if again else None] += 1
        assert collections.Counter(tuple(r) for r in warc.page_records(chunks).collect()) == expect
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs, shards=4).collect()
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 1 for _, t in TEXTS)
    shard_of = collections.defaultdict(set)
    slots = collections.defaultdict(list)
    for r in rows:
        shard_of[r.group_key].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(none).count() == 0
    loads = collections.Counter()
    for (_, load), s in zip(items := [(str(i), 1 + i % 7) for i in range(100)], [sharding.longest_first(items, 8)[n] for n, _ in items]):
        loads[s] += load
    assert max(loads.values()) - min(loads.values()) <= 1


def test_maxscore(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)]
    rows += [(400, None), (401, [None] * 16), (402, [float("nan")] * 16), (403, [float("inf")] * 16), (404, []),
             (405, [1.0, 2.0]), (None, [1.0] * 16), (420, [0.0] * 16), (440, rows[0][1]), (460, [1e30] * 16)]
    edge = sys.float_info.max
    ends = spark.createDataFrame([(20, [edge, -edge]), (21, [edge / 2, -1e307]), (22, [-edge, 1.0]), (23, [0.0, 0.0])],
                                 "vec_id long, embedding array<double>")
    got = maxscore.top_k(ends, F.col("vec_id") % 20 == 0, k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(21, 2**63 - 1), (23, 0), (22, -(2**63))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    good = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    got = collections.defaultdict(list)
    for r in maxscore.top_k(df, F.col("vec_id") % 20 == 0, k=7).orderBy("rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    top = 2**63 - 1
    for q in (i for i in good if i % 20 == 0):
        scored = [(min(max(sum(a * b for a, b in zip(good[q], v)), -top - 1), top), i) for i, v in good.items() if i != q]
        exact = sorted(((sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q), key=lambda x: (-x[0], x[1]))[:7]
        if q != 460:
            assert [s for _, s in got[q]] == [min(max(s, -top - 1), top) for s, _ in exact]
        assert len(got[q]) == min(7, len(scored))
    assert maxscore.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_piece_bpe(docs, none):
    import sentencepiece

    path = public_tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = collections.Counter()
    for i, t in TEXTS:
        ids = sp.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in piece_bpe.encode_documents(docs, path).collect()) == want
    assert piece_bpe.encode_documents(none, path, ids=True).count() == 0
    model, rng = piece_bpe.load(path), np.random.default_rng(9)
    letters = list(" \t\n▁aabeethou  é日本語🎉0123<s>.,\x00")
    for _ in range(2000):
        s = "".join(rng.choice(letters, rng.integers(0, 40)))
        assert model.encode(s).tolist() == sp.encode(s)
        assert model.decode(model.encode(s)).decode() == sp.decode(sp.encode(s))


@pytest.mark.parametrize("factor", [1, 10**15])
def test_maxscore_of_a_block_of_queries(monkeypatch, factor):
    """One call answers many queries: parts of a shard, probes in slices, ties, own ids."""
    monkeypatch.setattr(maxscore, "PAIRS", 37)
    rng = np.random.default_rng(4)
    vectors = np.floor(rng.normal(size=(300, 12)) * 20)
    vectors[rng.random((300, 12)) < 0.3] = 0
    vectors[200:] = vectors[:100]
    ids = rng.integers(0, 250, 300)
    pick = rng.choice(300, 40)
    if factor > 1:
        vectors = np.vectorize(lambda x: int(x) * factor, otypes=[object])(vectors)
    queries = vectors[pick].copy()
    queries[0] = 0
    rows, got, score = maxscore.top_of_shard(ids, vectors, ids[pick], queries, 7, 3, 16)
    expect = []
    for row, q in enumerate(queries):
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(q, v)), int(i)) for i, v in zip(ids, vectors) if i != ids[pick][row])
        expect += [(row, i, -s) for s, i in scored[:7]]
    assert [(int(r), int(i), int(s)) for r, i, s in zip(rows, got, score)] == expect


def test_maxscore_copies_queries_not_candidates(spark):
    """A block holds as many queries as a shard has candidates, so candidates are dealt once
    until the queries alone fill a shard; huge rows are answered beside the others."""
    assert maxscore.QUERY_BLOCK >= maxscore.SHARD
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 8)]) for i in range(1500)]
    rows[40] = (40, [1e20] * 8)
    rows[41] = (41, [-1e20, 1.0, 1.0])
    got = collections.defaultdict(list)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in maxscore.top_k(df, F.col("vec_id") % 20 == 0, k=3, scale=1.0).orderBy("rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = {i: [int(x) for x in v] + [0] * (8 - len(v)) for i, v in rows}
    top = 2**63 - 1
    assert len(got) == 75
    for q in got:
        scored = sorted((-min(max(sum(a * b for a, b in zip(whole[q], v)), -top - 1), top), i) for i, v in whole.items() if i != q)
        if q != 40:
            assert got[q] == [(i, -s) for s, i in scored[:3]]
        else:
            assert [s for _, s in got[q]] == [-s for s, _ in scored[:3]]
