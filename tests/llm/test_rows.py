"""Row by row: severities, shards and the pipeline's stages against plain Python."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from examflow.llm import sharding, toxicity, warc
from examflow.llm.frames import written
from examflow.llm.queries import public_tokenizer
from examflow.llm.words import blocks

TEXTS = [
    (1, "Red red green"), (2, None), (3, ""), (4, "greenish GREEN greens red"), (5, "nothing here"),
    (5, "Red red green"), (None, "red"), (7, "red\tgreenery\x0bblue " * 400), (8, "é red 日本語 🎉"), (None, None),
]
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 9.0, True) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, severity double, toxic boolean").repartition(3)


def features(word):
    """All feature hashes of one word."""
    return [int(h) for _, data, starts, ends, hashes, _ in blocks([word], lower=True)
            for _, hs in toxicity.word_features(data, starts, ends, hashes) for h in hs]


def test_severity_of_each_row(docs):
    named = features(b"red") + features(b"greens") + features(b"blue")
    chosen = np.sort(np.asarray(sorted(set(named)), np.uint64))
    weights = np.linspace(0.1, 1.3, len(chosen))
    model = toxicity.SeverityModel(chosen, weights, np.asarray([0.7, 1.9]))
    weight = dict(zip(map(int, chosen), weights, strict=True))

    def severity(text):
        counts = collections.Counter(f for w in WORD.findall((text or "").encode()) for f in features(w) if f in weight)
        z = sum(weight[f] * math.log1p(n) for f, n in counts.items())
        return sum(1 / (1 + math.exp(t - z)) for t in (0.7, 1.9))

    want = collections.Counter((i, round(severity(t), 9), severity(t) >= toxicity.REJECT) for i, t in TEXTS)
    got = collections.Counter((r.doc_id, round(r.severity, 9), r.toxic) for r in toxicity.score(docs, model).collect())
    assert got == want and len({k[2] for k in want}) == 2
    kept = collections.Counter((r.doc_id, r.text) for r in toxicity.drop_toxic(docs, model).collect())
    assert kept == collections.Counter((i, t) for i, t in TEXTS if severity(t) < toxicity.REJECT)


@pytest.mark.parametrize("items", [4, sharding.ITEMS])
def test_shard_of_each_row(docs, items):
    """Sizes, checksums and places by the heap rule over groups and light buckets."""
    key = lambda t: "null" if t is None else hashlib.sha256(t.encode()).hexdigest()
    size = lambda t: len((t or "").encode()) + 1
    groups = collections.Counter()
    for _, t in TEXTS:
        groups[key(t)] += size(t)
    total, loads, item_of = sum(groups.values()), collections.Counter(), {}
    for k, load in groups.items():
        hashed = xxhash.xxh64_intdigest(k.encode(), 42)
        signed = hashed - (1 << 64) if hashed >> 63 else hashed
        item_of[k] = k if load * items >= total else f"#{signed % items}"
        loads[item_of[k]] += load
    filled, place = [0] * 3, {}
    for name, load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        place[name] = min(range(3), key=lambda s: (filled[s], s))
        filled[place[name]] += load
    want = collections.Counter(
        (i, size(t), zlib.crc32((t or "").encode()), place[item_of[key(t)]]) for i, t in TEXTS)
    rows = sharding.shard_documents(docs, shards=3, items=items).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in rows) == want
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def near_groups(texts):
    """doc_id -> smallest doc_id reachable over links of 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        w = [x for x in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode())]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def without_repeats(texts, width=20):
    """doc_id -> kept words; a window goes if its words start earlier anywhere."""
    seen, out = set(), {}
    for i in sorted(texts):
        w = WORD.findall((texts[i] or "").encode())
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            window = tuple(w[k : k + width])
            if window in seen:
                gone[k : k + width] = [True] * width
            seen.add(window)
        out[i] = [x for x, g in zip(w, gone, strict=True) if not g]
    return out


def test_pipeline_stages_of_each_row(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = written(stages["near_dedup"](spark, docs, sf_small), "t")
    groups = near_groups(texts)
    assert {r.doc_id: r.text for r in kept.collect()} == {i: texts[i] for i, g in groups.items() if g == i}
    cut = written(stages["substring_dedup"](spark, docs, sf_small), "t")
    got = {r.doc_id: r.text for r in cut.collect()}
    assert {i: WORD.findall(t.encode()) for i, t in got.items()} == without_repeats(texts)
    assert sum(map(len, got.values())) < sum(len(t or "") for t in texts.values())
    # packing: each document's ids, put together from its pieces, are the library's
    library = Tokenizer.from_file(public_tokenizer("byte_bpe_50k.json"))
    whole = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in got.items()}
    at, used = collections.Counter(), collections.defaultdict(list)
    for r in sorted(stages["packing"](spark, cut, sf_small).collect(), key=lambda r: (r.doc_id, r.start)):
        ids = whole[r.doc_id]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids) and r.length > 0
        part = np.asarray(ids[r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        at[r.doc_id] += r.length
        used[r.sequence_id].append((r.offset, r.length))
    assert at == {i: len(ids) for i, ids in whole.items()}
    for pieces in used.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    assert sorted(used) == list(range(len(used)))


def test_archive_of_a_hot_payload(spark, scratch):
    """The pages of a hot payload are split among tasks and still have one response."""
    pages = [(i, f"http://x/{i % 7}", "<p>same</p>" if i % 3 else f"<p>{i // 6}</p>") for i in range(3, 240)]
    path = scratch("warc")
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    warc.write_warc(table, path, rows_per_task=10)
    first = {}
    for i, _, html in pages:
        first.setdefault(html, i)
    want = {(i, "response" if first[h] == i else "revisit", None if first[h] == i else first[h],
             base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), len(h)) for i, _, h in pages}
    rows = warc.page_records(warc.read_warc(spark, path)).collect()
    assert len(rows) == len(pages)
    assert {(r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in rows} == want
