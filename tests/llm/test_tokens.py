"""Tokens, Huffman files and packing, against the library itself and brute force."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from answerloom.llm import packing, shared, spool, tokenfile
from answerloom.llm.queries import tokenizer_path
from answerloom.llm.tokens import CachedEncoder

TEXTS = ["", None, "a", " a", "a ", "  two  spaces\n\n\nx \t y", "x|y | z", "don't \x1c weird", "é é ́x", "ΑΣ ΑΣΑ", "<|endoftext|> hi", "日本語 テキスト", "\n", " ", "a\n \nb", "1234 5.6", "a b   c", "|", "same same", "same same", "w" * 5000 + " " + "tail " * 2000]
ROWS = [(k, t, k) for k, t in enumerate(TEXTS)] + [(3, " a", 0), (None, "no id", 1)]
SCHEMA = "doc_id long, text string, n long"


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def encoder(request):
    return CachedEncoder(tokenizer_path(request.param), keep=50)


def plain(encoder, text):
    return encoder.tok.encode(text or "", add_special_tokens=False).ids


def test_cached_ids_are_the_librarys(encoder):
    for _ in range(3):  # the cache is full after the first round
        ids, n = encoder.encode(TEXTS)
        assert ids.tolist() == [i for t in TEXTS for i in plain(encoder, t)]
        assert n.tolist() == [len(plain(encoder, t)) for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sd .,|\n\t é́1 　ÉΣ-"), max_size=30), max_size=5))
def test_cached_ids_of_odd_texts(texts):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = CachedEncoder(tokenizer_path(name)) if name not in _MADE else _MADE[name]
        _MADE[name] = encoder
        assert encoder.encode(texts)[0].tolist() == [i for t in texts for i in plain(encoder, t)]


_MADE: dict = {}


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=80), st.integers(7, 18))
@settings(max_examples=60, deadline=None)
def test_code_lengths_are_optimal_or_limited(counts, limit):
    lengths = tokenfile.code_lengths(np.array(counts), limit).astype(int)
    used = [c for c in counts if c]
    assert ((lengths > 0) == (np.array(counts) > 0)).all() and lengths.max(initial=0) <= limit
    if len(used) > 1:
        assert sum(2.0**-n for n in lengths if n) == 1.0
        import heapq

        heap, cost = list(used), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        own = int((lengths * np.array(counts)).sum())
        assert own >= cost
        if limit >= 18:
            assert own == cost


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 300_000])
def test_bits_come_back(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.pareto(0.7, n) * 3, 5000).astype(np.uint32)
    lengths = tokenfile.code_lengths(np.bincount(ids, minlength=5001), 14)
    w = tokenfile.BitWriter(lengths)
    for k in range(0, n, 777):
        w.append(ids[k : k + 777])
    stream, checkpoints = w.finish()
    out = list(tokenfile.decode_blocks(stream, checkpoints, tokenfile.decoding_table(lengths), n))
    assert (np.concatenate(out) if out else np.zeros(0)).tolist() == ids.tolist()


def test_damaged_file_is_noticed(tmp_path):
    import pyarrow as pa

    lengths = tokenfile.code_lengths(np.ones(4, int))
    path = f"file://{tmp_path}/part"
    tokenfile.write_part(path, lengths, iter([(pa.array([1, None]), np.array([1, 2, 3, 0], np.uint32), np.array([3, 1]))]))
    table = tokenfile.decoding_table(lengths)
    assert [(i, x.tolist()) for i, x in tokenfile.read_part(path, table)] == [(1, [1, 2, 3]), (None, [0])]
    data = bytearray((tmp_path / "part").read_bytes())
    data[-1] ^= 255
    (tmp_path / "part").write_bytes(data)
    with pytest.raises(ValueError):
        list(tokenfile.read_part(path, table))


@pytest.mark.parametrize("limit", [8_000_000, 8])
def test_token_files(spark, monkeypatch, limit):
    monkeypatch.setattr(spool, "FILE_TOKENS", limit)
    monkeypatch.setattr(shared, "CLOSURE_ENTRIES", 3 if limit == 8 else 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2 if limit == 8 else 10_000)
    name = tokenizer_path("byte_bpe_50k.json")
    encoder = CachedEncoder(name)
    docs = spark.createDataFrame(ROWS, SCHEMA)
    folder, files = tokenfile.write_token_files(docs, name)
    got = [tuple(r) for r in tokenfile.read_token_files(spark, folder, files).orderBy("start").collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(files) > 6 or limit > 8
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for (doc_id, text, _), row in zip(order, got, strict=True):
        ids = plain(encoder, text) + [0]
        assert row[:3] == (doc_id, start, len(ids)) or doc_id == 3
        if doc_id != 3:
            assert row[3] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += row[2]


def test_token_files_of_nothing(spark):
    folder, files = tokenfile.write_token_files(spark.createDataFrame([], SCHEMA), tokenizer_path("byte_bpe_50k.json"))
    assert files == [] and tokenfile.read_token_files(spark, folder, files).count() == 0


def brute_bm25(docs, whole, idf, mean, seed):
    """Term by term, document by document."""
    out = []
    for d in whole:
        score = 0.0
        for t in set(whole[seed].tolist()):
            tf = int((d == t).sum())
            if tf:
                score += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        out.append(score)
    return out


@pytest.mark.parametrize("share", [0.0, 0.3, 2.0])
def test_bm25_scores_are_the_formula(share, monkeypatch):
    monkeypatch.setattr(packing, "DENSE_SHARE", share)
    rng = np.random.default_rng(1)
    whole = [rng.integers(0, 30, rng.integers(1, 60)).astype(np.uint32) for _ in range(12)]
    # of some documents only the end is packed, but all of it counts
    docs = [d[len(d) // 2 :] if k % 3 == 0 and len(d) > 1 else d for k, d in enumerate(whole)]
    known = {k: np.unique(whole[k], return_counts=True) for k in range(12) if len(docs[k]) < len(whole[k])}
    df = np.array([sum(t in d for d in whole) for t in range(30)])
    idf = np.log1p((12 - df + 0.5) / (df + 0.5))
    index = packing.Bm25Shard(docs, idf, 25.0, known)
    assert known
    for seed in range(12):
        assert index.scores(seed) == pytest.approx(brute_bm25(docs, whole, idf, 25.0, seed), rel=1e-5)


def test_windows_are_those_of_brute_force():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint32) for _ in range(60)]
    df = np.array([sum(t in d for d in docs) for t in range(40)])
    idf = np.log1p((60 - df + 0.5) / (df + 0.5))
    scores = np.array([brute_bm25(docs, docs, idf, 15.0, k) for k in range(60)])
    got = list(packing.fill_windows(packing.Bm25Shard(docs, idf, 15.0), [len(d) for d in docs], 64))
    left, tail, want = list(range(60)), None, []
    while left or tail:
        if tail is None:
            tail = (left.pop(0), 0)
        seed, room, own = tail[0], 64, []
        while tail and room:
            doc, at = tail
            take = min(room, len(docs[doc]) - at)
            own.append((doc, at, take))
            room -= take
            tail = (doc, at + take) if at + take < len(docs[doc]) else None
            if tail is None and room and left:
                best = max(left, key=lambda k: (round(scores[seed][k], 4), -k))
                left.remove(best)
                tail = (best, 0)
        want.append(own)
    assert got == want


def test_windows_take_the_best_neighbour_first():
    a, b, c, d = ([7] * 5 + [1] * 3, [2] * 8, [7] * 4 + [3] * 4, [4] * 8)
    ids = [np.array(x, np.uint32) for x in (a, b, c, d)]
    idf = np.ones(8)
    pieces = list(packing.fill_windows(packing.Bm25Shard(ids, idf, 8.0), [8] * 4, 16))
    assert [p[0] for p in pieces[0]] == [0, 2]
    assert sorted(x for w in pieces for x in w) == [(k, 0, 8) for k in range(4)]


@pytest.mark.parametrize("tokenizer", ["word_bpe_49k.json"])
def test_packing_covers_every_id_once(spark, tokenizer):
    name = tokenizer_path(tokenizer)
    encoder = CachedEncoder(name)
    rows = [tuple(r) for r in packing.pack_documents(spark.createDataFrame(ROWS, SCHEMA), name, window=64).collect()]
    want = {}
    for doc_id, text, _ in ROWS:
        if doc_id != 3:
            want[doc_id] = plain(encoder, text) + [1]
    seen: dict = {}
    for doc_id, start, length, crc, n, seq, offset, whole in rows:
        if doc_id in want:
            assert n == len(want[doc_id]) and crc == zlib.crc32(np.array(want[doc_id][start : start + length], "<u4").tobytes())
            seen.setdefault(doc_id, []).extend(range(start, start + length))
    assert all(sorted(seen[k]) == list(range(len(v))) for k, v in want.items())
    assert sum(r[2] for r in rows if r[0] == 3) == 2 * (len(plain(encoder, " a")) + 1)
    by_seq: dict = {}
    for r in rows:
        by_seq.setdefault(r[5], []).append((r[6], r[2], r[7]))
    for parts in by_seq.values():
        at = 0
        for offset, length, whole in sorted(parts):
            assert offset == at
            at += length
        assert at == whole <= 64 and (at == 64 or at & (at - 1) == 0)


def test_related_documents_meet_wherever_they_are_stored(spark, monkeypatch):
    """Documents of a topic share windows although each file holds all topics, and shards hold few documents."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 16)
    topics = ["granite quartz basalt feldspar", "violin cello sonata bassoon", "goalkeeper penalty offside striker", "photon neutrino quark boson"]
    rows = [(k, " ".join([f"{topics[k % 4]} the and of"] * 10), "x") for k in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place string").repartition(4)
    got: dict = {}
    for r in packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), window=256).collect():
        got.setdefault(r.sequence_id, set()).add(r.doc_id % 4)
    assert sum(len(s) == 1 for s in got.values()) > 0.7 * len(got)


def test_packing_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), tokenizer_path("word_bpe_49k.json")).count() == 0
