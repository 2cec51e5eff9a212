"""Prefix hashes and fingerprints of edited texts against plain slicing."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from answerloom.llm import prefixhash as P

TEXT = st.text(alphabet="ab", max_size=40)


@given(TEXT, TEXT, st.data())
@settings(max_examples=200, deadline=None)
def test_spans_and_extensions(a, b, data):
    x, y = P.PrefixHash(P.code_points(a)), P.PrefixHash(P.code_points(b))
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
    common = 0
    while i + common < len(a) and j + common < len(b) and a[i + common] == b[j + common]:
        common += 1
    assert x.common_extension(i, y, j) == common


@given(TEXT, st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_equal_spans_have_equal_hashes(a, n):
    h = P.PrefixHash(P.code_points(a)).spans(n)
    n = min(n, len(a))
    spans = [a[k : k + n] for k in range(len(a) - n + 1)] if a else []
    assert len(h) == len(spans)
    assert len(set(h.tolist())) == len(set(spans)) and len(set(zip(spans, h.tolist()))) == len(set(spans))


def test_slots_hold_the_least_hash():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (0, 5, 4000, 50_000):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        got = P.slot_minima(h)
        for s in range(0, P.SLOTS, 9):
            own = h[(h & np.uint64(P.SLOTS - 1)) == s]
            assert got[s] == (own.min() if len(own) else np.uint64(2**64 - 1))


def plain(text):
    return P.digits(P.slot_minima(P.PrefixHash(P.code_points(text)).spans()))


TEXTS = [(5, "x" * 23), (9, "é" * 30), (3, "hello world, this is a text that is long enough " * 5), (3, "same id, other text"), (7, None), (1, ""), (2, "a"), (None, "no id at all"), (8, "日本語" * 4000), (4, "hello world, this is a text that is long enough " * 5), (6, "y" * 24), (4, "hello world, this is a text that is long enough " * 5)]


def test_edited_fingerprints(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, 1) for r in TEXTS], "doc_id long, text string, n_chars long")
    for parts in (1, 4):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = [r.asDict() for r in P.edited_fingerprints(df).collect()]
        ordered = [(r.doc_id, r.text or "") for r in df.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
        want = []
        for (doc_id, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            a, b, c = plain(text), plain(edited), plain(following)
            want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), P.as_text(a), P.as_text(b), P.likeness(a, b), P.likeness(a, c)))
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        assert sorted((tuple(g[n] for n in names) for g in got), key=str) == sorted(want, key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert P.edited_fingerprints(df.limit(0)).count() == 0
    lone = P.edited_fingerprints(df.where("doc_id = 9")).first()
    assert lone.near_next == 1.0 and lone.n_chars == 30
