"""SimHash near-duplicates and connected components against brute force."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from answerloom.llm import simhash
from answerloom.llm.components import connected_components
from answerloom.llm.shared import work_dir


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if label[j] < label[i] and (fps[i] ^ fps[j]).bit_count() <= 3:
                    label[i], changed = label[j], True
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [r[0] for r, x in zip(rows, label) if x == label[i] and r[0] is not None]
        out.append((doc_id, f"{fps[i]:016x}", min(ids) if ids else None))
    return out


@given(st.text(alphabet=st.sampled_from("aB cÉ\t\n\x1c\x85 x"), max_size=40))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_hashes_alike(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("some words here"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"some words here", 42)


def words(seed, n=400):
    return np.random.default_rng(seed).integers(0, 10**6, n).astype(str).tolist()


def test_near_duplicates(spark):
    base = words(1)
    rows = [(10, " ".join(base)), (4, " ".join(base)), (None, " ".join(base))]
    for k in range(12):  # a chain of small changes
        base = [*base]
        base[k * 7] = f"new{k}"
        rows.append((100 + k, " ".join(base)))
    rows += [(k, " ".join(words(k))) for k in range(20, 30)]
    rows += [(50, None), (51, ""), (52, " \n "), (53, "one two"), (54, "One TWO"), (53, "one two"), (60, "word " * 30_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted(plain_components(rows), key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    want = {c for _, _, c in plain_components(rows) if c is not None}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    texts = [" ".join(words(k)) for k in range(200, 212)]
    rows = [(None, t, "a") for t in texts[:5]]  # null ids, unlike texts
    rows += [(None, texts[0], "b"), (None, texts[5], "a"), (3, texts[5], "a")]  # copies, one of a numbered document
    rows += [(7, texts[6], "a"), (7, texts[7], "a"), (8, texts[8], "b"), (8, texts[8], "a"), (9, texts[8], "a")]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    want = [(None, t, "a") for t in texts[:5]] + [(3, texts[5], "a"), (7, texts[6], "a"), (7, texts[7], "a"), (8, texts[8], "a")]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
    assert simhash.keep_one_of_each(kept.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "radius"), [(1, 3), (2, 3), (300, 3), (300, 2), (150, 5), (500, 1)])
def test_bit_sliced_pairs(n, radius):
    rng = np.random.default_rng(n + radius)
    base = rng.integers(0, 1 << 63, size=max(1, n // 12), dtype=np.uint64)
    fps = base[rng.integers(0, len(base), n)]
    for _ in range(4):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * (rng.random(n) < 0.4).astype(np.uint64)
    fps = np.unique(fps)
    got = {p for i, j in simhash.close_pairs(fps, radius) for p in zip(i.tolist(), j.tolist())}
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
    assert got == {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a < b}


def test_blocks_lose_no_link():
    masks = [m % 2**64 for m in simhash.block_masks()]
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for b in rng.choice(64, 3, replace=False):
            y ^= 1 << int(b)
        assert any(x & m == y & m for m in masks)


def test_large_buckets_are_dealt_out(spark):
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 12, 700).astype(np.uint64) | np.uint64(1 << 40))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    whole = {tuple(r) for r in connected_components(simhash.near_links(df, work_dir(spark, "a")), work_dir(spark, "b")).collect()}
    dealt = {tuple(r) for r in connected_components(simhash.near_links(df, work_dir(spark, "c"), split=50), work_dir(spark, "d")).collect()}
    assert whole == dealt and len(whole) == len(fps)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)], [(-5, 3), (3, 9), (10, 11), (11, 12), (12, 10)]])
def test_components(spark, edges):
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(r) for r in connected_components(df, work_dir(spark, "cc")).collect()} == set(label.items())
