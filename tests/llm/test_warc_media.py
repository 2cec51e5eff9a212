"""WARC archives and media columns: round trips, damage, brute force."""

import gzip
import hashlib
import math
import zlib

import numpy as np
import pytest

from answerloom.llm import media, warc

HTML = "<html>" + "x" * 200 + "</html>"
PAGES = [(5, "http://a/ b?c=é", HTML, 1), (3, None, HTML, 1), (9, "http://c\r\nX: y", HTML, 1), (1, "http://d", "short", 1), (2, "http://e", "short", 1), (4, "http://f", None, 1), (6, "http://g", "", 1), (7, "http://h", "日本" * 60, 1), (8, "http://i", "日本" * 60, 1), (None, "http://j", HTML, 1), (7, "http://h", "日本" * 60, 1), (10, "u", "big " * 300_000, 1)]


@pytest.mark.parametrize("most", [100_000, 2, 1])
def test_archives(spark, monkeypatch, most):
    monkeypatch.setattr(warc.with_responses, "__defaults__", (most,))
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest long")
    got = sorted((tuple(r) for r in warc.read_archives(spark, warc.archive_pages(pages)).collect()), key=str)
    want = []
    for page_id, _, html, _ in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h, _ in PAGES if (h or "") == (html or "") and p is not None]
        first = min(same) if same and len(data) >= 100 else page_id
        revisit = first is not None and first != page_id and len(data) >= 100
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.archive_pages(pages)).count() == 0


def test_normaliser_makes_members(tmp_path):
    records = [warc.record_bytes(k, f"http://x/{k}", b"p" * k, hashlib.sha256(b"p" * k).hexdigest(), None) for k in range(0, 3000, 500)]
    (tmp_path / "one.gz").write_bytes(gzip.compress(b"".join(records)))
    source, target = f"file://{tmp_path}/one.gz", f"file://{tmp_path}/many.gz"
    assert warc.normalise(source, target) == len(records)
    read = list(warc.read_records(target))
    assert [r.payload for r in read] == [b"p" * k for k in range(0, 3000, 500)]
    assert gzip.decompress((tmp_path / "many.gz").read_bytes()) == b"".join(records)
    data = (tmp_path / "one.gz").read_bytes()
    (tmp_path / "cut.gz").write_bytes(data[:-20])
    with pytest.raises(ValueError):
        warc.normalise(f"file://{tmp_path}/cut.gz", target)
    with pytest.raises(ValueError):
        list(warc.raw_records(iter([b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc"])))


def test_inflating_holds_little_and_a_failed_file_leaves_nothing(tmp_path, spark):
    (tmp_path / "bomb.gz").write_bytes(gzip.compress(b"0" * 50_000_000) + gzip.compress(b"1" * 10))
    with open(tmp_path / "bomb.gz", "rb") as f:
        sizes = [len(p) for p in warc.inflated(f)]
    assert sum(sizes) == 50_000_010 and max(sizes) <= 1 << 20
    folder = warc.work_dir(spark, "broken")
    rows = spark.createDataFrame([(1, "u", bytearray(b"x"), "d", None), (2, "u", None, "d", None)], "page_id long, url string, payload binary, digest string, response_id long").coalesce(1)
    with pytest.raises(Exception):
        warc.write_monolithic(rows, folder)
    import os

    assert os.listdir(folder.removeprefix("file:")) == []


def filtered(image, kinds):
    h, w = image.shape
    out = np.zeros((h, w), np.uint8)
    for r in range(h):
        for x in range(w):
            left, up, corner = int(image[r, x - 1]) if x else 0, int(image[r - 1, x]) if r else 0, int(image[r - 1, x - 1]) if r and x else 0
            base = left + up - corner
            paeth = min((left, up, corner), key=lambda v: abs(base - v))
            out[r, x] = (int(image[r, x]) - (0, left, up, (left + up) // 2, paeth)[kinds[r]]) & 255
    return out


def test_all_filters():
    rng = np.random.default_rng(0)
    for _ in range(5):
        image, kinds = rng.integers(0, 256, (20, 13), dtype=np.uint8), rng.integers(0, 5, 20)
        assert (media.unfilter(kinds, filtered(image, kinds)) == image).all()
    with pytest.raises(ValueError):
        media.unfilter(np.array([5]), np.zeros((1, 2), np.uint8))


def plain_hash(payload):
    """The cosine hash by loops: means of a 32 x 32 grid, the transform's double sum, bits against the median."""
    width = max(w for w in media.WIDTHS if w == 24 or w * w <= len(payload))
    rows = [payload[k : k + width] for k in range(0, len(payload), width)]

    def spans(n):
        return [range(k * n // 32, (k + 1) * n // 32) if n >= 32 else [k * n // 32] for k in range(32)]

    # columns first, then rows, as means of means
    by_column = [[sum(r[x] for x in s) / len(s) for s in spans(width)] for r in rows]
    grid = [[sum(by_column[y][x] for y in s) / len(s) for x in range(32)] for s in spans(len(rows))]
    cos = [[math.cos(math.pi * (2 * x + 1) * k / 64) for x in range(32)] for k in range(8)]
    freq = [round(sum(grid[y][x] * cos[u][y] * cos[v][x] for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(freq[1:])[31]
    bits = [0] + [int(f > middle) for f in freq[1:]]
    return bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, 64, 8)).hex()


@pytest.mark.parametrize("text", ["", "a", "é" * 288, "the quick brown fox " * 40, "x" * 577 + "y" * 3000, "abc\n" * 9000])
def test_hashes_are_those_of_plain_sums(text):
    payload, _ = media.payload_of(text)
    image = np.frombuffer(payload, np.uint8).reshape(-1, media.UNIT)
    assert media.low_frequency_hash(media.squared(image)).hex() == plain_hash(payload)


def test_png_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (3, 576), (50, 7)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        png = media.write_png(image)
        assert (media.read_png(png) == image).all()
        for at in (0, 20, 45, len(png) - 5):
            bad = bytearray(png)
            bad[at] ^= 1
            with pytest.raises(ValueError):
                media.read_png(bytes(bad))
        with pytest.raises(ValueError):
            media.read_png(png[:-3])


def test_stored_media(spark):
    texts = ["", None, "a", "é" * 288, "x" * 576, "x" * 577, "long text " * 20_000, "a"]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media.stored_media_features(docs).collect()}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        whole = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        assert len(r.feature) == 16 and bytes(r.hash).hex() == r.feature
    assert got[2].feature == got[7].feature and got[2].media_sha256 == got[7].media_sha256
    assert media.stored_media_features(docs.limit(0)).count() == 0
