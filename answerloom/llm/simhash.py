"""Near-duplicates by SimHash: 64-bit fingerprints that differ in at most three bits.

Fingerprints that agree on three of six bit blocks meet in a bucket (twenty
choices of blocks; two fingerprints within three bits agree on one of them at
least, so no link is lost). A bucket is compared bit-sliced: the fingerprints'
bits stand in vertical planes, 64 fingerprints to a word, and carry-save
counters add one plane at a time to 64 distances at once; words in which all
distances are over the radius are abandoned. A bucket gives a spanning forest
of its links, not all pairs. Only distinct fingerprints are compared. A bucket
beyond ``SPLIT`` fingerprints is dealt out as pairs of chunks to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import work_dir

RADIUS, BLOCKS = 3, 6
#: Fingerprints of one bucket that one task compares.
SPLIT = 20_000
#: A bucket's size is foreseen from one in so many fingerprints (by hash); a bucket that is missed is dealt out when it is met.
FORESEEN_BY = 16
#: Rows of one fingerprint from which its component is broadcast to them, at least, and fingerprints that are, at most.
HEAVY_ROWS, MOST_HEAVY = 256, 100_000
#: Words of 64 distances that are held at once; in a dense bucket all of them can be links.
CELLS = 1 << 15
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """SimHash of the 3-word shingles' XXH64 (seed 42); a null or wordless text gives 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < 3:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, ones = len(words) - 2, np.zeros(64, np.int64)
    edges = list(zip(starts[:n].tolist(), ends[2:].tolist()))
    for k in range(0, n, 20_000):
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in edges[k : k + 20_000]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash): the fingerprint as a signed long, and XXH64 of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, "doc_id long, fp long, text_hash long")


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks of all choices of ``blocks - radius`` of the blocks, as signed longs."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(own, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bit_planes(fps: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """planes[k, w]: bit ``bits[k]`` of fingerprints 64 w to 64 w + 63."""
    width = -(-len(fps) // 64)
    padded = np.zeros(width * 64, np.uint64)
    padded[: len(fps)] = fps
    rows = ((padded[None, :] >> bits[:, None].astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(rows, axis=1, bitorder="little").view("<u8").reshape(len(bits), width)


def close_pairs(fps: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of positions whose fingerprints differ in at most ``radius`` bits, in portions."""
    n = len(fps)
    varying = int(np.bitwise_or.reduce(fps ^ fps[0])) if n else 0
    bits = np.array([b for b in range(64) if varying >> b & 1], np.int64)
    if not len(bits):
        bits = np.array([0])
    planes = bit_planes(fps, bits)
    own = (fps[:, None] >> bits[None, :].astype(np.uint64)) & np.uint64(1)
    width, levels = planes.shape[1], radius.bit_length()
    for first in range(0, n, step := max(1, CELLS // width)):
        query = np.arange(first, min(n, first + step))
        q, w = np.nonzero(np.arange(width)[None, :] >= (query // 64)[:, None])
        q += first
        counters = [np.zeros(len(q), np.uint64) for _ in range(levels)]
        over = np.zeros(len(q), np.uint64)
        for k in range(len(bits)):
            carry = planes[k, w] ^ (np.uint64(0) - own[q, k])
            for c in counters:
                carry, c[:] = c & carry, c ^ carry
            over |= carry
            if k % 4 == 3:
                alive = over != _FULL
                if not alive.all():
                    q, w, over = q[alive], w[alive], over[alive]
                    counters = [c[alive] for c in counters]
        # the counters hold distances up to 2 ** levels - 1; a smaller radius is compared bit by bit
        if radius + 1 < 1 << levels:
            more, same = np.zeros(len(q), np.uint64), np.full(len(q), _FULL)
            for level in reversed(range(levels)):
                bit = _FULL if radius >> level & 1 else np.uint64(0)
                more |= same & counters[level] & ~bit
                same &= ~(counters[level] ^ bit)
            over |= more
        hit, place = np.nonzero(np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, j = q[hit], w[hit] * 64 + place
        keep = (j > i) & (j < n)
        yield i[keep], j[keep]


def spanning_forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) positions for each member linked to an earlier one."""
    parent = np.arange(len(fps))
    for i, j in close_pairs(fps, radius):
        while len(i):
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
            a, b = parent[i], parent[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    while (up := parent[parent]).tobytes() != parent.tobytes():
        parent = up
    member = np.flatnonzero(parent != np.arange(len(fps)))
    return member, parent[member]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, fingerprints) of each run of two or more rows with equal keys; rows come sorted by key."""
    held: list[np.ndarray] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        fp = batch.column("fp").to_numpy().view(np.uint64)
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(fp)]])
        first = tuple(c[0] for c in columns)
        if now is not None and first != now:
            if (n := sum(map(len, held))) > 1:
                yield now, np.concatenate(held) if len(held) > 1 else held[0]
            held = []
        last = len(starts) - 1
        wide = set(np.flatnonzero(ends - starts > 1).tolist()) | {0, last}
        for k in sorted(wide):
            own = fp[starts[k] : ends[k]]
            if k == 0 and held:
                held.append(own.copy())
                if k == last:
                    break
                n = sum(map(len, held))
                if n > 1:
                    yield now, np.concatenate(held)
                held = []
            elif k == last:
                held = [own.copy()]
            elif len(own) > 1:
                yield tuple(c[starts[k]] for c in columns), own
        now = tuple(c[-1] for c in columns)
    if held and sum(map(len, held)) > 1:
        yield now, np.concatenate(held)


def near_links(classes: DataFrame, folder: str, radius: int = RADIUS, blocks: int = BLOCKS, split: int = SPLIT) -> DataFrame:
    """Links (a, b) among distinct fingerprints (fp): every pair within the radius is connected by them."""
    spark, keys = classes.sparkSession, ["choice", "bits"]
    masks = F.array(*[F.lit(m) for m in block_masks(blocks, radius)])

    def in_buckets(of: DataFrame) -> DataFrame:
        return of.select("fp", F.posexplode(masks).alias("choice", "mask")).select("fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))

    some = in_buckets(classes.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(FORESEEN_BY)) == 0))
    foreseen = some.groupBy(*keys).agg((F.count("*") * FORESEEN_BY).alias("n")).where(F.col("n") > split)
    foreseen.select(*keys, F.ceil(F.col("n") / split).alias("chunks")).write.mode("overwrite").parquet(f"{folder}/foreseen")
    foreseen = spark.read.schema("choice int, bits long, chunks long").parquet(f"{folder}/foreseen")
    any_large, keyed = not foreseen.isEmpty(), in_buckets(classes)
    # at most 20 / split of the fingerprints' number: a small table up to billions of them
    few = foreseen.count() <= MOST_HEAVY if any_large else False
    known = F.broadcast(foreseen) if few else foreseen
    dealt = keyed.join(known, keys).select("fp", *keys, F.pmod(F.xxhash64("fp", F.lit(2)), F.col("chunks")).alias("chunk"), "chunks") if any_large else None
    if any_large:
        keyed = keyed.join(known, keys, "left_anti")
    keyed = keyed.repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches):
        out: list = []
        for key, fps in _runs(batches, keys):
            if len(fps) > split:
                chunks, fps = -(-len(fps) // split), np.sort(fps)
                for c in range(chunks):
                    own = fps[c * split : (c + 1) * split].view(np.int64)
                    same = [np.full(len(own), v, np.int64) for v in (*key, c, chunks)]
                    yield _links(own, own, *same)
            else:
                member, root = spanning_forest(fps, radius)
                if len(member):
                    out.append((fps[member].view(np.int64), fps[root].view(np.int64)))
            if sum(len(m) for m, _ in out) > 50_000:
                yield _links(*map(np.concatenate, zip(*out)))
                out = []
        if out:
            yield _links(*map(np.concatenate, zip(*out)))

    first = keyed.mapInArrow(compare, "a long, b long, choice long, bits long, chunk long, chunks long")
    first.write.mode("overwrite").parquet(f"{folder}/buckets")
    first = spark.read.schema(first.schema).parquet(f"{folder}/buckets")
    links = first.where("chunks is null").select("a", "b")
    large = first.where("chunks is not null").select(F.col("a").alias("fp"), F.col("choice").cast("int").alias("choice"), "bits", "chunk", "chunks")
    if large.isEmpty():
        if not any_large:
            return links
        large = dealt
    elif any_large:
        large = large.unionByName(dealt)
    pairs = large.select("fp", "choice", "bits", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    pairs = pairs.select("fp", "choice", "bits", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    pair = [*keys, "low", "high"]

    def compare_chunks(batches):
        for _, fps in _runs(batches, pair):
            member, root = spanning_forest(fps, radius)
            yield pa.RecordBatch.from_arrays([pa.array(fps[member].view(np.int64)), pa.array(fps[root].view(np.int64))], names=["a", "b"])

    return links.unionByName(pairs.repartition(*pair).sortWithinPartitions(*pair).mapInArrow(compare_chunks, "a long, b long"))


def _links(a: np.ndarray, b: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
    more = [pa.array(x, pa.int64()) for x in rest] or [pa.nulls(len(a), pa.int64())] * 4
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *more], names=["a", "b", "choice", "bits", "chunk", "chunks"])


def components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, fp, text_hash), and of each fingerprint (fp) its component's root fingerprint and smallest doc_id (root, component_id)."""
    spark = docs.sparkSession
    folder = work_dir(spark, "simhash")
    fingerprints(docs).write.parquet(f"{folder}/fingerprints")
    rows = spark.read.schema("doc_id long, fp long, text_hash long").parquet(f"{folder}/fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"))
    roots = connected_components(near_links(classes.select("fp"), folder), folder)
    linked = classes.join(roots, classes.fp == roots.node).select("fp", "root", "least_id")
    named = linked.join(linked.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "root", "component_id")
    component = F.when(F.col("component_id").isNull(), F.col("least_id")).otherwise(F.col("component_id"))
    named = classes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), component.alias("component_id"), "n")
    named.write.parquet(f"{folder}/named")
    return rows, spark.read.schema(named.schema).parquet(f"{folder}/named")


def with_components(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``rows`` joined with their fingerprints' components.

    Fingerprints of very many rows are broadcast to them where they lie; the bound
    on their rows grows with the table, so there are ``MOST_HEAVY`` of them at most.
    """
    least = max(HEAVY_ROWS, rows.count() // MOST_HEAVY)
    heavy, light = F.broadcast(named.where(F.col("n") >= least)), named.where(F.col("n") < least)
    return rows.join(heavy, "fp").unionByName(rows.join(heavy, "fp", "left_anti").join(light, "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links of at most 3 bits reach.

    A null text has the fingerprint 0, like one without words, and is linked like
    any other; rows with equal ids stay apart; null ids never name a component
    (it is null where all ids are). No documents give no rows.
    """
    rows, named = components(docs)
    return with_components(rows.select("doc_id", "fp"), named.select("fp", "component_id", "n")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, one row of each component: that with the smallest doc_id (nulls last), of these one with the least hash of its text.

    A row is known by its id and text together, as neither names it alone; of
    rows alike in both the least in its other columns stays.
    """
    rows, named = components(docs)
    # combined where the rows lie, however many share a fingerprint
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least")
    firsts = rows.groupBy("fp").agg(least).join(named, "fp").groupBy("root").agg(F.min("least").alias("least"))
    alike = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession, "simhash-kept")
    firsts.select("least.doc_id", "least.text_hash").write.parquet(f"{folder}/kept")
    alike.select("doc_id", "text_hash").write.parquet(f"{folder}/alike")
    kept, alike = (spark.read.schema("doc_id long, text_hash long").parquet(f"{folder}/{name}") for name in ("kept", "alike"))
    # joined by the hash first, as ids may be null
    twice = (kept["text_hash"] == alike["text_hash"]) & kept["doc_id"].eqNullSafe(alike["doc_id"])
    single, several = kept.join(alike, twice, "left_anti"), kept.join(alike, twice, "left_semi")
    text_hash = F.xxhash64(docs["text"].cast("string"))

    def same(own: DataFrame):
        return docs["doc_id"].cast("long").eqNullSafe(own["doc_id"]) & (text_hash == own["text_hash"])

    out = docs.join(single.hint("shuffle_hash"), same(single), "left_semi")
    if several.isEmpty():
        return out
    again = docs.join(several, same(several), "left_semi")
    row = F.min(F.struct(*[docs[c] for c in docs.columns])).alias("__answerloom_row")
    return out.unionByName(again.groupBy(docs["doc_id"].alias("__answerloom_id"), text_hash.alias("__answerloom_hash")).agg(row).select("__answerloom_row.*"))
