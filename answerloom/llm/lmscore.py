"""Language-model scores by cross-entropy difference.

Two bigram models over words, one of target documents and one of all documents,
are matched: the same order, one vocabulary, and one interpolation of pair,
word and uniform estimates whose weights do not depend on a model's size. A
document's own counts are left out of every model it belongs to, so that no
text scores itself. A token's loss under a model is -ln P(word | previous word); a
document's score is the mean over its tokens of the target loss less the
background loss, so that low scores are most like the target.

Every word and word pair has a 63-bit key and exact counts; nothing is dropped
or shared, and the table of counts grows with the corpus. Documents are cut
into chunks of ``CHUNK`` bytes. A chunk adds up its own n-grams and sends the
distinct ones, in order, to the parts of the key range, of which there is one
for each ``PART`` bytes of the corpus. A part adds up what all chunks sent and answers each chunk with the corpus counts of its n-grams, and
the chunk scores its documents with them. A frequent n-gram is one row of a
chunk's block, so no key is hot. Words are hashed vectorised: prefix sums of
``byte * base ** position`` modulo 2 ** 64 give every word's hash from its two
ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import prefix_sums, span_sums
from .shared import open_fs, work_dir

#: Words that the vocabulary of the uniform share has at least; with more distinct words in the corpus it has those.
WORDS = 1 << 18
#: Weight of the pair estimate in all, and of the uniform one in the word estimate.
PAIR_WEIGHT, UNIFORM_WEIGHT = 0.4, 0.05
#: Bytes of text in a chunk (64 more for each document), and of the corpus for each part of the key range.
CHUNK, PART = 1 << 22, 1 << 23
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word (run of bytes that are no ASCII white space), in order."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    space = _SPACE[b]
    edges = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
    first, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    h = span_sums(prefix_sums(b), first, end)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def ngram_keys(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the text's words (odd) and of its pairs (even), in order; the first word is in no pair."""
    h = word_hashes((text or "").lower().encode("utf-8", "surrogatepass"))
    pair = (h[1:] ^ (h[:-1] * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xA0761D6478BD642F)
    return h | np.uint64(1), pair & ~np.uint64(1)


def token_losses(words: np.ndarray, pairs: np.ndarray, first: np.ndarray, total: np.ndarray | float, vocabulary: float) -> np.ndarray:
    """-ln P of each token by one model: ``words`` counts each token's word, ``pairs`` the pairs of the tokens that are not ``first`` in a text, ``total`` the model's tokens."""
    total = np.broadcast_to(np.asarray(total, float), words.shape)
    known = np.divide(words, total, out=np.full(len(words), 1.0 / vocabulary), where=total > 0)
    single = (1 - UNIFORM_WEIGHT) * known + UNIFORM_WEIGHT / vocabulary
    context, pair = np.zeros(len(words)), np.zeros(len(words))
    later = np.flatnonzero(~first)
    context[later], pair[later] = words[later - 1], pairs
    share = np.divide(pair, context, out=np.zeros(len(words)), where=context > 0)
    return -np.log(np.where(context > 0, PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * single, single))


def own_counts(places: np.ndarray, docs: np.ndarray, size: int) -> np.ndarray:
    """How often each row's (document, n-gram) occurs; places: the n-gram's number below ``size``."""
    _, at, n = np.unique(docs * size + places, return_inverse=True, return_counts=True)
    return n[at]


class Model(NamedTuple):
    """All keys in order, their counts (target and background), the sums of the words' counts, and the vocabulary's size."""

    keys: np.ndarray
    counts: np.ndarray  # 2 x keys
    totals: tuple[float, float]
    vocabulary: int

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Model:
        is_word = (keys & np.uint64(1)).astype(bool)
        return cls(keys, counts, tuple(counts[:, is_word].sum(1).tolist()), max(WORDS, int(is_word.sum())))

    def losses(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The loss of each token of a text that the models have not seen, under the target and under the background."""
        w, p = ngram_keys(text)
        known = np.append(self.keys, ~np.uint64(0))
        at = np.searchsorted(self.keys, np.concatenate([w, p]))
        counts = np.where(known[at] == np.concatenate([w, p]), np.append(self.counts, np.zeros((2, 1)), 1)[:, at], 0)
        first = np.arange(len(w)) == 0
        target, background = (token_losses(c[: len(w)], c[len(w) :], first, total, self.vocabulary) for c, total in zip(counts, self.totals))
        return target, background


def _pack(arrays: np.ndarray) -> bytes:
    """Rows of 64-bit numbers, compressed by byte planes, as the high bytes are mostly zero."""
    planes = np.ascontiguousarray(np.ascontiguousarray(arrays, "<u8").view(np.uint8).reshape(-1, 8).T)
    return len(planes[0]).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, rows: int) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], n * 8, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(rows, -1)


def _pack_keys(keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """Keys, in order, as differences."""
    return _pack(np.stack([np.diff(keys, prepend=np.uint64(0)), *(c.astype(np.uint64) for c in counts)]))


def _unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, *counts = _unpack(data, 3)
    return np.cumsum(keys, dtype=np.uint64), np.stack(counts)


def _rows(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))


_CHUNKS = {"chunk": pa.int64(), "size": pa.int64(), "data": pa.binary()}
_BLOCKS = {"chunk": pa.int64(), "part": pa.int32(), "data": pa.binary()}
_ANSWERS = {"chunk": pa.int64(), "part": pa.int32(), "n_target": pa.int64(), "n_tokens": pa.int64(), "n_words": pa.int64(), "data": pa.binary()}


def cut_chunks(docs: DataFrame) -> DataFrame:
    """A row for each chunk of ``docs``: its number, its size and its documents."""

    def chunk(number: int, size: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for batch in held:
                out.write_batch(batch)
        return _rows(_CHUNKS, [(number, size, sink.getvalue().to_pybytes())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, held = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            first = 0
            for k, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
                size += 64 + (n or 0)
                if size >= CHUNK:
                    yield chunk(number, size, [*held, batch.slice(first, k + 1 - first)])
                    number, size, held, first = number + 1, 0, [], k + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield chunk(number, size, held)

    return docs.mapInArrow(run, "chunk long, size long, data binary")


def _documents(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def count_blocks(chunks: DataFrame, parts: int) -> DataFrame:
    """The distinct n-grams of each chunk in each part of the key range: keys in order, target and background counts."""

    def blocks(number: int, documents: pa.Table) -> pa.RecordBatch:
        keys = [np.concatenate(ngram_keys(t.as_py())) for t in documents.column("text")]
        own, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for k, t in zip(keys, documents.column("is_target").to_pylist()) if t)]), return_counts=True)
        every, background = np.unique(np.concatenate(keys), return_counts=True)
        target = np.zeros(len(every), np.int64)
        target[np.searchsorted(every, own)] = n
        edges = np.searchsorted(((every >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1)).tolist()
        rows = [(number, p, _pack_keys(every[a:b], target[a:b], background[a:b])) for p, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
        return _rows(_BLOCKS, rows) if rows else pa.RecordBatch.from_pylist([], pa.schema(_BLOCKS.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield blocks(number, _documents(data))

    return chunks.select("chunk", "data").mapInArrow(run, "chunk long, part int, data binary")


def sum_parts(chunks: DataFrame, table: bool = False) -> DataFrame:
    """Corpus counts: the answer to each chunk in each part (target and background, in the order of its keys), or the table itself (keys and counts, a row for each part).

    n_target, n_tokens and n_words add up to the tokens of both models and the number of distinct words.
    """
    parts = 1 + (chunks.agg(F.sum("size")).first()[0] or 0) // PART

    def part_rows(part: int, chunk: list[int], data: list[bytes]) -> pa.RecordBatch:
        sent = [_unpack_keys(x) for x in data]
        keys, at = np.unique(np.concatenate([k for k, _ in sent]), return_inverse=True)
        total = np.stack([np.bincount(at, np.concatenate([c[m] for _, c in sent]), len(keys)) for m in (0, 1)])
        is_word = (keys & np.uint64(1)).astype(bool)
        sums = (*total[:, is_word].sum(1).astype(int).tolist(), int(is_word.sum()))
        if table:
            return _rows(_ANSWERS, [(None, part, *sums, _pack_keys(keys, *total))])
        ends = np.cumsum([len(k) for k, _ in sent]).tolist()
        return _rows(_ANSWERS, [(c, part, *((0, 0, 0) if a else sums), _pack(total[:, at[a:b]].astype(np.uint64))) for c, a, b in zip(chunk, [0, *ends], ends)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, data = None, [], []
        for batch in batches:
            for c, part, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if part != now and chunk:
                    yield part_rows(now, chunk, data)
                    chunk, data = [], []
                now = part
                chunk.append(c)
                data.append(x.as_py())
        if chunk:
            yield part_rows(now, chunk, data)

    sent = count_blocks(chunks, parts).repartition(parts, "part").sortWithinPartitions("part", "chunk")
    return sent.mapInArrow(run, "chunk long, part int, n_target long, n_tokens long, n_words long, data binary")


def _saved(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def train(docs: DataFrame, folder: str) -> str:
    """docs: text and is_target; the path of the table of all n-grams."""
    sum_parts(_saved(cut_chunks(docs), f"{folder}/chunks"), table=True).write.parquet(f"{folder}/ngrams")
    return f"{folder}/ngrams"


def load_model(path: str) -> Model:
    """The whole table in this process; ``cross_entropy_difference`` never holds more than a part."""
    fs, at = open_fs(path)
    found = pq.read_table(at, filesystem=fs, columns=["part", "data"]).sort_by("part").column("data").to_pylist()
    parts = [_unpack_keys(x) for x in found] or [(np.zeros(0, np.uint64), np.zeros((2, 0)))]
    return Model.of(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts], 1).astype(float))


def score_chunk(documents: pa.Table, answers: list[bytes], totals: tuple[float, float], vocabulary: int) -> pa.RecordBatch:
    """The scores of a chunk's documents from the answers to it, in the order of the parts; each without its own counts."""
    keys = [ngram_keys(t.as_py()) for t in documents.column("text")]
    n = np.array([len(w) for w, _ in keys])
    every, at = np.unique(np.concatenate([w for w, _ in keys] + [p for _, p in keys]), return_inverse=True)
    counts = np.concatenate([np.zeros((2, 0), np.uint64), *(_unpack(x, 2) for x in answers)], 1).astype(float)
    if counts.shape[1] != len(every):
        raise ValueError(f"{counts.shape[1]} counts for {len(every)} n-grams")
    some, ends = np.flatnonzero(n), np.cumsum(n)
    starts = (ends - n)[some]
    first = np.zeros(int(n.sum()), bool)
    first[starts] = True
    means = np.zeros((2, len(n)))
    if len(some):
        doc = np.repeat(np.arange(len(n)), n)
        both = np.concatenate([doc, doc[~first]])
        own = own_counts(at, both, len(every))
        target = documents.column("is_target").to_numpy()
        for k, belongs in enumerate((target, np.ones(len(n), bool))):
            left = counts[k][at] - own * belongs[both]
            loss = token_losses(left[: len(first)], left[len(first) :], first, totals[k] - (n * belongs)[doc], vocabulary)
            means[k, some] = np.add.reduceat(loss, starts) / n[some]
    names = ["doc_id", "n_tokens", "target_loss", "background_loss", "cross_entropy_difference"]
    return pa.RecordBatch.from_arrays([documents.column("doc_id").combine_chunks(), pa.array(n, pa.int64()), *map(pa.array, (*means, means[0] - means[1]))], names=names)


def score(chunks: DataFrame, answers: DataFrame, kind: str) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and cross_entropy_difference of every document of the chunks."""
    n = [x or 0 for x in answers.agg(F.sum("n_target"), F.sum("n_tokens"), F.sum("n_words")).first()]
    totals, vocabulary = (float(n[0]), float(n[1])), max(WORDS, n[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, answered = None, []
        for batch in batches:
            for part, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                if part < 0:
                    if documents is not None:
                        yield score_chunk(documents, answered, totals, vocabulary)
                    documents, answered = _documents(data), []
                else:
                    answered.append(data.as_py())
        if documents is not None:
            yield score_chunk(documents, answered, totals, vocabulary)

    both = chunks.select("chunk", F.lit(-1).alias("part"), "data").unionByName(answers.select("chunk", "part", "data"))
    both = both.repartition("chunk").sortWithinPartitions("chunk", "part")
    return both.mapInArrow(run, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, cross_entropy_difference double")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores every document against the documents that ``labels`` (doc_id, quality, toxic) calls good: quality 1 and not toxic.

    Null texts and texts without words have no tokens and score 0; without any
    other good document the target model is uniform. Several label rows of a document
    count once: it is a target if any of them says so. Repeated rows are documents of
    their own, each of which is a trace of the other; equal rows have equal scores.
    Other columns of both tables do not matter.
    """
    folder = work_dir(docs.sparkSession, "lmscore")
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct().withColumn("is_target", F.lit(True))
    chunks = _saved(cut_chunks(mark_targets(docs.select("doc_id", "text"), good)), f"{folder}/chunks")
    return score(chunks, _saved(sum_parts(chunks), f"{folder}/answers"), docs.schema["doc_id"].dataType.simpleString())


#: Ids of target documents, up to which they are broadcast (8 bytes each and what a hash table adds).
BROADCAST_IDS = 200_000


def mark_targets(docs: DataFrame, good: DataFrame) -> DataFrame:
    """doc_id, text and is_target. A small set of ids is broadcast; beyond ``BROADCAST_IDS`` the texts are joined by id."""
    few = good.count() <= BROADCAST_IDS
    known = docs.where("doc_id is not null")
    joined = known.join(F.broadcast(good) if few else good, "doc_id", "left")
    # rows without an id are no targets, and stay where they are
    joined = joined.unionByName(docs.where("doc_id is null").withColumn("is_target", F.lit(False)))
    return joined.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce("is_target", F.lit(False)).alias("is_target"))
