"""WARC archives: writing pages, normalising monolithic gzip files, reading by index.

A monolithic archive is one gzip stream over all its records, so no record can
be reached without inflating all before it. ``normalise`` inflates such a file
once, from front to back, holding one record, and writes every record as a gzip
member of its own, with a sidecar index: a JSON line for each record with its
offset and length in the new file. ``read_records`` seeks by that index.

Records follow WARC/1.1. Of pages with equal payloads of at least
``REVISIT_BYTES`` bytes the one with the smallest page_id is a response and the
others are revisits of it without a payload.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import atomic_output, open_input, over_files, work_dir

REVISIT_BYTES = 100
#: Uncompressed bytes after which a writer starts another archive.
ARCHIVE_BYTES = 64 << 20
#: Groups of equal payloads up to which their table is broadcast (under 100 bytes each).
BROADCAST_GROUPS = 100_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BUFFER = 1 << 20


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """What follows the HTTP header of a response."""
        return self.block.partition(b"\r\n\r\n")[2]


def record_id(page_id: int | None, uri: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else uri)}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, response_id: int | None) -> bytes:
    """One record; a revisit if ``response_id`` is given."""
    uri = quote(url, safe="%:/?#[]@!$&'()*+,;=~-._") if url else f"urn:page:{'' if page_id is None else page_id}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if response_id is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, uri)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    head.append(f"Page-Payload-Length: {len(payload)}")
    if response_id is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(response_id, '')}", f"Page-Refers-To: {response_id}"]
    block = http + payload if response_id is None else http
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(f) -> Iterator[bytes]:
    """The contents of a gzip file of one or more members, in pieces of at most ``_BUFFER`` bytes; a file that ends early raises ValueError."""
    z, started = zlib.decompressobj(31), False
    while data := f.read(_BUFFER):
        while data:
            if z.eof:
                z, started = zlib.decompressobj(31), False
            started = True
            yield z.decompress(data, _BUFFER)
            data = z.unconsumed_tail or z.unused_data
    while started and not z.eof and (piece := z.decompress(b"", _BUFFER)):
        yield piece
    if started and not z.eof:
        raise ValueError("the gzip stream ends early")


def raw_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole bytes) of each record; holds one record and one piece."""
    held, ended = bytearray(), False

    def more() -> bool:
        nonlocal ended
        piece = next(pieces, None)
        ended = piece is None
        held.extend(piece or b"")
        return not ended

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if at < 0:
            if held.strip():
                raise ValueError("the file ends within a record's header")
            return
        headers = parse_headers(bytes(held[:at]))
        end = at + 4 + int(headers["content-length"]) + 4
        while len(held) < end and more():
            pass
        if held[end - 4 : end] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, bytes(held[:end])
        del held[:end]


def parse_headers(data: bytes) -> dict[str, str]:
    version, *lines = data.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def parse_record(data: bytes) -> Record:
    at = data.index(b"\r\n\r\n")
    headers = parse_headers(data[:at])
    block = data[at + 4 : at + 4 + int(headers["content-length"])]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        raise ValueError("a block does not match its digest")
    return Record(headers, block)


def normalise(source: str, target: str) -> int:
    """Rewrites an archive with a member for each record and ``target + '.idx'`` beside it; the number of records."""
    offset, n = 0, 0
    with open_input(source) as f, atomic_output(f"{target}.idx") as index:
        with atomic_output(target) as out:
            for headers, data in raw_records(inflated(f)):
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = z.compress(data) + z.flush()
                entry = {"offset": offset, "length": len(member), "type": headers["warc-type"], "id": headers["warc-record-id"], "uri": headers.get("warc-target-uri")}
                index.write(json.dumps(entry).encode() + b"\n")
                out.write(member)
                offset, n = offset + len(member), n + 1
    return n


def read_records(path: str) -> Iterator[Record]:
    """The records of a normalised archive, each through its index entry."""
    with open_input(f"{path}.idx") as f:
        entries = [json.loads(line) for line in f.read().splitlines()]
    with open_input(path) as f:
        for e in entries:
            f.seek(e["offset"])
            z = zlib.decompressobj(31)
            data = z.decompress(f.read(e["length"]))
            if not z.eof or z.unused_data:
                raise ValueError("an index entry does not name exactly one member")
            record = parse_record(data)
            if record.headers["warc-record-id"] != e["id"]:
                raise ValueError("the index names another record")
            yield record


def equal_payloads(pages: DataFrame) -> DataFrame:
    """(digest, response_id) of payloads that several pages share."""
    groups = pages.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("response_id"))
    return groups.where("n > 1 and response_id is not null").select("digest", "response_id", "n")


def with_responses(rows: DataFrame, equal: DataFrame, most: int = BROADCAST_GROUPS) -> DataFrame:
    """``rows`` with the response_id of their payload's group, if there is one.

    Up to ``most`` groups are broadcast. Beyond, the largest are, so that no key of the
    join has many rows; payloads that are too short to match take no part in it.
    """
    if equal.count() <= most:
        return rows.join(F.broadcast(equal.drop("n")), "digest", "left")
    # groups of so many rows: there are ``most`` at most
    least = equal.agg(F.sum("n")).first()[0] // most + 1
    large = F.broadcast(equal.where(F.col("n") >= least).drop("n"))
    long = rows.where(F.col("size") >= REVISIT_BYTES)
    out = long.join(large, "digest").unionByName(long.join(large, "digest", "left_anti").join(equal.where(F.col("n") < least).drop("n"), "digest", "left"))
    return out.unionByName(rows.where(F.col("size") < REVISIT_BYTES).withColumn("response_id", F.lit(None).cast("long")))


def write_monolithic(pages: DataFrame, folder: str) -> list[str]:
    """One gzip stream, or several of ``ARCHIVE_BYTES``, for each task; the names of the files.

    pages: page_id, url, payload (binary), digest, response_id (null for a response).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, every = TaskContext.get().partitionId(), [], rows_of(batches)
        for first in every:
            names.append(f"{folder}/pages-{part:07d}-{len(names):04d}.warc.gz")
            with atomic_output(names[-1]) as f:
                z, size = zlib.compressobj(6, zlib.DEFLATED, 31), 0
                for row in chain([first], every):
                    data = record_bytes(*row)
                    f.write(z.compress(data))
                    size += len(data)
                    if size >= ARCHIVE_BYTES:
                        break
                f.write(z.flush())
        yield pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string())})

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "response_id"))):
                yield tuple(x.as_py() for x in row)

    return sorted(r.path for r in pages.mapInArrow(run, "path string").collect())


def archive_pages(pages: DataFrame, folder: str | None = None) -> list[str]:
    """Writes ``pages`` (page_id, url, html) as monolithic archives and normalises them; the names of the normalised files.

    A null html is an empty payload; a null url becomes a urn; of rows with the
    smallest page_id of a payload each is a response, a null page_id never is one
    that others refer to. Extra columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or work_dir(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    equal_payloads(rows.select("page_id", "digest", "size")).write.parquet(f"{folder}/equal")
    rows = with_responses(rows, spark.read.schema("digest string, response_id long, n long").parquet(f"{folder}/equal"))
    rows = rows.withColumn("response_id", F.when((F.col("size") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id")))
    sources = write_monolithic(rows.select("page_id", "url", "payload", "digest", "response_id"), folder)
    targets = [s.replace("/pages-", "/records-") for s in sources]

    def run(entry):
        yield pa.RecordBatch.from_pydict({"n": pa.array([normalise(*entry)], pa.int64())})

    over_files(spark, list(zip(sources, targets)), run, "n long").collect()
    return targets


def read_archives(spark, paths: list[str]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record; payloads of responses are checked."""
    names = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def number(value: str | None) -> int | None:
        return None if value is None else int(value)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), names.values())], names=list(names))

    def run(path):
        rows = []
        for r in read_records(path):
            h = r.headers
            size, digest = int(h["page-payload-length"]), h["warc-payload-digest"].removeprefix("sha256:")
            if h["warc-type"] == "response":
                size = len(r.payload)
                if hashlib.sha256(r.payload).hexdigest() != digest:
                    raise ValueError("a payload does not match its digest")
            rows.append((number(h.get("page-id")), size, digest, h["warc-type"], number(h.get("page-refers-to"))))
            if len(rows) == 5000:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    return over_files(spark, paths, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
