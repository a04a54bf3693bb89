"""Deterministic sharded WARC archives.

Records are range-sorted by page_id, so the order of the archives is that of the pages whatever the input's order. Each
task writes its range as gzip members, one for each record, and rolls to the next file when the compressed size reaches
its limit. A file is written under a temporary name of its attempt and renamed when it is whole; the manifest, written last, names the
files that count, so what a lost or doubled attempt leaves behind is never read. Headers (ids, digests, lengths) are made
anew from the payloads and are the same in each run.

Of records with equal payloads the one with the smallest page_id is a response; the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.words import record_batch
from samewise.session import shared_dir

ROLL_BYTES = 64 << 20
#: Payload bytes of a batch of records that were read.
BATCH_BYTES = 8 << 20
#: Most tasks that read files; beyond it a task reads several, one after another.
FILE_TASKS = 1 << 16
#: A payload of more than this share (one in so many) of all pages is frequent.
FREQUENT = 100_000
LEVEL = 4
VERSION = b"WARC/1.1"
# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None, first_url: str | None) -> bytes:
    """One record. first_id: the response's page_id if this one is a revisit."""
    digest = base32_sha1(payload)
    head = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    revisit = first_id is not None
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, url)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first_id, first_url)), ("X-Refers-To-Page", str(first_id))]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + lines + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_files(folder: str, roll_bytes: int):
    """For mapInArrow over sorted rows (page_id, url, key, kind, payload, first_id, first_url): writes files, gives the manifest's rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        made: list[tuple[str, int, int]] = []
        out, size, rows = io.BytesIO(), 0, 0
        note: tuple | None = None  # which page is a revisit, and of what

        def close() -> None:
            nonlocal out, size, rows
            name = f"part-{task:06d}-{len(made):05d}.warc.gz"
            with store.open_output_stream(f"{path}/.{name}.{attempt}") as file:
                file.write(out.getvalue())
            store.move(f"{path}/.{name}.{attempt}", f"{path}/{name}")
            made.append((name, rows, size))
            out, size, rows = io.BytesIO(), 0, 0

        info = member(VERSION + b"\r\nWARC-Type: warcinfo\r\nWARC-Date: " + DATE.encode() + b"\r\nWARC-Record-ID: " + record_id(-1 - task, "info").encode() + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
        for b in batches:
            for page_id, url, key, kind, payload, first_id, first_url in zip(*(b[c].to_pylist() for c in ("page_id", "url", "key", "kind", "payload", "first_id", "first_url")), strict=True):
                if kind == 0:
                    note = ((page_id, url, key), first_id, first_url)
                    continue
                first_id, first_url = note[1:] if note and note[0] == (page_id, url, key) else (None, None)
                data = member(record(page_id, url, payload, first_id, first_url))
                if size and size + len(data) > roll_bytes:
                    close()
                if not size:
                    size = out.write(info)
                size += out.write(data)
                rows += 1
        if size:
            close()
        yield record_batch(["name", "records", "bytes"], [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))])

    return work


def _steps(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    for at in range(0, len(data), step):
        yield data[at : at + step]


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a file that comes in chunks, unpacked."""
    unpack, parts = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            parts.append(unpack.decompress(chunk))
            chunk = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("a member is cut off")


def records(data: bytes | Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record in a file of gzip members, whole or in chunks, or of plain records."""
    chunks = _steps(data) if isinstance(data, bytes) else iter(data)
    first = next(chunks, b"")
    chunks = itertools.chain([first], chunks)
    for body in members(chunks) if first[:2] == b"\x1f\x8b" else [b"".join(chunks)]:
        at = 0
        while body.startswith(b"WARC/", at):
            end = body.index(b"\r\n\r\n", at)
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in body[at:end].decode("utf-8", "replace").split("\r\n")[1:])
            n = int(fields["Content-Length"])
            yield fields, body[end + 4 : end + 4 + n]
            at = end + 4 + n + 4


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _checked(data: bytes | Iterator[bytes], payloads: bool) -> Iterator[pa.RecordBatch]:
    """A file's records in batches of bounded size. Digests of responses are computed from what was read, and each block is held against its digest."""
    rows, size = [], 0
    for fields, block in records(data):
        if fields["WARC-Type"] not in ("response", "revisit"):
            continue
        if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"block digest of {fields['WARC-Record-ID']} doesn't hold")
        page = int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None
        if fields["WARC-Type"] == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            rows.append((page, len(payload), base32_sha1(payload), "response", None, payload if payloads else None))
            size += len(payload) if payloads else 0
        else:
            rows.append((page, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", int(fields["X-Refers-To-Page"]), None))
        if len(rows) >= 2000 or size > BATCH_BYTES:
            yield _batch(rows)
            rows, size = [], 0
    yield _batch(rows)


def read_archives(df: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows of binary files (content) as records: page_id, payload_bytes, payload_digest, record_type, refers_to and the response's payload (null unless payloads)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for value in b["content"]:
                yield from _checked(value.as_py(), payloads)

    return df.select("content").mapInArrow(work, RECORDS)


def read_manifest(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the files that a manifest names, as read_archives gives them: tasks open their files and read them in chunks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b["name"].to_pylist():
                with store.open_input_stream(f"{path}/{name}", compression=None) as file:
                    yield from _checked(iter(lambda: file.read(1 << 20), b""), payloads)

    files = manifest.select("name").repartition(max(1, min(manifest.count(), FILE_TASKS)), "name")
    return files.mapInArrow(work, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return record_batch(["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"], [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)])


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, roll_bytes: int = ROLL_BYTES, files: int | None = None) -> tuple[DataFrame, str]:
    """Writes pages (page_id, url, html) and returns the manifest (name, records, bytes) and the folder's URI.

    Payloads of fewer than least_bytes are always responses. Pages without page_id are responses, after all others' records of their payload never refer
    to them. Of rows with one page_id and one payload the first by url is the response, the others revisit it.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/samewise/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("key", F.sha1("payload"))
    named = rows.where("page_id is not null").where(F.octet_length("payload") >= least_bytes)
    most = max(1000, pages.count() // FREQUENT)
    first = named.groupBy("key").agg(F.min(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"))).alias("first"), F.count("*").alias("n")).where("n > 1")
    # the first pages of payloads of very many pages (FREQUENT at most) are broadcast, so that no task gets all pages of one
    hot = F.broadcast(first.where(F.col("n") > most).select("key", F.col("first").alias("hot")))
    # payloads are shuffled once, by range; a note that a page is a revisit, without payload, stands before its page
    again = (F.col("page_id") > F.col("first.page_id")) | (F.coalesce("url", F.lit("")) > F.col("first.url"))
    found = named.select("page_id", "url", "key").distinct().join(hot, "key", "left")
    rest = found.where("hot is null").drop("hot").join(first.where(F.col("n") <= most).select("key", "first"), "key")
    notes = rest.unionByName(found.where("hot is not null").withColumnRenamed("hot", "first")).where(again).select("page_id", "url", "key", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("payload"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    ready = rows.select("page_id", "url", "key", F.lit(1).alias("kind"), "payload", F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("string").alias("first_url")).unionByName(notes)
    sorted_rows = (ready.repartitionByRange(files, "page_id") if files else ready.repartitionByRange("page_id")).sortWithinPartitions("page_id", "url", "key", "kind")
    manifest = sorted_rows.mapInArrow(write_files(folder, roll_bytes), "name string, records long, bytes long")
    manifest.write.mode("overwrite").parquet(f"{folder}/_manifest")
    return spark.read.schema("name string, records long, bytes long").parquet(f"{folder}/_manifest"), folder


def warc_roundtrip(pages: DataFrame, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes pages to archives, reads the archives back and gives each record without its payload.

    A row for each row of pages (page_id, url, html; further columns don't matter). A null html is an empty payload. Rows without page_id are
    responses that none refers to; of rows with one page_id and one payload the first by url is the response. An empty table gives an empty
    result. Records of any size are whole, in a file of their own if they are longer than roll_bytes.
    """
    manifest, folder = write_archives(pages, roll_bytes=roll_bytes)
    return read_manifest(manifest, folder, payloads=False).drop("payload")
