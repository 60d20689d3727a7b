"""WARC archives with a Zstandard dictionary of their own.

Each task writes archives of bounded size. The records of an archive are gathered first (at most ``archive_bytes``);
a dictionary is trained on records spread over it, and the archive begins with a skippable frame that holds that
dictionary, followed by one Zstandard frame for each record, so that a record can be read by its offset alone
(the layout of the public ".warc.zst" specification). Payloads that other records have too are stored once:
the record with the largest id is the response, the others revisit it.

An archive's file is named by its attempt and becomes visible under its name only when whole; the manifest lists the
files of the attempts that Spark has accepted, and only those are read. A lost executor leaves unlisted files at most.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import broadcast_if_small, materialized, need, shared_path, tuned

#: Fixed values of the formats.
SKIPPABLE_MAGIC, FRAME_MAGIC, DICTIONARY_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records bigint, n_bytes bigint"
#: Unknown capture time.
NO_DATE = "1970-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 1000


def _local(path: str) -> str | None:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:") if path.startswith("file:/") else path if "://" not in path else None


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_file(path: str, parts: Iterator[bytes]) -> int:
    """Writes ``parts`` to a shared path; the file has its name only when it is complete. Gives its size."""
    n = 0
    if (local := _local(path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(f"{local}.partial", "wb") as out:
            for part in parts:
                n += out.write(part)
        os.replace(f"{local}.partial", local)
        return n
    store, inside = _store(path)
    with store.open_output_stream(f"{inside}.partial") as out:
        for part in parts:
            out.write(part)
            n += len(part)
    store.move(f"{inside}.partial", inside)
    return n


def open_file(path: str) -> BinaryIO:
    if (local := _local(path)) is not None:
        return open(local, "rb")
    store, inside = _store(path)
    return store.open_input_stream(inside)


def _plain(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = NO_DATE) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head, whose Content-Length is that of the full payload, without the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    named = f"urn:x-page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{named}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_plain(url)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info() -> bytes:
    block = b"software: lodestone\r\nformat: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {NO_DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def trained(records: list[bytes], dictionary_bytes: int, sample_bytes: int):
    """A dictionary from records spread evenly over the archive; their bytes as they are where too few can be trained on."""
    import zstandard

    step = max(1, sum(map(len, records)) // sample_bytes)
    samples = [r[: dictionary_bytes * 2] for r in records[::step]]
    try:
        return zstandard.train_dictionary(dictionary_bytes, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-dictionary_bytes:] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], dictionary_bytes: int = 1 << 15, sample_bytes: int = 1 << 20, level: int = 3) -> Iterator[bytes]:
    """An archive's bytes: the dictionary's frame, then a frame for each record."""
    import zstandard

    dictionary = trained(records, dictionary_bytes, sample_bytes)
    raw = dictionary.as_bytes()
    yield struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw
    packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary)
    for x in [_info(), *records]:
        yield packer.compress(x)


def frames(source: BinaryIO, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary")
    raw = source.read(size)
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    whole = raw[:4] == struct.pack("<I", DICTIONARY_MAGIC)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if whole else zstandard.DICT_TYPE_RAWCONTENT))
    rest = b""
    while rest := rest or source.read(chunk):
        one, out = unpacker.decompressobj(), []
        while True:
            out.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            if not (rest := source.read(chunk)):
                raise ValueError("the archive ends within a record")
        yield b"".join(out)


def parsed(data: bytes) -> dict | None:
    """What a record says; None for records other than responses and revisits. A response's payload must match its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    if (kind := fields["WARC-Type"]) not in ("response", "revisit"):
        return None
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't match its digest")
    number = lambda x: int(x[len("<urn:x-page:") : -1]) if x and x.startswith("<urn:x-page:") else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest.hex(), "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        written: list[tuple[str, int, int]] = []
        gathered: list[bytes] = []

        def close() -> None:
            if gathered:
                path = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(written):04d}.warc.zst"
                written.append((path, len(gathered), write_file(path, archive(gathered))))
                gathered.clear()

        size = 0
        for batch in batches:
            for page_id, url, html, response in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                gathered.append(record("response" if response is None else "revisit", page_id, url, html or b"", response))
                size += len(gathered[-1])
                if size >= archive_bytes:
                    close()
                    size = 0
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in written], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "n_records", "n_bytes"])

    return run


def revisits(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, digest, response) of the records whose payload a record with a larger id has too. No payload is shuffled."""
    keys = pages.select(F.col(id_col).alias("id"), digest(html_col).alias("digest"), F.octet_length(F.coalesce(html_col, F.lit(""))).alias("size")).where(F.col("size") >= MIN_REVISIT_BYTES)
    groups = keys.groupBy("digest", "size").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 and response is not null")
    return keys.join(groups, ["digest", "size"]).where("id is null or id <> response").select("id", "digest", "response").distinct()


def digest(html_col: str):
    return F.sha1(F.coalesce(html_col, F.lit("")).cast("binary"))


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes a record for each row and gives the manifest (path, n_records, n_bytes).

    Null payloads are empty ones; a null url has no target header; a null id gets a random record id and reads back as
    null. Rows with the same id and payload as the response of their group are responses too. An empty table
    writes no archive. folder: where archives go, the session's shared folder if not given.
    """
    spark = tuned(pages.sparkSession)
    folder = folder or shared_path(spark, "warc")
    rows = need(pages, id_col, url_col, html_col)
    again = broadcast_if_small(materialized(revisits(rows, id_col, html_col), "revisits"), 100_000)
    same = rows[id_col].eqNullSafe(again["id"]) & (digest(html_col) == again["digest"])
    typed = rows.join(again, same, "left").select(rows[id_col].cast("bigint"), rows[url_col].cast("string"), rows[html_col], again["response"].cast("bigint"))
    return materialized(typed.mapInArrow(_writer(folder, archive_bytes), MANIFEST), "manifest")


RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _reader(with_payload: bool, batch_rows: int = 200):
    schema = RECORDS if with_payload else RECORDS.remove(len(RECORDS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_file(path) as source:
                    for data in frames(source):
                        if (row := parsed(data)) is not None:
                            rows.append(row)
                        if len(rows) >= batch_rows:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The response and revisit records of the archives that a manifest lists; payload is null for revisits."""
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * with_payload
    n = max(1, manifest.count())
    return manifest.select("path").repartition(min(n, 4096)).mapInArrow(_reader(with_payload), schema)
