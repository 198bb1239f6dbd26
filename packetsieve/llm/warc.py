"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: pages become ``response`` records, or ``revisit`` records that point
to the page of equal payload with the largest ``page_id``. Each task writes
archives of up to ``ARCHIVE_BYTES`` of records. An archive's dictionary is
trained on its own first records; it changes the size only. It stands in a
skippable frame (magic 0x184D2A5D) at the start, itself compressed.

Reading: a task takes whole archives, loads the dictionary, decodes frame by
frame and raises ``ValueError`` on a frame with no or more than one record, a
wrong version or header line, a missing or wrong length, or a payload that
does not have its digest.

Defined cases: a null html is an empty payload; a null url has no target line;
a null ``page_id`` is smaller than all others and is read back as null; rows
that share the largest ``page_id`` of a payload are all responses; an empty
table writes no archive and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .storage import dealt, get, partition, put
from .tables import written

VERSION = b"WARC/1.1"
DICTIONARY_FRAME = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES = 32 << 20
#: Whole records of this many bytes together train an archive's dictionary.
TRAINING_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The time of capture, where the table has none.
DATE = b"1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record. A revisit keeps the HTTP headers, with the length of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    lines = [VERSION, b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <" + _urn(page_id) + b">", b"WARC-Date: " + DATE]
    if url is not None:
        safe = "".join(c if ord(c) > 0x20 and ord(c) != 0x7F else f"%{ord(c):02X}" for c in url)
        lines.append(b"WARC-Target-URI: " + safe.encode())
    lines.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    if refers_to is not None:
        lines += [b"WARC-Refers-To: <" + _urn(refers_to) + b">", b"WARC-Profile: " + PROFILE]
    lines += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(page_id: int | None) -> bytes:
    return b"urn:page:" + (b"none" if page_id is None else b"%d" % page_id)


def _page_of(urn: bytes) -> int | None:
    if not urn.startswith(b"<urn:page:") or not urn.endswith(b">"):
        raise ValueError(f"not a page's id: {urn!r}")
    name = urn[10:-1]
    return None if name == b"none" else int(name)


def _lines(head: bytes) -> dict[bytes, bytes]:
    out: dict[bytes, bytes] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name.lower() in out:
            raise ValueError(f"bad header line: {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def _length(headers: dict[bytes, bytes]) -> int:
    value = headers.get(b"content-length", b"")
    if not value.isdigit():
        raise ValueError("missing or bad Content-Length")
    return int(value)


def parse(raw: bytes) -> dict:
    """The fields of one record, after validation."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    version, _, head = head.partition(b"\r\n")
    if version != VERSION or not blank:
        raise ValueError("not a WARC/1.1 record")
    headers = _lines(head)
    size = _length(headers)
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the block does not have its length")
    kind = headers.get(b"warc-type")
    if kind not in (b"response", b"revisit") or b"warc-record-id" not in headers or b"warc-date" not in headers:
        raise ValueError("a mandatory header is missing or unknown")
    http, blank, payload = rest[:size].partition(b"\r\n\r\n")
    status, _, http = http.partition(b"\r\n")
    if not blank or not status.startswith(b"HTTP/"):
        raise ValueError("the block is no HTTP response")
    full = _length(_lines(http))
    named = headers.get(b"warc-payload-digest", b"").decode()
    if kind == b"response":
        if full != len(payload):
            raise ValueError("the payload does not have its length")
        if named != "sha1:" + digest_of(payload):
            raise ValueError("the payload does not have its digest")
    elif payload or b"warc-refers-to" not in headers or not named.startswith("sha1:"):
        raise ValueError("a revisit needs a digest and a reference, and no payload")
    url = headers.get(b"warc-target-uri")
    return {
        "page_id": _page_of(headers[b"warc-record-id"]),
        "url": None if url is None else url.decode(),
        "payload_bytes": full,
        "payload_digest": named[5:],
        "record_type": kind.decode(),
        "refers_to": _page_of(headers[b"warc-refers-to"]) if kind == b"revisit" else None,
        "payload": payload if kind == b"response" else None,
    }


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pack_archive(records: list[bytes]) -> bytes:
    samples, held = [], 0
    for r in records:
        if held + len(r) <= TRAINING_BYTES:
            samples.append(r)
            held += len(r)
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
    except zstandard.ZstdError:  # too few records to learn from
        trained = None
    out = []
    if trained is not None:
        packed = zstandard.ZstdCompressor().compress(trained.as_bytes())
        out.append(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
    out += [compressor.compress(r) for r in records]
    return b"".join(out)


def unpack_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one for each frame."""
    view, at, trained = memoryview(content), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", view, 4)[0]
        raw = bytes(view[8 : 8 + size])
        if len(raw) != size:
            raise ValueError("the dictionary frame is cut short")
        trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME else raw)
        at = 8 + size
    decompressor = zstandard.ZstdDecompressor(dict_data=trained)
    while at < len(view):
        if view[at : at + 4] != FRAME:
            raise ValueError("not a Zstandard frame")
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            chunk = view[at : at + (1 << 15)]
            if not len(chunk):
                raise ValueError("the last frame is cut short")
            try:
                parts.append(frame.decompress(chunk))
            except zstandard.ZstdError as e:
                raise ValueError(f"damaged frame: {e}") from e
            at += len(chunk)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (``page_id``, ``url``, ``html``); returns the written list of archives."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    kinds = rows.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    several = written(kinds.where((F.col("n") > 1) & F.col("largest").isNotNull()).select(F.col("digest").alias("_digest"), "largest"), "warc-heads")
    first = F.col("page_id").eqNullSafe(F.col("largest"))
    linked = rows.join(several, F.col("digest") == F.col("_digest"), "left").select(
        "page_id", "url", "html", "digest", F.when(~first, F.col("largest")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, text, digest, refers_to = (batch.column(i)[row].as_py() for i in range(5))
                held.append(record(page_id, url, text.encode(), base64.b32encode(bytes.fromhex(digest)).decode(), refers_to))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield flush(held, number)

    def flush(held: list[bytes], number: int) -> pa.RecordBatch:
        name = put(folder, f"pages-{partition():06d}-{number:04d}.warc.zst", pack_archive(held))
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)])], ["name", "n_records"])

    return written(linked.mapInArrow(write, "name string, n_records long"), "warc-list")


FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """One row per record of the listed archives; with ``payload``, also the payload (null for revisits)."""
    schema = FIELDS + ", payload binary" * payload
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64() if "long" in f else pa.binary() if "binary" in f else pa.string() for f in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                for raw in unpack_archive(get(folder, name)):
                    rows.append(parse(raw))
                    size += len(raw) if payload else 64
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

    return dealt(archives.select("name"), "name").mapInArrow(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read their records back."""
    folder = scratch_path(pages.sparkSession, "warc")
    archives = write_archives(pages, folder)
    if not archives.limit(1).count():
        return pages.sparkSession.createDataFrame([], FIELDS)
    return read_archives(archives, folder)
