"""Token ids in binary files: static range asymmetric numeral system over interleaved blocks.

One table of frequencies, counted over all documents, serves all files. A file
holds the document ids and lengths in ascending ``doc_id`` order and the ids in
independent blocks. In a block, token t belongs to lane t mod ``LANES``; the
lanes share one stream of 32-bit words. Every ``INTERVAL`` steps the block keeps
a checkpoint (the lanes' states and the place in the stream), so a reader
starts at any checkpoint and decodes all of them side by side. Each block has a
CRC-32 of its stream.

File: magic, header length, zlib-compressed header, then the blocks' streams.
The header has the doc ids and lengths, and of each block the number of ids,
words, checksum and checkpoints.

Defined cases: a null text is empty and holds only the end id; null doc ids
come first; equal doc ids are ordered by a hash of their text; an empty table
writes no file and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .storage import dealt, get, partition, put
from .tables import written
from .textbytes import slices, text_bytes
from .unit_tokens import UnitTokenizer, encoded_units

MAGIC = b"RANSTOK1"
LANES, INTERVAL, BLOCK = 32, 256, 1 << 16
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
FILE_TOKENS = 1 << 20
#: Files that a task writes or reads: it first loads what all files share.
TASK_FILES = 4
_32 = np.uint64(32)


class Frequencies:
    """Counts scaled to a sum of 2^SCALE_BITS, at least 1 for each id that occurs."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(ids)
        ids, counts = ids[order].astype(np.int64), counts[order].astype(np.float64)
        size = 1 << SCALE_BITS
        if len(ids) > size:
            raise ValueError("more distinct ids than the frequency scale has room for")
        spare = size - len(ids)
        share = counts / counts.sum() * spare if len(ids) else counts
        scaled = np.floor(share).astype(np.int64)
        missing = spare - scaled.sum()
        scaled[np.argsort(scaled - share, kind="stable")[:missing]] += 1
        scaled += 1
        self.symbols = ids
        self.freq = scaled.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(scaled)[:-1]]).astype(np.uint64) if len(ids) else self.freq
        self.rank = np.zeros(int(ids[-1]) + 1 if len(ids) else 0, dtype=np.int32)
        self.rank[ids] = np.arange(len(ids))
        self.slots = np.repeat(np.arange(len(ids), dtype=np.uint32), scaled)


def encode_blocks(ids: np.ndarray, table: Frequencies) -> tuple[list[dict], list[bytes]]:
    """Header entries and streams of the blocks of ``ids``, all blocks coded side by side."""
    if not len(ids):
        return [], []
    n_blocks = -(-len(ids) // BLOCK)
    sizes = np.full(n_blocks, BLOCK)
    sizes[-1] = len(ids) - BLOCK * (n_blocks - 1)
    unit = LANES * INTERVAL
    steps = -(-int(sizes.max()) // unit) * INTERVAL
    ranks = np.full((n_blocks, steps * LANES), int(np.argmax(table.freq)), dtype=np.int32)
    for b in range(n_blocks):
        ranks[b, : sizes[b]] = table.rank[ids[b * BLOCK : b * BLOCK + sizes[b]]]
    ranks = ranks.reshape(n_blocks, steps, LANES)
    state = np.full((n_blocks, LANES), LOW, dtype=np.uint64)
    words = np.zeros((n_blocks, steps, LANES), dtype=np.uint32)
    emitted = np.zeros((n_blocks, steps, LANES), dtype=bool)
    points = np.zeros((n_blocks, steps // INTERVAL, LANES), dtype=np.uint64)
    top, bits = (LOW >> np.uint64(SCALE_BITS)) << _32, np.uint64(SCALE_BITS)
    for s in range(steps - 1, -1, -1):
        rank = ranks[:, s]
        f = table.freq[rank]
        full = state >= top * f
        emitted[:, s] = full
        words[:, s] = state  # the low 32 bits
        state = np.where(full, state >> _32, state)
        div = state // f
        state = (div << bits) + (state - div * f) + table.start[rank]
        if s % INTERVAL == 0:
            points[:, s // INTERVAL] = state
    heads, streams = [], []
    for b in range(n_blocks):
        live = -(-int(sizes[b]) // unit)  # intervals that hold ids
        mask = emitted[b, : live * INTERVAL]
        per_step = mask.sum(axis=1)
        places = np.concatenate([[0], np.cumsum(per_step)])[: live * INTERVAL : INTERVAL]
        stream = words[b, : live * INTERVAL][mask].astype("<u4").tobytes()
        streams.append(stream)
        heads.append({"n": int(sizes[b]), "crc": zlib.crc32(stream), "words": len(stream) // 4, "states": points[b, :live], "places": places})
    return heads, streams


def decode_segments(stream: np.ndarray, states: np.ndarray, places: np.ndarray, table: Frequencies) -> np.ndarray:
    """Ids of all intervals that start at the given checkpoints, in order: intervals x steps x lanes."""
    state, place = states.copy(), places.astype(np.int64).copy()
    out = np.empty((len(states), INTERVAL, LANES), dtype=np.uint32)
    mask, bits = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    stream = np.append(stream, np.zeros(LANES, dtype=np.uint32)).astype(np.uint64)
    for s in range(INTERVAL):
        slot = state & mask
        rank = table.slots[slot]
        out[:, s] = rank
        state = table.freq[rank] * (state >> bits) + slot - table.start[rank]
        low = state < LOW
        at = np.cumsum(low, axis=1)
        word = stream[np.minimum(place[:, None] + at - 1, len(stream) - 1)]
        state = np.where(low, (state << _32) | word, state)
        place += at[:, -1]
    return table.symbols[out]


def pack_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, table: Frequencies) -> bytes:
    heads, streams = encode_blocks(ids, table)
    header = io.BytesIO()
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    np.save(header, np.array([d or 0 for d in doc_ids], dtype="<i8"))
    np.save(header, known)
    np.save(header, lengths.astype("<i8"))
    np.save(header, np.array([(h["n"], h["words"], h["crc"], len(h["places"])) for h in heads], dtype="<i8").reshape(-1, 4))
    empty = np.zeros((0, LANES), dtype="<u8")
    np.save(header, np.concatenate([empty, *[h["states"] for h in heads]]).astype("<u8"))
    np.save(header, np.concatenate([np.zeros(0, "<i8"), *[h["places"] for h in heads]]).astype("<i8"))
    packed = zlib.compress(header.getvalue(), 1)
    return b"".join([MAGIC, struct.pack("<II", len(packed), zlib.crc32(packed)), packed, *streams])


def unpack_file(content: bytes, table: Frequencies) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Doc ids, their numbers of ids, and all ids. A damaged file raises ``ValueError``."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    size, crc = struct.unpack_from("<II", content, 8)
    packed = content[16 : 16 + size]
    if len(packed) != size or zlib.crc32(packed) != crc:
        raise ValueError("damaged header")
    header = io.BytesIO(zlib.decompress(packed))
    doc_ids, known, lengths, blocks, states, places = (np.load(header) for _ in range(6))
    body = memoryview(content)[16 + size :]
    if len(body) != 4 * int(blocks[:, 1].sum()):
        raise ValueError("wrong length")
    at = 0
    base = np.zeros(len(blocks), dtype=np.int64)
    for b, (_, n_words, crc, _) in enumerate(blocks.tolist()):
        if zlib.crc32(body[4 * at : 4 * (at + n_words)]) != crc:
            raise ValueError(f"damaged block {b}")
        base[b] = at
        at += n_words
    ids = np.zeros(0, dtype=np.int64)
    if len(blocks):
        stream = np.frombuffer(body, dtype="<u4")
        flat = decode_segments(stream, states, places + np.repeat(base, blocks[:, 3]), table).reshape(len(states), -1)
        ends = np.cumsum(blocks[:, 3])
        ids = np.concatenate([flat[e - k : e].ravel()[:n] for (n, _, _, k), e in zip(blocks.tolist(), ends.tolist())])
    names = [d if k else None for d, k in zip(doc_ids.tolist(), known.tolist())]
    return names, lengths, ids


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> tuple[DataFrame, Frequencies]:
    """Write all ``docs`` (``doc_id``, ``text``); returns the written list of files and the shared table.

    The list has ``part``, ``file``, ``name`` and ``n_tokens``, in the order of the ids.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    units = encoded_units(rows, tokenizer)
    n_docs = rows.count()
    counted = units.select("n", F.explode("ids").alias("id")).groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, counts = counted.column("id").to_numpy(), counted.column("n").to_numpy().copy()
    if n_docs:
        here = ids == end_id
        counts = np.where(here, counts + n_docs, counts)
        if not here.any():
            ids, counts = np.append(ids, end_id), np.append(counts, n_docs)
    table = Frequencies(ids, counts)
    total = int(counts.sum())
    shared = spark.sparkContext.broadcast(table)
    tokens = UnitTokenizer(tokenizer, spark, units)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[int | None] = []
        lengths: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held, number = 0, 0
        for batch in batches:
            for a, b, data, offsets in slices(*text_bytes(batch.column(1))):
                flat, at = tokens.encode(data, offsets)
                flat = np.insert(flat, at[1:], end_id)
                names += batch.column(0).slice(a, b - a).to_pylist()
                lengths.append(np.diff(at) + 1)
                parts.append(flat)
                held += len(flat)
                if held >= 2 * FILE_TOKENS:
                    yield flush(number, names, lengths, parts)
                    names, lengths, parts, held, number = [], [], [], 0, number + 1
        if names:
            yield flush(number, names, lengths, parts)

    def flush(number, names, lengths, parts) -> pa.RecordBatch:
        ids = np.concatenate(parts)
        name = put(folder, f"part-{partition():06d}-{number:04d}", pack_file(names, np.concatenate(lengths), ids, shared.value))
        columns = [pa.array([x]) for x in (partition(), number, name, len(ids))]
        return pa.RecordBatch.from_arrays(columns, ["part", "file", "name", "n_tokens"])

    ordered = rows.repartitionByRange(max(1, -(-total // (TASK_FILES * FILE_TOKENS))), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return written(ordered.mapInArrow(write, "part long, file long, name string, n_tokens long"), "rans-files"), table


def read_token_files(files: DataFrame, folder: str, table: Frequencies) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of each document, decoded from the files."""
    spark = files.sparkSession
    shared = spark.sparkContext.broadcast(table)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                names, lengths, ids = unpack_file(get(folder, name), shared.value)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                columns = [pa.array([name] * len(names), pa.string()), pa.array(names, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["name", "doc_id", "within", "n_tokens", "ids_crc32"])

    # one row per file: its offset is the sum of the files before it
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select(F.col("name").alias("_name"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    decoded = dealt(files.select("name"), "name", each=TASK_FILES).mapInArrow(read, "name string, doc_id long, within long, n_tokens long, ids_crc32 long")
    return decoded.join(bases, F.col("name") == F.col("_name")).select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "rans")
    files, table = write_token_files(docs, folder, tokenizer, end_id)
    if not files.limit(1).count():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(files, folder, table)
