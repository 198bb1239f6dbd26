"""A Bloom filter of 64-bit keys: built in tasks by segments, of a size with a fixed bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import U64, mix

PROBES = 3
BITS_PER_KEY = 16
#: Bits of a segment, and of a whole filter at most (32 MB): beyond its capacity it lets more keys pass.
SEGMENT = 1 << 20
MOST_BITS = 1 << 28


class Bloom:
    """Holds every key that it was built from, and few others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, U64(64 - (8 * len(bits)).bit_length() + 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for at in _probes(keys, self.shift):
            at = at.astype(np.int64)
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _probes(keys: np.ndarray, shift: np.uint64) -> Iterator[np.ndarray]:
    first, step = mix(keys), mix(keys ^ U64(0xD6E8FEB86659FD93)) | U64(1)
    for _ in range(PROBES):
        yield first >> shift
        first = first + step


def bloom_of(packed: DataFrame) -> Bloom:
    """Filter of the little-endian 64-bit keys in the binary column ``keys``.

    Tasks deal the bits out by segment, and a segment's bits are set in one task;
    the driver gets the segments, 32 MB at most.
    """
    n = packed.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0] // 8
    size = min(MOST_BITS, max(SEGMENT, 1 << max(0, n * BITS_PER_KEY - 1).bit_length()))
    shift = U64(64 - size.bit_length() + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys in batch.column(0):
                at = np.sort(np.concatenate(list(_probes(np.frombuffer(keys.as_buffer(), dtype=U64), shift))).astype(np.uint32))
                cuts = np.flatnonzero(np.diff(at // SEGMENT)) + 1
                parts = [p for p in np.split(at, cuts) if len(p)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(p[0]) // SEGMENT for p in parts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["segment", "at"]
                )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, segment = None, None
        for batch in batches:
            for own, at in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own != segment:
                    if segment is not None:
                        yield _segment(segment, bits)
                    bits, segment = np.zeros(SEGMENT, dtype=bool), own
                bits[np.frombuffer(at.as_buffer(), dtype=np.uint32) % SEGMENT] = True
        if segment is not None:
            yield _segment(segment, bits)

    dealt = packed.select("keys").mapInArrow(deal, "segment int, at binary").repartition("segment").sortWithinPartitions("segment")
    bits = np.zeros(size // 8, dtype=np.uint8)
    for row in dealt.mapInArrow(gather, "segment int, bits binary").toLocalIterator():
        bits[row["segment"] * SEGMENT // 8 :][: SEGMENT // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return Bloom(bits)


def _segment(segment: int, bits: np.ndarray) -> pa.RecordBatch:
    packed = np.packbits(bits, bitorder="little").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([packed], pa.binary())], ["segment", "bits"])
