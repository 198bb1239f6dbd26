"""Vectorised views of a batch of texts as bytes: words, hashes and byte n-grams.

Everything here works on one Arrow batch inside a task. A batch is cut into
slices of whole texts (:func:`slices`), so memory follows the longest text and
not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Never part of UTF-8, so free to mark the start and the end of a text.
PAD = 0xFF

U64 = np.uint64
MASK = (1 << 64) - 1
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: False for the bytes that continue a code point.
LEADS = (np.arange(256) & 0xC0) != 0x80


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * _BASE)
_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers 0..n (mod 2^64), kept for the next slice."""
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` takes the hash of any span."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE_CODES[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; equal bytes have equal hashes, wherever they stand."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and their n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(large)
    if column.null_count:
        column = column.fill_null(b"" if large == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, bounds, values = column.buffers()
    offsets = np.frombuffer(bounds, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    data: np.ndarray, offsets: np.ndarray, size: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)`` of runs of whole texts of about ``size``."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values[at[i]:at[i + 1]]``; 0 for an empty run."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the first word of each text (n + 1)."""
    inside = ~SPACE[data]
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = False
    after[edge - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def word_shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and the first one of each text (n + 1).

    A text of 1 to k - 1 words has its whole sequence as one shingle.
    """
    count = np.diff(first)
    runs = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.zeros(len(first), dtype=np.int64)
    np.cumsum(runs, out=at[1:])
    own = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], runs)
    length = np.repeat(np.minimum(count, k), runs)
    padded = np.concatenate([hashes, np.zeros(k, dtype=U64)])
    out = mix(length.astype(U64))
    for j in range(k):
        term = mix(padded[own + j] + U64((j + 1) * int(_BASE) & MASK))
        out += np.where(length > j, term, U64(0)) * U64(2 * j + 3)
    return mix(out), at


def distinct_per_text(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each text in ascending order, how often each occurs, and their offsets."""
    values = values.copy()
    new = np.ones(len(values), dtype=bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        values[a:b].sort()
    new[1:] = values[1:] != values[:-1]
    new[at[:-1][at[:-1] < len(values)]] = True
    where = np.flatnonzero(new)
    times = np.diff(np.append(where, len(values)))
    return values[where], times, np.searchsorted(where, at)


def byte_ngrams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Big-endian keys of ``order`` bytes, one for each byte of a text and one for its end.

    A text is preceded by ``order - 1`` pads and followed by one, so that its
    n-grams depend on nothing else. Returns keys and their n + 1 offsets.
    """
    lead = order - 1
    sizes = np.diff(offsets)
    at = offsets + np.arange(len(offsets)) * (lead + 1)
    padded = np.full(at[-1] + 8, PAD, dtype=np.uint8)
    padded[np.arange(len(data)) + np.repeat((np.arange(len(sizes)) + 1) * (lead + 1) - 1, sizes)] = data
    window = np.ndarray((at[-1],), dtype=">u8", buffer=padded, strides=(1,))
    keys = window.astype(U64) >> U64(64 - 8 * order)
    keep = np.ones(at[-1], dtype=bool)
    for j in range(lead):
        keep[at[1:] - 1 - j] = False  # these windows reach into the next text
    return keys[keep], offsets + np.arange(len(offsets))


def count_keys(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sum of their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    where = np.flatnonzero(new)
    if counts is None:
        return keys[where], np.diff(np.append(where, len(keys)))
    return keys[where], np.add.reduceat(counts, where) if len(where) else counts


class KeyCounter:
    """Counts of keys within a task, merged as they come; memory follows the distinct keys of a flush."""

    def __init__(self, limit: int = 1 << 22):
        self.parts, self.size, self.limit = [], 0, limit

    def add(self, keys: np.ndarray) -> None:
        part = count_keys(keys)
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > self.limit and len(self.parts) > 1:
            self.merge()

    def merge(self) -> None:
        if self.parts:
            keys, counts = (np.concatenate(x) for x in zip(*self.parts))
            self.parts = [count_keys(keys, counts)]
            self.size = len(self.parts[0][0])

    def full(self) -> bool:
        return len(self.parts) == 1 and self.size > self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.parts[0] if self.parts else (np.zeros(0, U64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return out


class HashArray:
    """Values by 64-bit key in arrays sorted by hash, with an index on the leading bits."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        hashes = mix(keys)
        order = np.argsort(hashes)
        if len(order) < 1 << 31:
            order = order.astype(np.int32)
        self.values = [v[order] for v in values]
        self.hashes = np.take(hashes, order)
        del hashes, order
        self.bits = max(1, int(len(keys) - 1).bit_length() if len(keys) > 1 else 1)
        counts = np.bincount((self.hashes >> U64(64 - self.bits)).astype(np.int64), minlength=1 << self.bits)
        self.first = np.zeros((1 << self.bits) + 1, dtype=np.int32 if len(keys) < 1 << 31 else np.int64)
        np.cumsum(counts, out=self.first[1:])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        hashes = mix(keys)
        slot = (hashes >> U64(64 - self.bits)).astype(np.int64)
        place = self.first[slot].astype(np.int64)
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.hashes):
            return out
        end = self.first[slot + 1]
        todo = np.flatnonzero(place < end)
        place, end, hashes = place[todo], end[todo], hashes[todo]
        while len(todo):
            here = self.hashes[place]
            hit = here == hashes
            out[todo[hit]] = place[hit]
            on = (here < hashes) & (place + 1 < end)
            todo, place, end, hashes = todo[on], place[on] + 1, end[on], hashes[on]
        return out
