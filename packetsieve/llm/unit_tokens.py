"""Token ids of whole texts from the ids of their repeated units.

A unit is a run of bytes without ASCII white space, cut further between an
ASCII letter and an ASCII sign or digit, except at an apostrophe, ``<`` and
``|`` (they start contractions and special tokens). No token of the tokenizer
crosses such a cut, and its normaliser joins nothing over one, so a text's ids
are those of its units in order. Each distinct unit is encoded once by the
tokenizers library; texts are then gathers of ids by the hash of their units.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import written
from .textbytes import LOWER, SPACE, HashArray, prefix_hash, slices, span_hash, text_bytes

#: Encoded units that are broadcast (about 25 bytes each), the most frequent ones; tasks encode the others
#: and keep some of those.
HEAD_UNITS, KEPT_UNITS = 1 << 22, 1 << 17
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[0x21:0x7F] = 2
_KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = 1
_KIND[[ord("'"), ord("<"), ord("|")]] = 3
_KIND[SPACE] = 0


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units, and the first one of each text (n + 1)."""
    kind = _KIND[data]
    cut = np.zeros(len(data) + 1, dtype=bool)  # a boundary before this byte
    pair = kind[:-1] + (kind[1:] << np.uint8(2))
    cut[1:-1] = (pair == 9) | (pair == 6)  # letter then sign, sign then letter
    cut[offsets] = True
    inside = kind != 0
    start, end = inside.copy(), inside.copy()
    start[1:] &= cut[1:-1] | ~inside[:-1]
    end[:-1] &= cut[1:-1] | ~inside[1:]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A-Z as a-z, which the tokenizer's normaliser does as well, but for units with ``<`` (special tokens)."""
    out = LOWER[data]
    marks = np.flatnonzero(data == ord("<"))
    for i in np.unique(np.searchsorted(starts, marks, "right") - 1).tolist():
        out[starts[i] : ends[i]] = data[starts[i] : ends[i]]
    return out


def load(tokenizer: str):
    # tasks fill the cores already, and each thread would keep memory of its own
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


def encode_units(model, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]


class UnitCache:
    """Ids by unit hash within a Python worker: what was broadcast, and what tasks add.

    ``split(data, offsets)`` gives the units, ``encode_new(data, starts, ends)`` the
    numbers of ids of units not seen before, and those ids.
    """

    def __init__(self, split, encode_new, head: tuple[HashArray, np.ndarray] | None = None, fold=None, kept: int = 1 << 20):
        self.split, self.encode_new, self.fold, self.kept = split, encode_new, fold, kept
        none = np.zeros(0, np.int32)
        head, flat = head or (HashArray(none.astype(np.uint64), none, none), none)
        self.sets = [(head, flat, None, None)]

    def add(self, keys: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        self.sets.append((HashArray(keys, (ends - sizes).astype(np.int32), sizes.astype(np.int16 if not len(sizes) or sizes.max() < 1 << 15 else np.int32)), flat, keys, sizes))
        while len(self.sets) > 2 and len(self.sets[-1][2]) * 2 > len(self.sets[-2][2]):
            late, early = self.sets.pop(), self.sets.pop()  # near in size: one set instead of two
            keys, sizes, flat = (np.concatenate([early[i], late[i]]) for i in (2, 3, 1))
            ends = np.cumsum(sizes)
            self.sets.append((HashArray(keys, (ends - sizes).astype(np.int32), sizes.astype(np.int16 if not len(sizes) or sizes.max() < 1 << 15 else np.int32)), flat, keys, sizes))
        if sum(len(s[2]) for s in self.sets[1:]) > self.kept:
            del self.sets[1:]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = self.split(data, offsets)
        if self.fold is not None:
            data = self.fold(data, starts, ends)
        hashes = span_hash(prefix_hash(data), starts, ends)
        place = np.full(len(hashes), -1, dtype=np.int64)
        which = np.full(len(hashes), -1, dtype=np.int8)
        todo = np.arange(len(hashes))
        sets = list(self.sets)
        for i, (known, *_) in enumerate(sets):
            at = known.find(hashes[todo])
            place[todo[at >= 0]], which[todo[at >= 0]] = at[at >= 0], i
            todo = todo[at < 0]
        if len(todo):
            new, where = np.unique(hashes[todo], return_index=True)
            new_at = todo[where]
            sizes, flat = self.encode_new(data, starts[new_at], ends[new_at])
            late = HashArray(new, np.cumsum(sizes) - sizes, sizes)
            place[todo], which[todo] = late.find(hashes[todo]), len(sets)
            sets.append((late, flat, new, sizes))
            self.add(new, sizes, flat)
        begin, size = np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        pool = np.concatenate([s[1] for s in sets[1:]]) if len(sets) > 1 else np.zeros(0, np.int32)
        base = len(sets[0][1])
        shift = base
        for i, (known, flat, *_) in enumerate(sets):
            mine = which == i
            begin[mine] = known.values[0][place[mine]] + (0 if i == 0 else shift)
            size[mine] = known.values[1][place[mine]]
            shift += len(flat) if i else 0
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)
        out = np.empty(len(at), dtype=np.int32)
        in_head = at < base
        out[in_head] = sets[0][1][at[in_head]]
        out[~in_head] = pool[at[~in_head] - base]
        bounds = np.concatenate([[0], ends])[first]
        return out, bounds


def encode_with(tokenizer: str):
    """How the tokenizers library encodes new units; its file is read when the first one comes."""
    model = None

    def encode_new(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nonlocal model
        model = model or load(tokenizer)
        raw = data.tobytes()
        ids = encode_units(model, [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())])
        return np.array([len(x) for x in ids], dtype=np.int64), np.array([t for x in ids for t in x], dtype=np.int32)

    return encode_new


_caches: dict = {}


def worker_cache(key: str, make) -> UnitCache:
    """The cache of this worker; only the latest key's is kept."""
    if key not in _caches:
        _caches.clear()
        _caches[key] = make()
    return _caches[key]


class UnitTokenizer:
    """Encodes slices of texts inside tasks; workers keep what they have encoded."""

    def __init__(self, tokenizer: str, spark: SparkSession, encoded: DataFrame, head_units: int = HEAD_UNITS):
        self.tokenizer = tokenizer
        classes = {r["g"]: r["count"] for r in encoded.groupBy(F.floor(F.log2("n")).alias("g")).count().collect()}
        least, room = 64, head_units
        for g in sorted(classes, reverse=True):
            if classes[g] > room:
                break
            least, room = g, room - classes[g]
        head = encoded.where(F.log2("n") >= least).select("unit", "ids").toArrow()
        ids = head.column("ids").combine_chunks()
        keys = head.column("unit").to_numpy().view(np.uint64)
        bounds = ids.offsets.to_numpy() if len(keys) else np.zeros(1, np.int32)
        sizes = np.diff(bounds)
        flat = ids.flatten().to_numpy(zero_copy_only=False) if len(keys) else np.zeros(0, np.int32)
        flat = flat.astype(np.uint16 if not len(flat) or flat.max() < 1 << 16 else np.int32)
        begin = (bounds[:-1] - bounds[0]).astype(np.int32)
        known = HashArray(keys, begin, sizes.astype(np.int16 if not len(sizes) or sizes.max() < 1 << 15 else np.int32))
        del head, ids, keys, bounds
        pa.default_memory_pool().release_unused()
        self.key = uuid.uuid4().hex
        self.head = spark.sparkContext.broadcast((known, flat))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts and their n + 1 offsets."""
        cache = worker_cache(self.key, lambda: UnitCache(units, encode_with(self.tokenizer), self.head.value, folded, KEPT_UNITS))
        return cache.encode(data, offsets)


def encoded_units(texts: DataFrame, tokenizer: str) -> DataFrame:
    """The written table ``unit`` (hash), ``n`` and ``ids`` of all distinct units of column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {"keys": [], "texts": [], "n": []}
        held = 0
        for batch in batches:
            for _, _, data, offsets in slices(*text_bytes(batch.column(0))):
                starts, ends, _ = units(data, offsets)
                data = folded(data, starts, ends)
                keys, where, n = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_counts=True)
                size = ends[where] - starts[where]
                bounds = np.concatenate([[0], np.cumsum(size)])
                picked = data[np.arange(bounds[-1]) + np.repeat(starts[where] - bounds[:-1], size)]
                known["keys"].append(keys)
                known["n"].append(n)
                known["texts"].append(pa.Array.from_buffers(pa.large_string(), len(keys), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(picked)]))
                held += len(keys)
                if held > 1 << 19:
                    yield rows(known)
                    held = 0
        if held:
            yield rows(known)

    def rows(known) -> pa.RecordBatch:
        keys, n = np.concatenate(known["keys"]), np.concatenate(known["n"])
        texts = pa.concat_arrays(known["texts"])
        for part in known.values():
            part.clear()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        columns = [pa.array(keys[first].view(np.int64)), pa.array(np.add.reduceat(n[order], first)), texts.take(pa.array(order[first])).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["unit", "n", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer)
        for batch in batches:
            ids = pa.array(encode_units(model, batch.column(2).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], ["unit", "n", "ids"])

    distinct = texts.select("text").mapInArrow(count, "unit long, n long, text string").groupBy("unit").agg(F.sum("n").alias("n"), F.first("text").alias("text"))
    return written(distinct.mapInArrow(encode, "unit long, n long, ids array<int>"), "units")
