"""Context-tree weighting whose contexts are the bytes before, across white space.

The tree, its estimates and their mixture are those of :mod:`.ctw`; there a context
ends at white space, and a text is a bag of its words. Here a context is the last
``depth`` symbols of the text so far, whatever words they belong to. The symbols are
the lower-cased bytes, a start, and the symbol of the row's language, which stands
before the start and before every white-space byte: it is seen, never predicted.
Contexts are shorter only where the text starts.

Every byte of a text is a key of 64 bits, its context and itself. Tasks sort the keys of
some texts at a time and pass on distinct ones with their counts in the training
texts, as packed arrays by the three bytes before; keys of held-out texts have a count of 0, so
that every key has a value. Buckets of keys are trees below their three bytes; shorter
contexts are added up over buckets. The values of the keys that occur most are written to
files, which every task that scores loads; there is one such pass, however large the model
is. Keys that it does not find there go by groups of buckets, as packed arrays with their
texts, to the values of all other keys, and come back as sums by text.

Defined cases are those of :mod:`.ctw`.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .ctw import DEPTH, END, HEAD_WORDS, START, TOP, _above_key, _at_depth, _bucket, _mixed_above, collected, language, log_gamma_of, most_frequent, word_counts
from .storage import get, partition, put
from .tables import written
from .textbytes import LOWER, SPACE, U64, HashArray, count_keys, mix, per_text, prefix_hash, slices, span_hash, text_bytes, words

#: Keys that a task holds before it passes them on, bytes of text behind one bucket, and model rows that a task loads.
HELD_KEYS, BUCKET_BYTES, MODEL_ROWS = 3 << 20, 1 << 21, 3_000_000
#: Bytes of text that are made keys at a time.
SLICE = 1 << 19
#: Classes of counts are exact below EXACT, and so many for each doubling beyond.
EXACT, PER_DOUBLING = 64, 8
#: Buckets that share a group of keys without a file, as a power of 2.
GROUP_BITS = 3
#: Pads before a text, its language and its start.
LEAD = 10
#: Never a key: an empty place of a :class:`Lookup`.
EMPTY = U64((1 << 64) - 1)
BITS = range(8)


def text_keys(data: np.ndarray, offsets: np.ndarray, symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for each byte of the texts and for their ends, and the first key of each text (n + 1).

    The key has the symbols before it, the nearest one first, and the byte itself
    last; what lies before the text is 0.
    """
    n = len(offsets) - 1
    space = SPACE[data]
    spaces = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(space, out=spaces[1:])
    first = offsets + spaces[offsets] + (LEAD + 1) * np.arange(n + 1)
    ends = first[1:] - 1
    out = np.zeros(first[-1] + 8, dtype=np.uint8)
    lead = np.repeat((LEAD + 1) * np.arange(n) + LEAD, np.diff(offsets))
    at = spaces[1:] + np.arange(len(data)) + lead
    out[at] = LOWER[data]
    out[at[space] - 1] = np.repeat(symbols, np.diff(spaces[offsets]))
    out[first[:-1] + LEAD - 2] = symbols
    out[first[:-1] + LEAD - 1] = START
    out[ends] = END
    before = np.ndarray((len(out) - 7,), dtype="<u8", buffer=out, strides=(1,))
    starts = offsets + np.arange(n + 1)
    own = np.zeros(starts[-1], dtype=np.int64)
    inner = np.ones(len(own), dtype=bool)
    inner[starts[1:] - 1] = False
    own[inner], own[~inner] = at, ends
    seen = own - 8
    seen[inner] -= space  # the language before a white-space byte is no context of its own
    return (before[seen] & U64((1 << 64) - (1 << 8 * (8 - depth)))) | out[own], starts


# Packed arrays


def _pack(values: np.ndarray) -> bytes:
    """Arrays of 64 bits whose neighbours are alike, by planes of bytes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(U64)


PACKED = "bucket long, keys binary, counts binary"


def _packed(bucket: int, keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes, bytes]:
    """A bucket's ascending keys, as the gaps between them, and their counts."""
    return bucket, _pack(np.diff(keys, prepend=U64(0))), _pack(counts.astype(U64))


def _rows(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    columns = [pa.array(list(x), t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "counts"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sorted keys and counts of each bucket of a sorted partition."""
    at, parts = None, []
    for batch in batches:
        for bucket, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if bucket != at and parts:
                yield at, *count_keys(*(np.concatenate(x) for x in zip(*parts)))
                parts = []
            at = bucket
            parts.append((np.cumsum(_unpack(keys), dtype=U64), _unpack(counts).astype(np.int64)))
            if len(parts) > 64:
                parts = [count_keys(*(np.concatenate(x) for x in zip(*parts)))]
    if parts:
        yield at, *count_keys(*(np.concatenate(x) for x in zip(*parts)))


def key_counts(rows: DataFrame, depth: int, bits: int) -> DataFrame:
    """The written table of all distinct keys by bucket, with their counts in rows that are not held out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        size = 0
        for batch in batches:
            out, symbol = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            for a, b, data, offsets in slices(*text_bytes(batch.column(0)), SLICE):
                keys, at = text_keys(data, offsets, symbol[a:b].astype(np.uint8), depth)
                apart = np.repeat(out[a:b], np.diff(at))
                held[0].append(keys[~apart])
                held[1].append(keys[apart])
                size += len(keys)
                if size > HELD_KEYS:
                    yield from passed_on(held)
                    size = 0
        yield from passed_on(held)

    def passed_on(held: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        for learned, parts in zip((1, 0), held):
            if not parts:
                continue
            keys, counts = count_keys(np.concatenate(parts))
            parts.clear()
            bucket = _bucket(keys, bits)
            place = np.argsort(bucket.astype(np.uint16), kind="stable")
            keys, counts, bucket = keys[place], counts[place] * learned, bucket[place]
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(keys)).tolist()
            if len(keys):
                yield _rows([_packed(int(bucket[i]), keys[i:j], counts[i:j]) for i, j in zip(cuts, cuts[1:])])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_bucket(batches):
            yield _rows([_packed(*found)])

    dealt = rows.select("text", "held_out", "symbol").mapInArrow(count, PACKED).repartition("bucket").sortWithinPartitions("bucket")
    return written(dealt.mapInArrow(sums, PACKED), "tree-counts")


# The tree


_GAMMAS: dict[float, np.ndarray] = {}


def _log_gamma(n: np.ndarray, shift: float) -> np.ndarray:
    """ln of the gamma function of ``n + shift``; small ones are looked up."""
    if shift not in _GAMMAS:
        _GAMMAS[shift] = log_gamma_of(np.arange(1 << 16) + shift)
    table = _GAMMAS[shift]
    out = table[np.minimum(n, len(table) - 1)]
    large = np.flatnonzero(n >= len(table))
    out[large] = log_gamma_of(n[large] + shift)
    return out


@dataclass
class Edges:
    """Contexts of one depth with the bytes after them, ascending, their counts, and the place of each in the depth above."""

    keys: np.ndarray
    n: np.ndarray
    up: np.ndarray


class Subtree:
    """All nodes of three bytes of context and more in a bucket, from its sorted keys and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.keys, self.counts, self.depth = keys, counts, depth
        self.length = np.full(len(keys), depth)
        for j in range(depth - 1, 1, -1):
            self.length[_is_first(keys >> U64(8 * (8 - j)))] = j
        self.edges: dict[int, Edges] = {}
        self.place: dict[int, np.ndarray] = {}
        edges, n = np.zeros(0, U64), np.zeros(0, np.int64)
        for d in range(depth, 2, -1):
            own = _at_depth(keys[self.length == d], d)
            shorter = (edges >> U64(16) << U64(8)) | (edges & U64(255))
            edges, n = count_keys(np.concatenate([shorter, own]), np.concatenate([n, counts[self.length == d]]))
            if d < depth:
                self.edges[d + 1].up = np.searchsorted(edges, shorter)
            self.edges[d] = Edges(edges, n, np.zeros(0, np.int64))
            self.place[d] = np.searchsorted(edges, own)

    def _levels(self, j: int) -> dict[int, dict[str, np.ndarray]]:
        """Nodes of the j-th decision by depth; ``id`` is the context and the bits before, ``node`` the place of each edge's."""
        out: dict[int, dict[str, np.ndarray]] = {}
        for d in range(self.depth, 2, -1):
            edges = self.edges[d]
            ids = edges.keys >> U64(8 - j)
            new = np.ones(len(ids), dtype=bool)
            new[1:] = ids[1:] != ids[:-1]
            first = np.flatnonzero(new)
            ids = ids[first]
            bit = ((edges.keys >> U64(7 - j)) & U64(1)).astype(np.int64)
            total, ones = (np.add.reduceat(x, first) if len(first) else x for x in (edges.n, edges.n * bit))
            zeros = total - ones
            own = _log_gamma(zeros, 0.5) + _log_gamma(ones, 0.5) - _log_gamma(total, 1.0) - math.log(math.pi)
            own[total == 0] = 0.0
            level = {"id": ids, "node": np.cumsum(new) - 1, "first": first, "zeros": zeros, "ones": ones}
            weighted, stop = own.copy(), np.ones(len(ids))
            if d < self.depth:
                child = out[d + 1]
                child["up"] = level["node"][self.edges[d + 1].up[child["first"]]]
                below = np.bincount(child["up"], weights=child["weighted"], minlength=len(ids))
                inner = ~_is_first(ids >> U64(j))
                weighted[inner] = np.logaddexp(own[inner], below[inner]) - math.log(2)
                stop[inner] = 0.5 * np.exp(own[inner] - weighted[inner])
            kt = np.where(total > 0, (ones + 0.5) / (total + 1), np.nan)  # not a number: never reached
            out[d] = level | {"kt": kt, "weighted": weighted, "stop": stop}
        return out

    def upper(self) -> tuple[np.ndarray, ...]:
        """``depth``, ``context``, ``node``, ``zeros``, ``ones`` and ``weighted`` of what shorter contexts are made of.

        These are the nodes of three bytes, and the bytes after contexts that end before.
        """
        out = []
        own = self.length == 2
        edges, n = count_keys(_at_depth(self.keys[own], 2), self.counts[own])
        for j in BITS:
            level = self._levels(j)[3]
            node = (1 << j) | (level["id"] & U64((1 << j) - 1)).astype(np.int64)
            counts = level["zeros"].astype(float), level["ones"].astype(float)
            out.append((np.full(len(node), 3), (level["id"] >> U64(j)).astype(np.int64), node, *counts, level["weighted"]))
            bit = ((edges >> U64(7 - j)) & U64(1)).astype(np.int64)
            node = (1 << j) | ((edges & U64(255)) >> U64(8 - j)).astype(np.int64)
            out.append((np.full(len(node), 2), (edges >> U64(8)).astype(np.int64), node, (n * (1 - bit)).astype(float), (n * bit).astype(float), np.zeros(len(node))))
        return tuple(np.concatenate(x) for x in zip(*out))

    def log10(self, above: HashArray) -> np.ndarray:
        """log10 probability of the last byte of each key after its context.

        ``above`` has the mixture so far, the weight that is left, and the estimate of the
        last node reached, at contexts of up to two bytes.
        """
        out = np.zeros(len(self.keys))
        for j in BITS:
            one = np.full(len(self.keys), 0.5)
            own = np.flatnonzero(self.length == 2)
            if len(own):
                one[own] = above.values[0][above.find(_above_key(2, _at_depth(self.keys[own], 2) >> U64(8 - j), j))]
            levels = self._levels(j)
            for d in range(3, self.depth + 1):
                level = levels[d]
                if d == 3:
                    parent = (level["id"] >> U64(j + 8) << U64(j)) | (level["id"] & U64((1 << j) - 1))
                    place = above.find(_above_key(2, parent, j))
                    before, rest, reached = (v[place] for v in above.values)
                else:
                    before, rest, reached = (v[level["up"]] for v in (said, left, last))
                last = np.where(np.isnan(level["kt"]), reached, level["kt"])
                said = before + rest * level["stop"] * last
                left = rest * (1 - level["stop"])
                one[self.length == d] = said[level["node"][self.place[d]]]
            bit = (self.keys >> U64(7 - j)) & U64(1)
            out += np.log10(np.where(bit == 1, one, 1 - one))
        return out


def _is_first(contexts: np.ndarray) -> np.ndarray:
    """Whether the outermost symbols, lowest here, are the language and the start of a text."""
    return TOP[(contexts & U64(255)).astype(np.int64)] & (((contexts >> U64(8)) & U64(255)) == START)


@dataclass(frozen=True)
class Fitted:
    """Files of the most frequent keys with their values, and a table of the others, if there are any, in groups."""

    folder: str
    files: list[tuple[str, int]]
    key: str
    others: DataFrame | None
    bits: int


def _class(counts: np.ndarray) -> np.ndarray:
    """Classes of counts, ascending with them."""
    doublings = np.log2(np.maximum(counts, EXACT) / EXACT)
    return np.where(counts < EXACT, counts, EXACT + (PER_DOUBLING * doublings).astype(np.int64))


def least_class(counted: DataFrame, bound: int) -> int:
    """The lowest class of counts from which up at most ``bound`` keys lie."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                more = np.bincount(_class(_unpack(counts).astype(np.int64)), minlength=len(n))
                more[: len(n)] += n
                n = more
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["class", "n"])

    found = counted.select("counts").mapInArrow(sizes, "class long, n long").where("n > 0")
    least, room = 0, bound
    for r in sorted(found.groupBy("class").agg(F.sum("n").alias("n")).collect(), reverse=True):
        room -= r["n"]
        if room < 0:
            return r["class"] + 1
    return least


def fit_tree(rows: DataFrame, depth: int, bound: int) -> Fitted:
    """The log10 probability of every key of the texts, at most ``bound`` of them in files.

    ``rows`` has ``text``, ``held_out`` and ``symbol``; ``depth`` is 3 to 7.
    """
    if not 3 <= depth <= 7:
        raise ValueError("a depth of 3 to 7 bytes")
    spark = rows.sparkSession
    folder = scratch_path(spark, "tree-model")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(16, max(6, (size // BUCKET_BYTES).bit_length()))
    counted = key_counts(rows, depth, bits)

    def upwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, counts in _by_bucket(batches):
            d, context, node, zeros, ones, weighted = Subtree(keys, counts, depth).upper()
            columns = [pa.array(d.astype(np.int32)), pa.array(context), pa.array(node.astype(np.int32)), *map(pa.array, (zeros, ones, weighted))]
            yield pa.RecordBatch.from_arrays(columns, ["depth", "context", "node", "zeros", "ones", "weighted"])

    schema = "depth int, context long, node int, zeros double, ones double, weighted double"
    above = spark.sparkContext.broadcast(_mixed_above(written(counted.mapInArrow(upwards, schema), "tree-upper"), depth))

    least = least_class(counted, bound)
    names = ["name", "n", "bucket", "keys", "values"]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, keys, counts in _by_bucket(batches):
            logs = Subtree(keys, counts, depth).log10(above.value)
            usual = _class(counts) >= least
            held.append((keys[usual], logs[usual]))
            size += int(usual.sum())
            if not usual.all():
                keys, logs = keys[~usual], logs[~usual]
                group = int(_bucket(keys[:1], bits - GROUP_BITS)[0])
                yield _typed([None, None, group, _pack(np.diff(keys, prepend=U64(0))), _pack(logs.view(U64))], names)
            if size > HELD_KEYS // 4:
                yield filed(held)
                held, size = [], 0
        if size:
            yield filed(held)

    def filed(held: list) -> pa.RecordBatch:
        keys, logs = (np.concatenate(x) for x in zip(*held))
        both = np.stack([keys, logs.view(U64)], axis=1)  # a row is a key and its value
        return _typed([put(folder, f"tree-{partition():06d}", both.tobytes()), len(keys), None, None, None], names)

    model = written(counted.mapInArrow(values, "name string, n long, bucket long, keys binary, values binary"), "tree-values")
    files = [tuple(r) for r in model.where("name IS NOT NULL").select("name", "n").collect()]
    others = model.where("bucket IS NOT NULL").select("bucket", "keys", "values") if least else None
    return Fitted(folder, files, uuid.uuid4().hex, others, bits - GROUP_BITS)


NO_KEYS = ["bucket", "keys", "places"]


def _wide(columns: list[pa.Array], names: list[str], texts_schema: str) -> pa.RecordBatch:
    """Rows of texts or of keys as rows of a table that holds both."""
    of = dict(zip(names, columns))
    n = len(columns[0])
    types = {"boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "long": pa.int64()}
    all_types = {c: types[t] for c, t in (f.split() for f in texts_schema.split(", "))} | {c: TYPES.get(c, pa.int64()) for c in NO_KEYS}
    return pa.RecordBatch.from_arrays([of[c] if c in of else pa.nulls(n, t) for c, t in all_types.items()], list(all_types))


TYPES = {"name": pa.string(), "keys": pa.binary(), "values": pa.binary(), "places": pa.binary()}


def _typed(row: list, names: list[str]) -> pa.RecordBatch:
    """One row; columns without another type are long."""
    return pa.RecordBatch.from_arrays([pa.array([x], TYPES.get(c, pa.int64())) for x, c in zip(row, names)], names)


class Lookup:
    """Values of keys at their hash or the next places after it."""

    def __init__(self, part: Fitted):
        n = sum(rows for _, rows in part.files)
        table = np.empty((n, 2), dtype=U64)
        at = 0
        for name, rows in part.files:
            table[at : at + rows] = np.frombuffer(get(part.folder, name, 0, 16 * rows), dtype=U64).reshape(-1, 2)
            at += rows
        self.shift = U64(64 - max(4, (4 * n // 3).bit_length()))
        home = self._home(table[:, 0])
        order = np.argsort(home, kind="stable")
        place = home[order]
        del home
        place -= np.arange(n)
        np.maximum.accumulate(place, out=place)
        place += np.arange(n)
        size = max(1 << (64 - int(self.shift)), int(place[-1]) + 1 if n else 0) + 1
        self.keys, self.values = np.full(size, EMPTY), np.zeros(size)
        self.keys[place], self.values[place] = table[order, 0], table[order, 1].view(np.float64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys, 0 where there is none, and the places of those without."""
        place = self._home(keys)
        here = self.keys[place]
        todo = np.flatnonzero(here != keys)
        none = [todo[here[todo] == EMPTY]]
        todo = todo[here[todo] != EMPTY]
        while len(todo):
            place[todo] += 1
            here = self.keys[place[todo]]
            none.append(todo[here == EMPTY])
            todo = todo[(here != keys[todo]) & (here != EMPTY)]
        return self.values[place], np.concatenate(none)


_loaded: dict[str, Lookup] = {}


def loaded(part: Fitted) -> Lookup:
    """The arrays of a model in this worker; only the latest model's are kept."""
    if part.key not in _loaded:
        _loaded.clear()
        _loaded[part.key] = Lookup(part)
    return _loaded[part.key]


def _asked(held: list, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Groups of keys that were not found, ascending, and the place of the text of each."""
    keys, places = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(keys)
    keys, places = keys[order], places[order]
    group = _bucket(keys, bits)
    order = np.argsort(group.astype(np.uint16), kind="stable")
    keys, places, group = keys[order], places[order], group[order]
    cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(keys)).tolist()
    for i, j in zip(cuts, cuts[1:]):
        yield int(group[i]), _pack(np.diff(keys[i:j], prepend=U64(0))), _pack(places[i:j].astype(U64))


def other_scores(asked: DataFrame, others: DataFrame) -> DataFrame:
    """``chunk``, ``place`` and ``more``: what keys without a file add to the score of a text.

    ``asked`` has ``bucket``, ``chunk``, ``keys`` and ``places``, and ``others`` is that of :class:`Fitted`.
    """
    names = ["chunk", "bucket", "places", "values"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, model, logs = None, [], None, None
        for batch in batches:
            for bucket, chunk, keys, second in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bucket != at:
                    at, held, model = bucket, [], None
                keys = np.cumsum(_unpack(keys), dtype=U64)
                if chunk < 0:
                    held.append((keys, _unpack(second).view(np.float64)))
                    continue
                if model is None:
                    model, logs = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, U64), np.zeros(0))
                    order = np.argsort(model)
                    model, logs, held = model[order], logs[order], []
                found = np.searchsorted(model, keys)
                if len(model) == 0 or (model[np.minimum(found, len(model) - 1)] != keys).any():
                    raise KeyError("a text has changed since its keys were counted")
                places = _unpack(second).astype(np.int64)
                sums = np.bincount(places, weights=logs[found])
                texts = np.flatnonzero(np.bincount(places))
                yield _typed([chunk, bucket, _pack(np.diff(texts.astype(U64), prepend=U64(0))), _pack(sums[texts].view(U64))], names)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, np.zeros(0)
        for batch in batches:
            for chunk, places, values in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if chunk != at:
                    if at is not None:
                        yield of_chunk(at, sums)
                    at, sums = chunk, np.zeros(0)
                places = np.cumsum(_unpack(places), dtype=U64).astype(np.int64)
                if places[-1] >= len(sums):
                    sums = np.append(sums, np.zeros(places[-1] + 1 - len(sums)))
                sums[places] += _unpack(values).view(np.float64)
        if at is not None:
            yield of_chunk(at, sums)

    def of_chunk(chunk: int, sums: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(sums), chunk)), pa.array(np.arange(len(sums))), pa.array(sums)]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "place", "more"])

    model = others.select("bucket", F.lit(-1).cast("long").alias("chunk"), "keys", F.col("values").alias("second"))
    both = model.unionByName(asked.select("bucket", "chunk", "keys", F.col("places").alias("second")))
    answers = both.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(answer, "chunk long, bucket long, places binary, values binary")
    dealt = answers.repartition("chunk").sortWithinPartitions("chunk", "bucket").select("chunk", "places", "values")
    return dealt.mapInArrow(added, "chunk long, place long, more double")


def tree_scores(docs: DataFrame, held_out: Column, depth: int = DEPTH, head_words: int = HEAD_WORDS, bound: int = MODEL_ROWS) -> DataFrame:
    """Scores of all rows by the tree and by add-one word counts, both learned from the rows not held out.

    ``held_out`` is a condition on the columns of ``docs``. Returns ``doc_id``,
    ``held_out``, ``n_tokens`` (words and one end), ``n_known``,
    ``train_tokens``, ``base_score``, ``score``, ``n_bytes`` (with the end) and
    ``bits_per_byte``.
    """
    spark = docs.sparkSession
    symbol = language(docs)
    row_key = F.xxhash64(F.coalesce("text", F.lit("")), symbol)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), row_key.alias("row_key"), "text", symbol.alias("symbol"))
    model = fit_tree(rows, depth, bound)
    training = rows.where(~F.col("held_out"))
    counts = written(word_counts(training).withColumnRenamed("c", "n"), "tree-words")
    n_texts = training.count()
    n_words, n_kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = n_words + n_texts, n_kinds + (n_texts > 0)
    in_head = F.log2("n") >= most_frequent(counts, head_words)
    head = spark.sparkContext.broadcast(collected(counts.where(in_head).select("word", "n")))
    fields = ["doc_id", "held_out", "row_key", "n_words", "head_tokens", "n_bytes", "head_log", "score", "rare", "chunk", "place"]
    texts_schema = "doc_id long, held_out boolean, row_key long, n_words long, head_tokens long, n_bytes long, head_log double, score double, rare array<long>, chunk long, place long"
    of_keys = ["chunk", "bucket", "keys", "places"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        n = known.values[0] if len(known.hashes) else np.zeros(1)
        chunk, texts, held, size = partition() << 32, 0, [], 0
        for batch in batches:
            symbols = batch.column(4).to_numpy()
            for a, b, data, offsets in slices(*text_bytes(batch.column(3)), SLICE):
                starts, ends, at = words(data, offsets)
                own = span_hash(prefix_hash(LOWER[data]), starts, ends)
                place = known.find(own)
                c = np.where(place >= 0, n[place], 0)
                far = place < 0
                rare = pa.ListArray.from_arrays(np.append(0, np.cumsum(per_text(far, at))).astype(np.int32), pa.array(own[far].view(np.int64)))
                columns = [batch.column(i).slice(a, b - a) for i in range(3)]
                columns += [pa.array(x.astype(np.int64)) for x in (np.diff(at), per_text(~far, at), np.diff(offsets) + 1)]
                keys, first = text_keys(data, offsets, symbols[a:b].astype(np.uint8), depth)
                logs, none = loaded(part).find(keys)
                columns += [pa.array(per_text(np.log10(c + 1.0), at)), pa.array(per_text(logs, first)), rare]
                columns += [pa.array(np.full(b - a, chunk)), pa.array(np.arange(texts, texts + b - a))]
                yield _wide(columns, fields, texts_schema)
                held.append((keys[none], texts + np.searchsorted(first, none, "right") - 1))
                texts, size = texts + b - a, size + len(none)
                if size > HELD_KEYS // 2:
                    for row in _asked(held, part.bits):
                        yield _wide(_typed([chunk, *row], of_keys).columns, of_keys, texts_schema)
                    chunk, texts, held, size = chunk + 1, 0, [], 0
        if size:
            for row in _asked(held, part.bits):
                yield _wide(_typed([chunk, *row], of_keys).columns, of_keys, texts_schema)

    part = Fitted(model.folder, model.files, model.key, None, model.bits)  # tasks get no table
    both = written(rows.mapInArrow(score, f"{texts_schema}, bucket long, keys binary, places binary"), "tree-scored")
    scored = both.where("bucket IS NULL").drop("bucket", "keys", "places")
    # copies of a row, equal in id and text, have equal parts: their mean is one's
    of_row = [F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")]
    tail = scored.select(*of_row, F.explode("rare").alias("word")).join(counts.where(~in_head), "word")
    tail = tail.groupBy("_id", "_key").agg(F.count("n").alias("known"), F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("log"))
    copies = scored.where(F.size("rare") > 0).groupBy(*of_row).agg(F.count("*").alias("copies"))
    same = lambda t: scored["doc_id"].eqNullSafe(t["_id"]) & (scored["row_key"] == t["_key"])
    tail = tail.join(copies.withColumnsRenamed({"_id": "_i", "_key": "_k"}), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")))
    tail = tail.select("_id", "_key", F.round(F.col("known") / F.col("copies")).cast("long").alias("tail_tokens"), (F.col("log") / F.col("copies")).alias("tail_log"))
    joined = scored.join(tail, same(tail), "left").drop("_id", "_key", "rare")
    if model.others is not None:
        more = other_scores(both.where("bucket IS NOT NULL"), model.others)
        joined = joined.join(more, ["chunk", "place"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    n_tokens = F.col("n_words") + 1
    known_words = F.col("head_tokens") + F.coalesce("tail_tokens", F.lit(0)) + int(n_texts > 0)
    logs = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) + math.log10(n_texts + 1)
    return joined.select(
        "doc_id",
        "held_out",
        n_tokens.alias("n_tokens"),
        known_words.alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - n_tokens * math.log10(total + kinds + 1)).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
