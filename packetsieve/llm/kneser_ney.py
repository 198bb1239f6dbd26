"""Modified Kneser-Ney models over bytes, one for each group of texts, in files of sorted arrays.

Counting packs n-grams by the two bytes before the predicted one, so an n-gram
and all its shorter forms down to three bytes meet in one bucket. There, counts
of distinct continuations, discounts, back-off weights and interpolated
probabilities are array operations; only pairs and single bytes, at most 65,536
of a group, are put together over buckets. The results are written to files in
the shared folder, which scoring tasks load by themselves: no part of a model
passes through the driver, which sees names and numbers of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .storage import get, partition, put
from .tables import written
from .textbytes import LOWER, U64, HashArray, KeyCounter, byte_ngrams, count_keys, mix, slices, text_bytes

#: Bytes and the end of a text.
SYMBOLS = 257
#: N-grams that a task holds before it passes them on, and text behind one bucket.
HELD_GRAMS, BUCKET_BYTES = 1 << 20, 1 << 20
#: A model is cut into so many slots of buckets, so that a large one can be used piece by piece.
SLOTS = 16
#: Rows (12 bytes, and some 6 of an index) that a scoring task loads at a time.
MODEL_ROWS = 6_000_000


@dataclass(frozen=True)
class Model:
    """Files of a model: ``(group, slot, name, rows)``; slot -1 has the orders below three."""

    folder: str
    order: int
    bits: int
    files: list[tuple[int, int, str, int]]

    def groups(self) -> dict[int, dict[int, int]]:
        """Rows by group and slot."""
        found: dict[int, dict[int, int]] = {}
        for group, slot, _, rows in self.files:
            own = found.setdefault(group, {})
            own[slot] = own.get(slot, 0) + rows
        return found


def _mask(k: int) -> np.uint64:
    return U64((1 << 8 * k) - 1)


def _bucket(grams: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of n-grams of three bytes or more, by the two bytes before the last."""
    return (mix((grams >> U64(8)) & U64(0xFFFF)) >> U64(64 - bits)).astype(np.int64)


def _counted(texts: DataFrame, order: int, bits: int, choose: Callable | None) -> DataFrame:
    """``group``, ``bucket``, ``keys`` and ``counts`` of the n-grams of (``text``, ``group``), counted per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[int, KeyCounter] = {}
        for batch in batches:
            every = batch.column(1).to_numpy()
            for a, b, data, offsets in slices(*text_bytes(batch.column(0))):
                chosen = np.ones(b - a, dtype=bool) if choose is None else choose(data, offsets)
                grams, at = byte_ngrams(LOWER[data], offsets, order)
                sizes = np.diff(at)
                for g in np.unique(every[a:b][chosen]).tolist():
                    counters.setdefault(g, KeyCounter(HELD_GRAMS)).add(grams[np.repeat(chosen & (every[a:b] == g), sizes)])
                if sum(c.size for c in counters.values()) > 2 * HELD_GRAMS:
                    for c in counters.values():
                        c.merge()
                    if sum(c.size for c in counters.values()) > HELD_GRAMS:
                        yield from packed(counters)
        yield from packed(counters)

    def packed(counters: dict[int, KeyCounter]) -> Iterator[pa.RecordBatch]:
        for g in list(counters):
            keys, counts = counters.pop(g).take()
            if not len(keys):
                continue
            bucket = _bucket(keys, bits)
            place = np.argsort(bucket, kind="stable")  # keys stay sorted within a bucket
            keys, counts, bucket = keys[place], counts[place], bucket[place]
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(keys)).tolist()
            ends = list(zip(cuts, cuts[1:]))
            columns = [
                pa.array([g] * len(ends), pa.int64()),
                pa.array(bucket[cuts[:-1]], pa.int64()),
                pa.array([keys[i:j].tobytes() for i, j in ends], pa.binary()),
                pa.array([counts[i:j].astype(np.int64).tobytes() for i, j in ends], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["group", "bucket", "keys", "counts"])

    return texts.mapInArrow(count, "group long, bucket long, keys binary, counts binary")


def _types(keys: np.ndarray, counts: np.ndarray, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams of each order down to 2 and their counts: below the highest order, of distinct bytes before them."""
    types = {order: (keys, counts)}
    for k in range(order - 1, 1, -1):
        types[k] = count_keys(types[k + 1][0] & _mask(k))
    return types


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int(x) for x in np.bincount(np.minimum(counts, 5), minlength=6)[1:5]]


def _merged(counted: DataFrame, order: int) -> DataFrame:
    """One row for each group and bucket: its n-grams, counts of counts by order, and its pairs."""

    def solve(group: int, bucket: int, parts: list) -> pa.RecordBatch:
        keys, counts = count_keys(*(np.concatenate(x) for x in zip(*parts)))
        types = _types(keys, counts, order)
        of_counts = [n for k in range(3, order + 1) for n in _counts_of_counts(types[k][1])]
        pairs, times = types[2]
        columns = [
            pa.array([group], pa.int64()),
            pa.array([bucket], pa.int64()),
            pa.array([keys.tobytes()], pa.binary()),
            pa.array([counts.tobytes()], pa.binary()),
            pa.array([of_counts], pa.list_(pa.int64())),
            pa.array([pairs.astype(np.int64).tolist()], pa.list_(pa.int64())),
            pa.array([times.tolist()], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["group", "bucket", "keys", "counts", "coc", "pairs", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], 0
        for batch in batches:
            for group, bucket, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if (group, bucket) != at:
                    if parts:
                        yield solve(*at, parts)
                    at, parts, held = (group, bucket), [], 0
                parts.append((np.frombuffer(keys.as_buffer(), dtype=U64), np.frombuffer(counts.as_buffer(), dtype=np.int64)))
                held += len(parts[-1][0])
                if held > 4 * HELD_GRAMS:
                    parts = [count_keys(*(np.concatenate(x) for x in zip(*parts)))]
                    held = len(parts[0][0])
        if parts:
            yield solve(*at, parts)

    schema = "group long, bucket long, keys binary, counts binary, coc array<long>, pairs array<long>, times array<long>"
    return counted.repartition("group", "bucket").sortWithinPartitions("group", "bucket").mapInArrow(run, schema)


def _discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from an order's counts of counts."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [i - (i + 1) * y * (b / a) if a else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(i - 0.01, max(0.1, d)) for i, d in enumerate(raw, 1))


def _graded(keys: np.ndarray, counts: np.ndarray, cuts: tuple, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of sorted n-grams given those of their shorter forms; contexts and their back-off weights."""
    contexts = keys >> U64(8)
    first = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])) if len(keys) else np.zeros(0, np.int64)
    cut = np.array(cuts)[np.minimum(counts, 3) - 1]
    total = np.add.reduceat(counts, first).astype(np.float64) if len(first) else np.zeros(0)
    weight = np.add.reduceat(cut, first) / total if len(first) else np.zeros(0)
    size = np.diff(np.append(first, len(keys)))
    return (counts - cut) / np.repeat(total, size) + np.repeat(weight, size) * below, contexts[first], weight


def _rows(order: int, group: int, keys, p, contexts, weight) -> tuple[np.ndarray, ...]:
    tag, of = U64(order << 56), U64(group & (1 << 64) - 1)
    return (keys | tag) ^ of, np.log10(p).astype(np.float32), (contexts | tag) ^ of, np.log10(weight).astype(np.float32)


def _file(parts: list[tuple[np.ndarray, ...]]) -> tuple[bytes, int]:
    """Keys and values of probabilities, then of back-off weights."""
    columns = [np.concatenate(x) for x in zip(*parts)]
    head = np.array([len(columns[0]), len(columns[2])], dtype=np.int64)
    return head.tobytes() + b"".join(c.tobytes() for c in columns), int(head.sum())


def _unpacked(content: bytes) -> list[np.ndarray]:
    n, m = np.frombuffer(content, dtype=np.int64, count=2).tolist()
    out, at = [], 16
    for size, kind in ((n, U64), (n, np.float32), (m, U64), (m, np.float32)):
        out.append(np.frombuffer(content, dtype=kind, count=size, offset=at))
        at += size * np.dtype(kind).itemsize
    return out


FILES = "group long, slot long, name string, rows long"


def _file_row(folder: str, group: int, slot: int, parts: list) -> pa.RecordBatch:
    content, rows = _file(parts)
    name = put(folder, f"kn-{partition():06d}", content)
    return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([slot], pa.int64()), pa.array([name]), pa.array([rows], pa.int64())], ["group", "slot", "name", "rows"])


def fit_kneser_ney(texts: DataFrame, order: int, choose: Callable | None = None, group: Column | None = None) -> Model:
    """The model of the texts that ``choose(bytes, offsets)`` marks in each slice (default: all).

    With ``group``, a long, each group has a model of its own; discounts are those of
    all groups together. ``order`` is 3 to 7.
    """
    if not 3 <= order <= 7:
        raise ValueError("an order of 3 to 7 bytes")
    spark = texts.sparkSession
    folder = scratch_path(spark, "kn-model")
    rows = texts.select(F.coalesce("text", F.lit("")).alias("text"), (F.lit(0) if group is None else group).cast("long").alias("group"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(14, max(6, (size // BUCKET_BYTES).bit_length()))
    merged = written(_merged(_counted(rows, order, bits, choose), order), "kn-counts")
    pairs = merged.select("group", F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy("group", F.col("p.pairs").alias("pair"))
    pairs = written(pairs.agg(F.sum("p.times").alias("c")), "kn-pairs")
    singles = pairs.groupBy("group", F.col("pair").bitwiseAND(F.lit(255)).alias("byte")).agg(F.count("*").alias("c"))
    few = lambda df: df.agg(*[F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    places = [F.coalesce(F.sum(F.get("coc", F.lit(i))), F.lit(0)).alias(str(i)) for i in range(4 * (order - 2))]
    high = list(merged.agg(*places).first())
    cuts = {1: _discounts_of(*few(singles)), 2: _discounts_of(*few(pairs))}
    cuts |= {k: _discounts_of(*high[4 * (k - 3) : 4 * (k - 2)]) for k in range(3, order + 1)}

    def low(_, table):
        """Orders 1 and 2 of a group: at most 65,536 pairs."""
        table = table.sort_by("pair")
        own = table.column("group")[0].as_py()
        keys, counts = table.column("pair").to_numpy().astype(U64), table.column("c").to_numpy()
        single, times = count_keys(keys & U64(255))
        p1, none, weight1 = _graded(single, times, cuts[1], np.full(len(single), 1 / SYMBOLS))
        p2, contexts, weight2 = _graded(keys, counts, cuts[2], p1[np.searchsorted(single, keys & U64(255))])
        parts = [_rows(1, own, single, p1, none, weight1), _rows(2, own, keys, p2, contexts, weight2)]
        probs = put(folder, "kn-pairs", keys.tobytes() + p2.tobytes())
        return pa.Table.from_batches([_file_row(folder, own, -1, parts).append_column("pairs", pa.array([probs]))])

    lows = written(pairs.groupBy("group").applyInArrow(low, FILES + ", pairs string"), "kn-low")

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All orders from 3 on of the buckets of a group and slot, into one file."""
        at, parts, loaded = None, [], (None, None, None)
        for batch in batches:
            for own, slot, name, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4)):
                if at != (own, slot) or sum(len(p[0]) for p in parts) > MODEL_ROWS:
                    if parts:
                        yield _file_row(folder, *at, parts)
                    at, parts = (own, slot), []
                if loaded[0] != name:
                    content = get(folder, name)
                    n = len(content) // 16
                    loaded = name, np.frombuffer(content, dtype=U64, count=n), np.frombuffer(content, dtype=np.float64, offset=8 * n)
                _, known, p = loaded
                types = _types(np.frombuffer(keys.as_buffer(), dtype=U64), np.frombuffer(counts.as_buffer(), dtype=np.int64), order)
                for k in range(3, order + 1):
                    own_keys, own_counts = types[k]
                    below = p[np.searchsorted(known, own_keys & _mask(k - 1))]
                    p, contexts, weight = _graded(own_keys, own_counts, cuts[k], below)
                    known = own_keys
                    parts.append(_rows(k, own, own_keys, p, contexts, weight))
        if parts:
            yield _file_row(folder, *at, parts)

    slot = F.expr(f"bucket % {SLOTS}").alias("slot")
    names = lows.select("group", "pairs")
    buckets = merged.select("group", slot, "keys", "counts").join(F.broadcast(names) if _few(names) else names, "group")
    buckets = buckets.repartition("group", "slot").sortWithinPartitions("group", "slot").select("group", "slot", "pairs", "keys", "counts")
    files = written(buckets.mapInArrow(orders, FILES), "kn-files")
    listed = [tuple(r) for r in files.unionByName(lows.select("group", "slot", "name", "rows")).collect()]
    return Model(folder, order, bits, listed)


def _few(rows: DataFrame, bound: int = 100_000) -> bool:
    """Whether the rows, of a few small values each, may be broadcast."""
    return rows.limit(bound + 1).count() <= bound


# Scoring


class KneserNey:
    """Arrays of some files of a model, in a task."""

    def __init__(self, model: Model, names: list[str]):
        parts = [_unpacked(get(model.folder, name)) for name in names]
        empty = [np.zeros(0, U64), np.zeros(0, np.float32)] * 2
        keys, values, contexts, weights = (np.concatenate(x) for x in zip(empty, *parts))
        self.order = model.order
        self.probs = HashArray(keys, values)
        del parts, keys, values
        self.weights = HashArray(contexts, weights)

    def log10(self, grams: np.ndarray, group: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each n-gram after the others, in the model of its group."""
        out = np.zeros(len(grams))
        todo = np.arange(len(grams))
        for k in range(self.order, 0, -1):
            tag = U64(k << 56)
            own = grams[todo] & _mask(k)
            at = self.probs.find((own | tag) ^ group[todo])
            out[todo[at >= 0]] += self.probs.values[0][at[at >= 0]]
            todo, own = todo[at < 0], own[at < 0]
            if not len(todo):
                return out
            at = self.weights.find(((own >> U64(8)) | tag) ^ group[todo])
            out[todo[at >= 0]] += self.weights.values[0][at[at >= 0]]
        out[todo] -= np.log10(SYMBOLS)
        return out


def slots_of(grams: np.ndarray, model: Model) -> np.ndarray:
    """The slot of each n-gram of the model's order."""
    return _bucket(grams, model.bits) % SLOTS


_loaded: dict = {}


def loaded(key: str, model: Model, names: list[str]) -> KneserNey:
    """The arrays of a pass in this worker; only the latest pass's are kept."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = KneserNey(model, names)
    return _loaded[key]


@dataclass(frozen=True)
class Pass:
    """What one pass over the texts scores: texts of some groups, n-grams of some slots of buckets."""

    groups: list[int]
    others: bool
    slots: list[int]
    names: list[str]
    key: str


def passes_of(model: Model, bound: int) -> tuple[list[Pass], int]:
    """Passes that load at most ``bound`` rows, as far as slots allow, and how often each text is read.

    Texts of different groups are different texts, so many groups cost no further
    reading; only a group that is too large for one pass does.
    """
    sizes = model.groups()
    most = max((sum(s.values()) for s in sizes.values()), default=0)
    times = min(SLOTS, max(1, -(-most // bound)))
    passes = []
    for part in range(times):
        slots = [s for s in range(SLOTS) if s % times == part]
        sets: list[list[int]] = [[]]
        room = bound
        for group, own in sorted(sizes.items()):
            rows = sum(n for s, n in own.items() if s < 0 or s in slots)
            if sets[-1] and rows > room:
                sets.append([])
                room = bound
            sets[-1].append(group)
            room -= rows
        for i, groups in enumerate(sets):
            names = [name for g, s, name, _ in model.files if g in set(groups) and (s < 0 or s in slots)]
            passes.append(Pass(groups, i == 0, slots, names, uuid.uuid4().hex))
    return passes, times


def in_pass(group: Column, part: Pass, model: Model) -> Column:
    """Whether a pass scores the rows of a group; the first one also has those of groups without a model."""
    own = group.isin(*part.groups) if part.groups else F.lit(False)
    every = sorted(model.groups())
    return own | (~group.isin(*every) if every else F.lit(True)) if part.others else own
