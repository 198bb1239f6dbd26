"""Language-model scores by context-tree weighting over bytes.

A text is the bytes of its lower-cased (A-Z) UTF-8 between a start and an end
symbol, each decomposed into 8 binary decisions. Every decision has a tree of
contexts: the 0 to 7 bytes before, back to the last white space (or the start),
and before that a symbol for the language of the row. A node holds how often its decision went either way, the
Krichevsky-Trofimov probability of that block, and the weighted probability
``(own + product of the children) / 2``; contexts that reach the language have
no children. A bit is predicted by the mixture of the estimates of all
depths on its path with those weights. Nodes that the training texts never
reached predict what the last one above them that they did reach predicts, or
1/2 if there is none.

As contexts end at white space, a text is a run of units: a white-space byte,
the word after it, and the byte that ends it. All distinct units are written,
with their counts in the training texts; model and scores come from them and
not from the texts, and a text's score is the sum of its units'. Bytes with
their contexts are counted in buckets by the last three bytes before them, where
all deeper nodes are array operations. Shorter contexts, at most 65,536 of two
bytes, are added up over buckets by joins and groupings. What each byte costs
after its context is written to files, which tasks load slot by slot.

Defined cases: a null text is empty (its end is scored); a null ``doc_id`` is
never held out; equal rows get equal scores; without training texts every bit
has probability 1/2. There are ten symbols for languages, dealt by a hash; a null
language counts as an empty one, and a table without that column has one. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .kneser_ney import SLOTS, Model, passes_of
from .storage import get, partition, put
from .tables import written
from .textbytes import (
    LOWER,
    SPACE,
    U64,
    HashArray,
    KeyCounter,
    count_keys,
    mix,
    per_text,
    prefix_hash,
    slices,
    span_hash,
    text_bytes,
    words,
)

DEPTH = 7
#: Words and units (the most frequent) that one broadcast holds, at 16 bytes each; the others are joined.
HEAD_WORDS, HEAD_UNITS = 1 << 19, 1 << 20
#: Never part of UTF-8: they stand for the start and the end of a text.
START, END = 0xFF, 0xFE
EDGE = SPACE.copy()
EDGE[[START, END]] = True
#: Nor are these, which stand for languages.
LANGUAGES = [0xC0, 0xC1, *range(0xF5, 0xFD)]
TOP = np.zeros(256, dtype=bool)
TOP[LANGUAGES] = True
#: Units that a task holds before it passes them on, bytes of units behind one bucket, and model rows of a pass.
HELD_UNITS, BUCKET_BYTES, MODEL_ROWS = 1 << 18, 1 << 19, 6_000_000
BITS = range(8)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0, by Stirling's series after eight steps upwards."""
    y = x + 8
    steps = x
    for i in range(1, 8):
        steps = steps * (x + i)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(steps)


def log_gamma_of(x: np.ndarray) -> np.ndarray:
    """The same of an array."""
    y = x + 8
    steps = x.copy()
    for i in range(1, 8):
        steps *= x + i
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(steps)


# Units


def framed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts between start and end symbols; first and last byte of each unit, and the first unit of each text (n + 1)."""
    n = len(offsets) - 1
    out = np.full(len(data) + 2 * n, END, dtype=np.uint8)
    first = offsets[:-1] + 2 * np.arange(n)
    out[first] = START
    out[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(offsets))] = LOWER[data]
    edges = np.flatnonzero(EDGE[out])
    own = out[edges] != END  # no unit starts at an end
    starts = edges[own]
    ends = edges[np.flatnonzero(own) + 1]
    return out, starts, ends, np.searchsorted(starts, np.append(first, len(out)))


def language(docs: DataFrame) -> Column:
    """The language's symbol of each row."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return F.get(F.array(*[F.lit(x) for x in LANGUAGES]), F.pmod(F.crc32(F.coalesce(lang, F.lit(""))), F.lit(len(LANGUAGES))).cast("int"))


def unit_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Hashes of units in the language that each has a symbol of."""
    return mix(span_hash(prefix_hash(data), starts, ends + 1) + symbols.astype(U64) * U64(0x9E3779B97F4A7C15))


def unit_counts(rows: DataFrame) -> DataFrame:
    """The written table ``unit`` (hash), ``n`` (in rows not held out) and ``bytes`` of all distinct units.

    ``rows`` has ``text``, ``held_out`` and ``symbol``. The bytes start with the language's symbol.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        size = 0
        for batch in batches:
            out, symbol = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            for a, b, data, offsets in slices(*text_bytes(batch.column(0))):
                data, starts, ends, first = framed(data, offsets)
                learned, symbols = (np.repeat(x[a:b], np.diff(first)) for x in (~out, symbol))
                keys, where, back = np.unique(unit_keys(data, starts, ends, symbols), return_index=True, return_inverse=True)
                n = np.bincount(back, weights=learned, minlength=len(keys)).astype(np.int64)
                lengths = ends[where] - starts[where] + 2
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                picked = data[np.maximum(np.arange(bounds[-1]) + np.repeat(starts[where] - 1 - bounds[:-1], lengths), 0)]
                picked[bounds[:-1]] = symbols[where]
                content = pa.Array.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(picked)])
                held.append((keys, n, content))
                size += len(keys)
                if size > HELD_UNITS:
                    yield put_together(held)
                    held, size = [], 0
        if held:
            yield put_together(held)

    def put_together(held) -> pa.RecordBatch:
        keys, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        content = pa.concat_arrays([h[2] for h in held]).take(pa.array(order[first])).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(np.add.reduceat(n[order], first)), content], ["unit", "n", "bytes"])

    found = rows.select("text", "held_out", "symbol").mapInArrow(count, "unit long, n long, bytes binary")
    return written(found.groupBy("unit").agg(F.sum("n").alias("n"), F.first("bytes").alias("bytes")), "ctw-units")


def contexts(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for each byte of the units but their first two, and the first key of each unit (n + 1).

    The key has the bytes before it, the nearest one first, and the byte itself last;
    what lies before the unit is 0.
    """
    n = len(offsets) - 1
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    keys = data.astype(U64)
    for j in range(1, depth + 1):
        before = np.zeros(len(data), dtype=U64)
        before[j:] = data[:-j] if len(data) > j else data[:0]
        keys |= np.where(at >= j, before, U64(0)) << U64(8 * (8 - j))
    return keys[at > 1], offsets - 2 * np.arange(n + 1)


# The tree


def _depth_of(keys: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes of context a key has: up to the language, ``depth`` at most."""
    out = np.full(len(keys), depth, dtype=np.int64)
    for j in range(depth - 1, 0, -1):
        out[TOP[((keys >> U64(8 * (8 - j))) & U64(255)).astype(np.int64)]] = j
    return out


def _at_depth(keys: np.ndarray, d: int) -> np.ndarray:
    """The nearest ``d`` bytes of context, and the byte."""
    return (keys >> U64(8 * (8 - d)) << U64(8)) | (keys & U64(255))


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys >> U64(40)) >> U64(64 - bits)).astype(np.int64)


class Subtrees:
    """All nodes of three bytes of context and more in a bucket, from its sorted keys and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.keys, self.counts, self.depth = keys, counts, depth
        self.length = _depth_of(keys, depth)
        self.nodes: dict[tuple[int, int], dict[str, np.ndarray]] = {}
        edges, n = np.zeros(0, U64), np.zeros(0, np.int64)
        for d in range(depth, 2, -1):
            own = self.length == d
            shorter = (edges >> U64(16) << U64(8)) | (edges & U64(255))
            edges, n = count_keys(np.concatenate([shorter, _at_depth(keys[own], d)]), np.concatenate([n, counts[own]]))
            for j in BITS:
                self.nodes[d, j] = self._level(edges, n, d, j)

    def _level(self, edges: np.ndarray, n: np.ndarray, d: int, j: int) -> dict[str, np.ndarray]:
        """Nodes of the j-th decision at depth d: ``id`` is the context and the bits before."""
        ids = edges >> U64(8 - j)
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
        bit = ((edges >> U64(7 - j)) & U64(1)).astype(np.int64)
        total = np.add.reduceat(n, first).astype(float) if len(first) else np.zeros(0)
        ones = np.add.reduceat(n * bit, first).astype(float) if len(first) else np.zeros(0)
        zeros, ids = total - ones, ids[first]
        own = log_gamma_of(zeros + 0.5) + log_gamma_of(ones + 0.5) - log_gamma_of(total + 1) - math.log(math.pi)
        own[total == 0] = 0.0
        ends = TOP[((ids >> U64(j)) & U64(255)).astype(np.int64)] | (d == self.depth)
        weighted, stop = own.copy(), np.ones(len(ids))
        if d < self.depth:
            child = self.nodes[d + 1, j]
            below = np.bincount(np.searchsorted(ids, self._parent(child["id"], j)), weights=child["weighted"], minlength=len(ids))
            inner = ~ends
            weighted[inner] = np.logaddexp(own[inner], below[inner]) - math.log(2)
            stop[inner] = 0.5 * np.exp(own[inner] - weighted[inner])
        kt = np.where(total > 0, (ones + 0.5) / (total + 1), np.nan)  # not a number: never reached
        return {"id": ids, "zeros": zeros, "ones": ones, "kt": kt, "weighted": weighted, "stop": stop}

    @staticmethod
    def _parent(ids: np.ndarray, j: int) -> np.ndarray:
        return (ids >> U64(j + 8) << U64(j)) | (ids & U64((1 << j) - 1))

    def upper(self) -> tuple[np.ndarray, ...]:
        """``depth``, ``context``, ``node``, ``zeros``, ``ones`` and ``weighted`` of what shorter contexts are made of.

        These are the nodes of three bytes, and the bytes after contexts that end before.
        """
        out = []
        for j in BITS:
            level = self.nodes[3, j] if self.depth >= 3 else None
            if level is not None:
                node = (1 << j) | (level["id"] & U64((1 << j) - 1)).astype(np.int64)
                out.append((np.full(len(node), 3), (level["id"] >> U64(j)).astype(np.int64), node, level["zeros"], level["ones"], level["weighted"]))
            for d in range(1, min(3, self.depth + 1)):
                own = self.length == d
                edges, n = count_keys(_at_depth(self.keys[own], d), self.counts[own])
                bit = ((edges >> U64(7 - j)) & U64(1)).astype(np.int64)
                node = (1 << j) | ((edges & U64(255)) >> U64(8 - j)).astype(np.int64)
                out.append((np.full(len(node), d), (edges >> U64(8)).astype(np.int64), node, (n * (1 - bit)).astype(float), (n * bit).astype(float), np.zeros(len(node))))
        return tuple(np.concatenate(x) for x in zip(*out))

    def log10(self, above: "HashArray") -> np.ndarray:
        """log10 probability of the last byte of each key after its context.

        ``above`` has the mixture so far, the weight that is left, and the estimate of the
        last node reached, at contexts of up to two bytes.
        """
        out = np.zeros(len(self.keys))
        for j in BITS:
            one = np.full(len(self.keys), 0.5)
            said = left = ids = last = None
            for d in range(1, self.depth + 1):
                own = np.flatnonzero(self.length == d)
                wanted = _at_depth(self.keys[own], d) >> U64(8 - j)
                if d < 3:
                    one[own] = above.values[0][above.find(_above_key(d, wanted, j))] if len(own) else one[own]
                    continue
                level = self.nodes[d, j]
                parent = self._parent(level["id"], j)
                if d == 3:
                    place = above.find(_above_key(2, parent, j))
                    before, rest, reached = (v[place] for v in above.values)
                else:
                    place = np.searchsorted(ids, parent)
                    before, rest, reached = said[place], left[place], last[place]
                last = np.where(np.isnan(level["kt"]), reached, level["kt"])
                said = before + rest * level["stop"] * last
                left, ids = rest * (1 - level["stop"]), level["id"]
                one[own] = said[np.searchsorted(ids, wanted)]
            bit = (self.keys >> U64(7 - j)) & U64(1)
            out += np.log10(np.where(bit == 1, one, 1 - one))
        return out


def _above_key(d: int, ids: np.ndarray, j: int) -> np.ndarray:
    """Key of a node by depth, context and tree node; ``ids`` has the context and the bits before."""
    return U64(d << 56) | (ids >> U64(j) << U64(8)) | U64(1 << j) | (ids & U64((1 << j) - 1))


def _counted(units: DataFrame, depth: int, bits: int) -> DataFrame:
    """``bucket``, ``keys`` and ``counts`` of the bytes of all units with their contexts, added up per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            n = batch.column(0).to_numpy()
            for a, b, data, offsets in slices(*text_bytes(batch.column(1))):
                keys, at = contexts(data, offsets, depth)
                held.append(count_keys(keys, np.repeat(n[a:b], np.diff(at))))
                size += len(held[-1][0])
                if size > 1 << 20:
                    held = [count_keys(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0])
                    if size > 1 << 19:
                        yield packed(*held[0])
                        held, size = [], 0
        if held:
            yield packed(*count_keys(*(np.concatenate(x) for x in zip(*held))))

    def packed(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        bucket = _bucket(keys, bits)
        place = np.argsort(bucket, kind="stable")
        keys, counts, bucket = keys[place], counts[place], bucket[place]
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(keys)).tolist()
        ends = list(zip(cuts, cuts[1:]))
        columns = [pa.array(bucket[cuts[:-1]], pa.int64())] + [pa.array([x[i:j].tobytes() for i, j in ends], pa.binary()) for x in (keys, counts)]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "counts"])

    return units.select("n", "bytes").mapInArrow(count, "bucket long, keys binary, counts binary")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sorted keys and counts of each bucket of a sorted partition."""
    at, parts = None, []
    for batch in batches:
        for bucket, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if bucket != at and parts:
                yield at, *count_keys(*(np.concatenate(x) for x in zip(*parts)))
                parts = []
            at = bucket
            parts.append((np.frombuffer(keys.as_buffer(), dtype=U64), np.frombuffer(counts.as_buffer(), dtype=np.int64)))
            if len(parts) > 64:
                parts = [count_keys(*(np.concatenate(x) for x in zip(*parts)))]
    if parts:
        yield at, *count_keys(*(np.concatenate(x) for x in zip(*parts)))


def _mixed_above(upper: DataFrame, depth: int) -> "HashArray":
    """The mixture so far (``said``), the weight ``left`` and the ``last`` estimate at all contexts of one and two bytes.

    ``upper`` is what :meth:`Subtrees.upper` gives over all buckets. Two bytes bound
    the rows that reach the driver: 65,536 contexts with 255 nodes each.
    """
    keys = ["context", "node"]
    counts = [F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")]
    levels: dict[int, DataFrame] = {}
    below = upper.where("depth = 3")
    for d in (2, 1, 0):
        level = below.groupBy(F.shiftright("context", 8).alias("context"), "node").agg(*counts, F.sum("weighted").alias("below"))
        ends = upper.where(F.col("depth") == d).groupBy(*keys).agg(*counts).withColumn("below", F.lit(None).cast("double"))
        level = level.unionByName(ends)
        a, b = F.col("zeros"), F.col("ones")
        own = F.when(a + b == 0, F.lit(0.0)).otherwise(log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi))
        level = level.select(*keys, "zeros", "ones", "below", own.alias("own"), F.when(a + b > 0, (b + 0.5) / (a + b + 1)).alias("kt"))
        gap = F.col("below") - F.col("own")
        larger = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(gap))) - math.log(2)
        stop = F.when(gap > 700, 0.0).otherwise(1 / (1 + F.exp(F.least(gap, F.lit(700.0)))))
        inner = F.col("below").isNotNull()
        level = level.select(
            *keys, "zeros", "ones", "kt", F.when(inner, larger).otherwise(F.col("own")).alias("weighted"), F.when(inner, stop).otherwise(1.0).alias("stop")
        )
        levels[d] = below = written(level, "ctw-level")
    found = None
    for d in range(3):
        level = levels[d].select(*keys, "kt", "stop")
        if found is None:
            level = level.select("*", F.lit(0.0).alias("said"), F.lit(1.0).alias("left"), F.lit(0.5).alias("last"))
        else:
            level = level.withColumn("upper", F.shiftright("context", 8)).join(found, ["upper", "node"])
        last = F.coalesce("kt", "last")
        said = (F.col("said") + F.col("left") * F.col("stop") * last).alias("said")
        level = written(level.select(*keys, said, (F.col("left") * (1 - F.col("stop"))).alias("left"), last.alias("last")), "ctw-mixed")
        found = level.select(F.col("context").alias("upper"), "node", "said", "left", "last")
        levels[d] = level
    rows = [levels[d].select((F.lit(d << 56).bitwiseOR(F.shiftleft("context", 8)).bitwiseOR(F.col("node"))).alias("key"), "said", "left", "last") for d in (1, 2)]
    table = rows[0].unionByName(rows[1]).toArrow()
    return HashArray(table.column(0).to_numpy().view(U64), *[table.column(i).to_numpy() for i in (1, 2, 3)])


def fit_tree(units: DataFrame, depth: int = DEPTH) -> Model:
    """Files with the log10 probability of every byte of the units after its context; ``depth`` is 3 to 7."""
    if not 3 <= depth <= 7:
        raise ValueError("a depth of 3 to 7 bytes")
    spark = units.sparkSession
    folder = scratch_path(spark, "ctw-model")
    size = units.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    bits = min(16, max(6, (size // BUCKET_BYTES).bit_length()))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, keys, counts in _by_bucket(batches):
            columns = [pa.array([x]) for x in (bucket, keys.tobytes(), counts.tobytes())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "counts"])

    dealt = _counted(units, depth, bits).repartition("bucket").sortWithinPartitions("bucket")
    merged = written(dealt.mapInArrow(sums, "bucket long, keys binary, counts binary"), "ctw-counts")

    def upwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, counts in _by_bucket(batches):
            d, context, node, zeros, ones, weighted = Subtrees(keys, counts, depth).upper()
            columns = [pa.array(d.astype(np.int32)), pa.array(context), pa.array(node.astype(np.int32)), *map(pa.array, (zeros, ones, weighted))]
            yield pa.RecordBatch.from_arrays(columns, ["depth", "context", "node", "zeros", "ones", "weighted"])

    schema = "depth int, context long, node int, zeros double, ones double, weighted double"
    above = spark.sparkContext.broadcast(_mixed_above(written(merged.mapInArrow(upwards, schema), "ctw-upper"), depth))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for bucket, keys, counts in _by_bucket(batches):
            held.setdefault(bucket % SLOTS, []).append((keys, Subtrees(keys, counts, depth).log10(above.value)))
        for slot, parts in held.items():
            keys, logs = (np.concatenate(x) for x in zip(*parts))
            name = put(folder, f"ctw-{partition():06d}", keys.tobytes() + logs.tobytes())
            columns = [pa.array([x]) for x in (0, slot, name, len(keys))]
            yield pa.RecordBatch.from_arrays(columns, ["group", "slot", "name", "rows"])

    files = written(merged.mapInArrow(values, "group long, slot long, name string, rows long"), "ctw-files")
    return Model(folder, depth, bits, [tuple(r) for r in files.collect()])


def unit_scores(units: DataFrame, model: Model, bound: int = MODEL_ROWS) -> DataFrame:
    """The written table ``unit``, ``n`` and ``score``; passes over the units load at most ``bound`` model rows."""
    passes, _ = passes_of(model, bound)

    def score(part) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            contents = [get(model.folder, name) for name in part.names]
            parts = [np.frombuffer(c, dtype=U64).reshape(2, -1) for c in contents]
            known = HashArray(np.concatenate([np.zeros(0, U64), *[p[0] for p in parts]]), np.concatenate([np.zeros(0), *[p[1].view(np.float64) for p in parts]]))
            owned = np.zeros(SLOTS, dtype=bool)
            owned[part.slots] = True
            for batch in batches:
                for a, b, data, offsets in slices(*text_bytes(batch.column(2))):
                    keys, at = contexts(data, offsets, model.order)
                    logs = np.zeros(len(keys))
                    mine = owned[_bucket(keys, model.bits) % SLOTS]
                    logs[mine] = known.values[0][known.find(keys[mine])] if len(known.hashes) else 0.0
                    columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(per_text(logs, at))]
                    yield pa.RecordBatch.from_arrays(columns, ["unit", "n", "score"])

        return units.select("unit", "n", "bytes").mapInArrow(run, "unit long, n long, score double")

    scored = score(passes[0])
    for part in passes[1:]:
        scored = scored.unionByName(score(part))
    if len(passes) > 1:
        scored = scored.groupBy("unit", "n").agg(F.sum("score").alias("score"))
    return written(scored, "ctw-scores")


def collected(rows: DataFrame) -> HashArray:
    """A table of keys and values as a hash array on the driver; its rows are bounded by the caller."""
    table = rows.toArrow()
    out = HashArray(table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy())
    del table
    pa.default_memory_pool().release_unused()
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (hash of the lower-cased word) and ``c`` over column ``text``, summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = KeyCounter(1 << 21)
        for batch in batches:
            for _, _, data, offsets in slices(*text_bytes(batch.column(0))):
                starts, ends, _ = words(data, offsets)
                counter.add(span_hash(prefix_hash(LOWER[data]), starts, ends))
                if counter.full():
                    yield rows(counter)
        yield rows(counter)

    def rows(counter: KeyCounter) -> pa.RecordBatch:
        keys, n = counter.take()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["word", "c"])

    return texts.select("text").mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, room: int) -> float:
    """The least log2 of count ``n`` whose rows, with all more frequent ones, are no more than ``room``."""
    classes = {r["g"]: r["count"] for r in counts.where("n > 0").groupBy(F.floor(F.log2("n")).alias("g")).count().collect()}
    least = 64
    for g in sorted(classes, reverse=True):
        if classes[g] > room:
            break
        least, room = g, room - classes[g]
    return least


def lm_scores(docs: DataFrame, held_out: Column, depth: int = DEPTH, head_words: int = HEAD_WORDS, head_units: int = HEAD_UNITS) -> DataFrame:
    """Scores of all rows by the tree and by add-one word counts, both learned from the rows not held out.

    ``held_out`` is a condition on the columns of ``docs``. Returns ``doc_id``,
    ``held_out``, ``n_tokens`` (words and one end), ``n_known``,
    ``train_tokens``, ``base_score``, ``score``, ``n_bytes`` (with the end) and
    ``bits_per_byte``.
    """
    spark = docs.sparkSession
    out = F.coalesce(held_out, F.lit(False))
    symbol = language(docs)
    row_key = F.xxhash64(F.coalesce("text", F.lit("")), symbol)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), row_key.alias("row_key"), "text", symbol.alias("symbol"))
    training = rows.where(~F.col("held_out"))
    units = unit_counts(rows)
    scores = unit_scores(units, fit_tree(units, depth))
    counts = written(word_counts(training).withColumnRenamed("c", "n"), "ctw-words")
    n_texts = training.count()
    n_words, n_kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = n_words + n_texts, n_kinds + (n_texts > 0)

    least_word, least_unit = most_frequent(counts, head_words), most_frequent(scores, head_units)
    in_words, in_units = F.log2("n") >= least_word, (F.col("n") > 0) & (F.log2("n") >= least_unit)
    head = spark.sparkContext.broadcast((collected(counts.where(in_words).select("word", "n")), collected(scores.where(in_units).select("unit", "score"))))
    fields = ["doc_id", "held_out", "row_key", "n_words", "head_tokens", "n_bytes", "head_log", "head_score"]

    def found(data: np.ndarray, offsets: np.ndarray, symbols: np.ndarray):
        """Hashes of words and units, their places in the heads (-1: not there), and the first ones of each text."""
        known_words, known_units = head.value
        starts, ends, first = words(data, offsets)
        own = span_hash(prefix_hash(LOWER[data]), starts, ends)
        whole, begin, end, at = framed(data, offsets)
        parts = unit_keys(whole, begin, end, np.repeat(symbols, np.diff(at)))
        return own, known_words.find(own), first, parts, known_units.find(parts), at

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, known_units = (x.values[0] if len(x.hashes) else np.zeros(1) for x in head.value)
        for batch in batches:
            symbols = batch.column(4).to_numpy()
            for a, b, data, offsets in slices(*text_bytes(batch.column(3))):
                _, word, first, _, unit, at = found(data, offsets, symbols[a:b])
                c = np.where(word >= 0, known_words[word], 0)
                logs = np.where(unit >= 0, known_units[unit], 0.0)
                columns = [batch.column(i).slice(a, b - a) for i in range(3)]
                columns += [pa.array(x.astype(np.int64)) for x in (np.diff(first), per_text(word >= 0, first), np.diff(offsets) + 1)]
                columns += [pa.array(per_text(np.log10(c + 1.0), first)), pa.array(per_text(logs, at))]
                yield pa.RecordBatch.from_arrays(columns, fields)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is not in the heads: words (kind 0) and units (1), and one row (2) for each text that has any."""
        for batch in batches:
            symbols = batch.column(3).to_numpy()
            for a, b, data, offsets in slices(*text_bytes(batch.column(2))):
                own, word, first, parts, unit, at = found(data, offsets, symbols[a:b])
                for kind, keys, place, begin in ((0, own, word, first), (1, parts, unit, at)):
                    far = np.flatnonzero(place < 0)
                    text = np.searchsorted(begin, far, "right") - 1
                    ids = [batch.column(i).slice(a, b - a).take(pa.array(text)) for i in range(2)]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(np.full(len(far), kind, np.int32)), pa.array(keys[far].view(np.int64))], ["doc_id", "row_key", "kind", "key"])
                some = np.flatnonzero(per_text(word < 0, first) + per_text(unit < 0, at) > 0)
                ids = [batch.column(i).slice(a, b - a).take(pa.array(some)) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(np.full(len(some), 2, np.int32)), pa.array(np.zeros(len(some), np.int64))], ["doc_id", "row_key", "kind", "key"])

    scored = rows.mapInArrow(score, "doc_id long, held_out boolean, row_key long, n_words long, head_tokens long, n_bytes long, head_log double, head_score double")
    known = counts.where(~in_words).select(F.lit(0).alias("kind"), F.col("word").alias("key"), F.col("n").alias("c"), F.lit(None).cast("double").alias("unit_score"))
    known = known.unionByName(scores.where(~in_units).select(F.lit(1).alias("kind"), F.col("unit").alias("key"), F.lit(None).cast("long").alias("c"), F.col("score").alias("unit_score")))
    is_word = F.col("kind") == 0
    tail = (
        rows.select("doc_id", "row_key", "text", "symbol")
        .mapInArrow(rare, "doc_id long, row_key long, kind int, key long")
        .join(known, ["kind", "key"], "left")
        .groupBy(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"))
        .agg(
            F.count(F.when(F.col("kind") == 2, 1)).alias("_copies"),
            F.count("c").alias("_known"),
            F.sum(F.when(is_word, F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0)))).alias("_log"),
            F.sum("unit_score").alias("_score"),
        )
    )
    # a tail row sums what all copies of its row have
    known_words = F.col("head_tokens") + F.coalesce(F.round(F.col("_known") / F.col("_copies")), F.lit(0)).cast("long")
    logs = F.col("head_log") + F.coalesce(F.col("_log") / F.col("_copies"), F.lit(0.0))
    joined = scored.join(tail, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), "left")
    joined = joined.withColumn("score", F.col("head_score") + F.coalesce(F.col("_score") / F.col("_copies"), F.lit(0.0)))
    n_tokens = F.col("n_words") + 1
    end = math.log10(n_texts + 1)
    return joined.select(
        "doc_id",
        "held_out",
        n_tokens.alias("n_tokens"),
        (known_words + int(n_texts > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs + end - n_tokens * math.log10(total + kinds + 1)).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
