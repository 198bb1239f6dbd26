"""MinHash near-duplicates with SetSketch registers.

A document's set is its distinct ``k``-word shingles (lower-cased A-Z). Documents
with equal sets form a class. Register i of a class holds
``floor(1 - log_b(a x))``, truncated to 16 bits, where x is the smallest of the
exponential values that the elements have for i. Each element's values come
from one Poisson process over all registers in ascending order, so it stops as
soon as it cannot lower any. Registers of a union are the maxima, so sketches
merge.

1. Bands of equal registers make candidates: every class of a band's bucket
   with the bucket's smallest class. A maximum-likelihood estimate from the
   numbers of larger, smaller and equal registers (and the exact set sizes)
   drops pairs that are far below the threshold.
2. The others are verified on the full sets; verified links give components.
   Buckets that still hold several components try ``PIVOTS`` more classes; a class
   leaves its bucket before the next is drawn, as it has met all others there.
3. What is left is compared in blocks: the classes outside the bucket's largest
   component against those of other components, in the order of the estimate,
   verified on the full sets at once. A block returns links, at most one for
   each class and component.

No pair of a bucket is left out, unless its classes are linked already. A pair
at the threshold misses all bands with a probability below 1e-6: the width of a
band follows from the threshold, 5 registers (24 bands, 5e-7) at 0.85 and 4 (30
bands, 9e-8) at 0.80.

Defined cases: a text of fewer than ``k`` words has its whole sequence as one
shingle; without words (or null) the set is empty and links with nothing, so
the document is its own component. Equal rows have equal results; a null
``doc_id`` is never a component's name unless all of its ids are null. Classes
are known by a 64-bit hash of their set. Other columns keep their values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .repeats import _filter_of, _hits
from .tables import as_row, columns_of, written
from .textbytes import LOWER, distinct_per_text, mix, prefix_hash, slices, span_hash, text_bytes, word_shingles, words

REGISTERS, BASE, RATE = 120, 1.05, 20.0
#: The largest chance of a pair at the threshold to miss all bands.
MISS = 1e-6
#: Standard deviations by which an estimate may lie below the threshold.
DOUBT = 5.0
#: Classes that a bucket tries after the first, before the blocks.
PIVOTS = 3
#: Outside classes in a block of step 3, which meet twice as many others; and how many are verified at a time.
SIDE, AT_ONCE = 512, 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and their n + 1 offsets."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    shingles, at = word_shingles(span_hash(prefix_hash(data), starts, ends), first, k)
    values, _, at = distinct_per_text(shingles, at)
    return values, at


def set_ids(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set; -1 is free for the empty one."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(mix(values), out=total[1:])
    return (mix((total[at[1:]] - total[at[:-1]]) ^ np.diff(at).astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def registers(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SetSketch registers (sets x REGISTERS, uint16) of sets that are not empty."""
    n = len(at) - 1
    sizes = np.diff(at)
    least = np.full(n * REGISTERS, np.inf)
    reach = (math.log(REGISTERS) + 10) / np.maximum(sizes, 1)
    owner = np.repeat(np.arange(n), sizes)
    todo = np.arange(n)
    while len(todo):
        mine = np.isin(owner, todo) if len(todo) < n else np.ones(len(owner), dtype=bool)
        h, who = values[mine], owner[mine]
        x, j = np.zeros(len(h)), 0
        while len(h):
            j += 1
            bits = mix(h + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            x = x - np.log(((bits >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / REGISTERS
            on = x < reach[who]
            h, who, x, bits = h[on], who[on], x[on], bits[on]
            to = ((mix(bits) >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(least, who * REGISTERS + to, x)
        todo = todo[np.isinf(least.reshape(n, REGISTERS)[todo]).any(axis=1)]
        todo = todo[sizes[todo] > 0]
        reach[todo] *= 2
    value = np.floor(1 - np.log(RATE * least) / math.log(BASE))
    return np.clip(value + 1000, 0, 65535).astype(np.uint16).reshape(n, REGISTERS)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from pairs of sketches and the set sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = REGISTERS - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    best, value = np.full(len(u), -np.inf), np.zeros(len(u))
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / math.log(BASE)
    for step in np.linspace(0, 1, 65):
        j = top * step
        up, down = p(u - v * j), p(v - u * j)
        score = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))
        better = score > best
        best, value = np.where(better, score, best), np.where(better, j, value)
    return value


def _lowest(percent: int) -> float:
    """The lowest estimate of a pair that may reach the threshold."""
    t = percent / 100
    return t - DOUBT * math.sqrt(t * (1 - t) / REGISTERS)


def _may_link(a, b, size_a, size_b, percent: int) -> np.ndarray:
    fits = 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
    out = np.zeros(len(size_a), dtype=bool)
    at = np.flatnonzero(fits)
    if len(at):
        out[at] = estimate(a[at], b[at], size_a[at].astype(float), size_b[at].astype(float)) >= _lowest(percent)
    return out


def _sketches(column: pa.Array) -> np.ndarray:
    return text_bytes(column)[0].view(np.uint16).reshape(-1, REGISTERS) if len(column) else np.zeros((0, REGISTERS), np.uint16)


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id``, ``row_key``, ``n``, ``set_id`` and ``sketch`` of every row; the last two are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(*text_bytes(batch.column(2))):
                values, at = shingle_sets(data, offsets, k)
                none = np.diff(at) == 0
                sketch = registers(values, at)
                raw = pa.py_buffer(np.ascontiguousarray(sketch).view(np.uint8).reshape(-1))
                bounds = pa.py_buffer((np.arange(b - a + 1) * 2 * REGISTERS).astype(np.int32))
                mask = pa.array(none)
                sketches = pa.Array.from_buffers(pa.binary(), b - a, [None, bounds, raw])
                columns = [batch.column(i).slice(a, b - a) for i in (0, 1)]
                columns += [pa.array(np.diff(at)), pa.array(set_ids(values, at), mask=none), pa.compute.if_else(mask, pa.scalar(None, pa.binary()), sketches)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "n", "set_id", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key"), "text")
    return rows.mapInArrow(run, "doc_id long, row_key long, n long, set_id long, sketch binary")


def missed(percent: int, width: int) -> float:
    """The chance that sets at the threshold share no band of ``width`` registers."""
    # registers agree least where one set contains the other
    same = 1 + math.log1p(-(1 - percent / 100) * (BASE - 1) / BASE) / math.log(BASE)
    return (1 - same**width) ** (REGISTERS // width)


def band_width(percent: int) -> int:
    """The most registers in a band with which :func:`missed` stays within ``MISS``."""
    widths = [w for w in range(1, REGISTERS + 1) if REGISTERS % w == 0]
    return max((w for w in widths if missed(percent, w) <= MISS), default=1)


def band_rows(classes: DataFrame, width: int) -> DataFrame:
    """``key``, ``band`` and ``set_id``: one row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = _sketches(batch.column(1)).astype(np.uint64)
            bands = sketch.reshape(len(sketch), -1, width)
            key = np.zeros(bands.shape[:2], dtype=np.uint64) + np.arange(bands.shape[1], dtype=np.uint64)
            for i in range(width):
                key = mix(key * np.uint64(65536 + 1) + bands[:, :, i])
            ids = np.repeat(batch.column(0).to_numpy(), bands.shape[1])
            number = np.tile(np.arange(bands.shape[1], dtype=np.int16), len(sketch))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(number), pa.array(ids)], ["key", "band", "set_id"])

    return classes.select("set_id", "sketch").mapInArrow(run, "key long, band short, set_id long")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u``, ``v`` that the estimate does not rule out."""
    side = lambda c: classes.select(F.col("set_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(i).to_numpy() for i in (2, 3)]
            keep = _may_link(_sketches(batch.column(4)), _sketches(batch.column(5)), *sizes, percent)
            yield batch.select([0, 1]).filter(pa.array(keep))

    joined = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", "s_u", "s_v")
    return joined.mapInArrow(run, "u long, v long")


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Written: ``set_id`` and ``members`` (48-bit hashes) of the classes in ``ids``."""
    spark = docs.sparkSession
    needed = written(ids.select(F.col("set_id").alias("hash")).distinct(), "needed-sets")
    wanted = spark.sparkContext.broadcast(_filter_of(needed, needed.count()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(*text_bytes(batch.column(0))):
                values, at = shingle_sets(data, offsets, k)
                ids = set_ids(values, at)
                hit = np.flatnonzero((np.diff(at) > 0) & _hits(*wanted.value, _spread(ids)))
                _, first = np.unique(ids[hit], return_index=True)
                hit = hit[first]
                size = np.diff(at)[hit]
                bounds = np.concatenate([[0], np.cumsum(size)])
                picked = values[np.arange(bounds[-1]) + np.repeat(at[:-1][hit] - bounds[:-1], size)]
                six = np.ascontiguousarray(picked.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).reshape(-1)
                content = pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer((6 * bounds).astype(np.int32)), pa.py_buffer(six)])
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), content], ["set_id", "members"])

    found = docs.select("text").mapInArrow(sets, "set_id long, members binary")
    found = found.join(needed.select(F.col("hash").alias("set_id")), "set_id", "left_semi").groupBy("set_id").agg(F.first("members").alias("members"))
    return written(found, "full-sets")


def _verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, at_a = _six(batch.column(2))
            b, at_b = _six(batch.column(3))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]]
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    side = lambda c: found.select(F.col("set_id").alias(c), F.col("members").alias(f"m_{c}"))
    joined = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "m_u", "m_v")
    return joined.mapInArrow(check, "u long, v long")


def _spread(ids: np.ndarray) -> np.ndarray:
    return ids.view(np.uint64)


def _six(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sets of 48-bit members, and their n + 1 offsets."""
    data, offsets = text_bytes(column)
    wide = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    wide[:, 2:] = data.reshape(-1, 6)
    return wide.reshape(-1).view("<u8"), offsets // 6


def _left_over(members: DataFrame, percent: int) -> DataFrame:
    """Links ``u``, ``v`` between components in the buckets of ``members``.

    ``members`` has key, band, set_id, component, n, sketch and members.
    """
    per = members.groupBy("key", "component").agg(F.count("*").alias("size"))
    ranked = per.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("size").alias("all"), F.max(F.struct("size", "component")).alias("top"))
    crowd = written(ranked.where("kinds > 1").select("key", "all", F.col("top.component").alias("main"), (F.col("all") - F.col("top.size")).alias("outside")), "buckets-left")
    rows = members.join(crowd, "key")
    # blocks of the outside classes, each against blocks of all
    n_a = F.ceil(F.col("outside") / SIDE).cast("int")
    n_b = F.ceil(F.col("all") / (2 * SIDE)).cast("int")
    own = F.pmod(F.xxhash64("set_id"), n_a), F.pmod(F.xxhash64("set_id", F.lit(1)), n_b)
    a = rows.where("component <> main").select("*", own[0].cast("int").alias("i"), F.explode(F.sequence(F.lit(0), n_b - 1)).alias("j"), F.lit(True).alias("outer"))
    b = rows.select("*", F.explode(F.sequence(F.lit(0), n_a - 1)).alias("i"), own[1].cast("int").alias("j"), F.lit(False).alias("outer"))
    names = ["key", "i", "j", "outer", "band", "set_id", "component", "n", "sketch", "members"]
    blocks = a.select(names).unionByName(b.select(names)).groupBy("key", "i", "j")
    return blocks.applyInArrow(lambda block: _links_of_block(block, percent), "u long, v long")


def _links_of_block(block: pa.Table, percent: int) -> pa.Table:
    block = block.combine_chunks()
    outer = block.column("outer").to_numpy(zero_copy_only=False)
    band = block.column("band")[0].as_py()
    ids, comp, n = (block.column(c).to_numpy() for c in ("set_id", "component", "n"))
    sketch = _sketches(block.column("sketch").combine_chunks())
    sets, at = _six(block.column("members").combine_chunks())
    bands = sketch.reshape(len(sketch), -1, band_width(percent))
    inner = np.flatnonzero(~outer)
    comp = comp.copy()  # components that a link joins become one
    us, vs = [], []
    for x in np.flatnonzero(outer).tolist():
        y = inner[comp[inner] != comp[x]]
        y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
        # a pair belongs to the first band that it shares
        y = y[np.argmax((bands[y] == bands[x]).all(axis=2), axis=1) == band]
        if not len(y):
            continue
        like = estimate(np.broadcast_to(sketch[x], (len(y), REGISTERS)), sketch[y], np.full(len(y), float(n[x])), n[y].astype(float))
        order = np.argsort(-like, kind="stable")
        y = y[order[like[order] >= _lowest(percent)]]
        own = sets[at[x] : at[x + 1]]
        while len(y):
            some, y = y[:AT_ONCE], y[AT_ONCE:]
            size = at[some + 1] - at[some]
            ends = np.cumsum(size)
            theirs = sets[np.arange(ends[-1]) + np.repeat(at[some] - (ends - size), size)]
            place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            common = np.add.reduceat((own[place] == theirs).astype(np.int64), ends - size)
            for z in some[100 * common >= percent * (len(own) + size - common)].tolist():
                if comp[z] != comp[x]:
                    us.append(ids[x])
                    vs.append(ids[z])
                    comp[comp == comp[z]] = comp[x]
            y = y[comp[y] != comp[x]]
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``set_id`` and ``component`` after ``links`` (``u``, ``v``), of which only those between components count."""
    side = lambda c: labels.select(F.col("set_id").alias(c), F.col("component").alias(f"c_{c}"))
    between = links.join(side("u"), "u").join(side("v"), "v").where("c_u <> c_v")
    between = written(between.select(F.col("c_u").alias("u"), F.col("c_v").alias("v")).distinct(), "component-links")
    if between.isEmpty():
        return labels
    later = components(between).select(F.col("node").alias("component"), F.col("component").alias("_later"))
    named = labels.join(later, "component", "left").select("set_id", F.coalesce("_later", "component").alias("component"))
    return written(named, "set-components")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``row_key`` (hash of the text), ``n_shingles``, ``component_id``, ``kept`` and ``group`` of every row.

    ``component_id`` is the smallest id in the component, which other components
    share where ids are null or repeated. ``group`` tells all components apart;
    it is null for empty sets.
    """
    sets = written(document_sets(docs, k), "set-sketches")
    classes = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes, "set-classes")
    width = band_width(percent)
    buckets = written(band_rows(classes, width).groupBy("key").agg(F.count("*").alias("size"), F.min("set_id").alias("pivot")).where("size > 1"), "set-buckets")
    members = written(band_rows(classes, width).join(buckets.select("key", "pivot"), "key"), "set-members")
    found = full_sets(docs, members, k)
    pairs = members.where("set_id <> pivot").select(F.col("set_id").alias("u"), F.col("pivot").alias("v")).distinct()
    labels = written(members.select("set_id").distinct().withColumn("component", F.col("set_id")), "set-components")
    for turn in range(PIVOTS + 1):
        new = written(_verified(written(_likely(pairs, classes, percent), "pivot-pairs"), found, percent), "pivot-links")
        labels = _joined(labels, new)
        # the next draw leaves out what was tried, as it has met all others in its bucket
        untried = members.where("set_id <> pivot") if turn < PIVOTS else members
        named = untried.join(labels, "set_id").select("key", "band", "set_id", "component")
        drawn = F.min_by(F.struct("set_id", "component"), F.xxhash64("set_id", F.lit(turn))).alias("drawn")
        left = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), drawn).where("a <> b").select("key", "drawn")
        rest = written(named.join(left, "key"), "members-left")
        if rest.isEmpty():
            break
        if turn < PIVOTS:
            pairs = rest.where("component <> drawn.component").select(F.greatest("set_id", "drawn.set_id").alias("u"), F.least("set_id", "drawn.set_id").alias("v")).distinct()
            members = rest.select("key", "band", "set_id", F.col("drawn.set_id").alias("pivot"))
    else:
        last = rest.drop("drawn").join(classes.select("set_id", "n", "sketch"), "set_id").join(found, "set_id")
        labels = _joined(labels, written(_left_over(last, percent), "rest-links"))
    of_class = classes.join(labels, "set_id", "left").select("set_id", "rep", F.coalesce("component", "set_id").alias("component"))
    of_class = written(of_class, "class-components")
    name = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = written(of_class.join(name, "component").select("set_id", "component", "component_id"), "class-names")
    out = sets.select("doc_id", "row_key", F.col("n").alias("n_shingles"), "set_id").join(named, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "row_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.col("component").alias("group")
    )


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Of rows that share that id, the one with the smallest hash of its text stays,
    and of equal ones the smallest whole row. A null id comes after all others.
    Rows with empty sets all stay. The columns have to be of types with an order
    (no maps).
    """
    verdict = near_duplicates(docs, k, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    stays = written(verdict.where("group IS NOT NULL").groupBy("group").agg(first).select("first.doc_id", "first.row_key"), "components-first")
    row = as_row(docs).select("row", F.col("row.doc_id").cast("long").alias("id"), F.coalesce("row.text", F.lit("")).alias("text"))
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    keyed = row.where(worded).select("row", "id", F.xxhash64("text").alias("key"))
    kept = keyed.join(stays, keyed["id"].eqNullSafe(stays["doc_id"]) & (keyed["key"] == stays["row_key"]), "left_semi")
    kept = kept.groupBy("id", "key").agg(F.min("row").alias("row"))
    return columns_of(kept.select("row").unionByName(row.where(~worded).select("row")))
