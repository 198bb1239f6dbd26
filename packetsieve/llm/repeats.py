"""Suffix-array dedup: removal of all bytes that a long repeated string covers, across all documents.

Every string of ``size`` bytes has an anchor: the smallest hash among its
substrings of ``ANCHOR`` bytes. Equal strings have equal anchors, so all strings
that can repeat meet under their anchor. Consecutive strings with the same
anchor form a context; every string lies in exactly one context.

1. Contexts are counted by anchor, with their smallest and largest hash. One
   that is alone stops here, unless its anchor stands at several places in it
   (periodic text).
2. Where all contexts of an anchor are equal, they are repeated in full.
3. The other anchors' distinct contexts are dealt to shards by anchor. Each
   shard concatenates its contexts, builds their suffix array by induced sorting
   and the permuted common prefixes, and takes the positions whose prefix shared
   with a neighbour is ``size`` or longer. Contexts that occur more than once
   are repeated in full.
4. An anchor with more than ``GROUP`` distinct contexts would overfill a task:
   its strings are counted one by one instead, which is exact as well and splits
   over all tasks.
5. Runs go back to their documents, are united and cut out.

Defined cases: a null text is empty; texts shorter than ``size`` lose nothing;
rows with equal id and text are separate documents, so they repeat each other;
overlaps and repeats in one document count. Other columns keep their values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .suffix_array import repeated_starts, suffix_array
from .tables import written
from .textbytes import mix, prefix_hash, slices, span_hash, text_bytes

SIZE, ANCHOR = 200, 64
#: Distinct contexts of one anchor that a shard may take whole (some 270 bytes each).
GROUP = 4096
#: Bytes of contexts that one suffix array covers, and bits of the filter that spares contexts.
SHARD_BYTES, FILTER_BITS = 1 << 20, 28
#: Bytes of contexts that one task turns into suffix arrays.
TASK_BYTES = 4 << 20


def anchors(data: np.ndarray, offsets: np.ndarray, size: int = SIZE, k: int = ANCHOR) -> dict[str, np.ndarray]:
    """Of each context of a slice: text, anchor, start, end, hash of its bytes, and whether the anchor moves."""
    prefix = prefix_hash(data)
    n = len(data) - k + 1
    w = size - k + 1
    if n < w:
        none = np.zeros(0, dtype=np.int64)
        return {"text": none, "hash": none.astype(np.uint64), "start": none, "end": none, "context": none.astype(np.uint64), "moves": none.astype(bool)}
    at = np.arange(n)
    hashes = span_hash(prefix, at, at + k)
    bits = np.uint64(int(n).bit_length())
    keys = (hashes >> bits << bits) | at.astype(np.uint64)
    # smallest key of each window of w: suffix minima of one block, prefix minima of the next
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - w + 1)
    least = (np.minimum(behind[starts], ahead[starts + w - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - w + 1]
    inside = starts + size <= offsets[text + 1]
    starts, least, text = starts[inside], least[inside], text[inside]
    new = np.ones(len(starts), dtype=bool)
    moved = np.append(False, least[1:] != least[:-1])
    anchor = hashes[least]
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    moves = np.add.reduceat(moved & ~new, first) > 0 if len(first) else np.zeros(0, dtype=bool)
    last = np.append(first[1:], len(starts)) - 1
    begin, end = starts[first], starts[last] + size
    if not len(first):
        begin = end = np.zeros(0, dtype=np.int64)
    return {"text": text[first], "hash": anchor[first], "start": begin, "end": end, "context": span_hash(prefix, begin, end), "moves": moves}


def _key() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key")]


def _count_anchors(docs: DataFrame, size: int, k: int) -> DataFrame:
    """The written table ``hash``, ``mixed`` of the anchors that occur twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(*text_bytes(batch.column(0))):
                a = anchors(data, offsets, size, k)
                # a context that can repeat in itself counts twice, as two different ones
                rows = [np.concatenate([a["hash"], a["hash"][a["moves"]]]), np.concatenate([a["context"], ~a["context"][a["moves"]]])]
                yield pa.RecordBatch.from_arrays([pa.array(r.view(np.int64)) for r in rows], ["hash", "context"])

    counted = docs.select("text").mapInArrow(run, "hash long, context long").groupBy("hash")
    counted = counted.agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
    return written(counted.where("n > 1").select("hash", (F.col("a") != F.col("b")).alias("mixed")), "repeated-anchors")


def _filter_of(hashes: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """A bit for each value of the leading bits of the hashes: 16 bits a row, up to 2^FILTER_BITS.

    It only spares work: a set bit without its hash is found out by the join.
    """
    bits = min(FILTER_BITS, max(10, int(16 * rows).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for batch in batches:
            at = _bit(batch.column(0).to_numpy().view(np.uint64), bits)
            np.bitwise_or.at(field, at >> 3, (1 << (at & 7)).astype(np.uint8))
        used = np.flatnonzero(field)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(field[used].astype(np.int16))], ["at", "byte"])

    found = hashes.select("hash").mapInArrow(run, "at long, byte short").groupBy("at").agg(F.bit_or("byte").alias("byte")).toArrow()
    field = np.zeros((1 << bits) // 8, dtype=np.uint8)
    field[found.column("at").to_numpy()] = found.column("byte").to_numpy().astype(np.uint8)
    return field, bits


def _bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Anchors are small hashes, so they are mixed again before their leading bits count."""
    return (mix(hashes) >> np.uint64(64 - bits)).astype(np.int64)


def _hits(field: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    at = _bit(hashes, bits)
    return (field[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _occurrences(docs: DataFrame, repeated: DataFrame, size: int, k: int) -> DataFrame:
    """The written table of all contexts of repeated anchors; ``bytes`` is set where the anchor is mixed."""
    spark = docs.sparkSession
    rows, n_mixed = repeated.agg(F.count("*"), F.count(F.when(F.col("mixed"), 1))).first()
    every = spark.sparkContext.broadcast(_filter_of(repeated, rows))
    mixed = spark.sparkContext.broadcast(_filter_of(repeated.where("mixed"), n_mixed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, last, data, offsets in slices(*text_bytes(batch.column(2))):
                a = anchors(data, offsets, size, k)
                hit = np.flatnonzero(_hits(*every.value, a["hash"]))
                a = {c: v[hit] for c, v in a.items()}
                whole = _hits(*mixed.value, a["hash"])
                size_of = np.where(whole, a["end"] - a["start"], 0)
                bounds = np.concatenate([[0], np.cumsum(size_of)])
                picked = data[np.arange(bounds[-1]) + np.repeat(a["start"] - bounds[:-1], size_of)]
                content = pa.Array.from_buffers(pa.large_binary(), len(hit), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(picked)])
                keys = [batch.column(i).slice(row, last - row).take(pa.array(a["text"])) for i in (0, 1)]
                spans = [pa.array(a[c] - offsets[a["text"]]) for c in ("start", "end")]
                yield pa.RecordBatch.from_arrays(
                    [*keys, *[pa.array(a[c].view(np.int64)) for c in ("hash", "context")], *spans, content.cast(pa.binary())],
                    ["doc_id", "row_key", "hash", "context", "start", "end", "bytes"],
                )

    schema = "doc_id long, row_key long, hash long, context long, start long, end long, bytes binary"
    found = docs.select(*_key(), "text").mapInArrow(run, schema)
    return written(found.join(repeated, "hash"), "repeat-contexts")


def _shard_spans(contexts: DataFrame, size: int) -> DataFrame:
    """``hash``, ``context``, ``from``, ``to``: the repeated runs of distinct contexts ``(hash, context, n, bytes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        room = SHARD_BYTES
        for batch in batches:  # sorted by hash: an anchor's contexts follow each other
            if not batch.num_rows:
                continue
            hashes = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            sizes = np.add.reduceat(np.diff(text_bytes(batch.column(3))[1]), edges)
            at = 0
            for edge, bytes_of in zip(edges.tolist(), sizes.tolist()):
                same = edge == 0 and held and held[-1].column(0)[-1].as_py() == int(hashes[0])
                if room <= 0 and not same:
                    if edge > at:
                        held.append(batch.slice(at, edge - at))
                    yield solve(held)
                    held, at, room = [], edge, SHARD_BYTES
                room -= bytes_of
            held.append(batch.slice(at))
        if held:
            yield solve(held)

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        data, offsets = text_bytes(part.column(3))
        n = part.num_rows
        text = np.ones(len(data) + n + 1, dtype=np.int64)  # symbol 1 ends a context, 0 the text
        own = offsets + np.arange(n + 1)
        place = np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))
        text[place] = data.astype(np.int64) + 2
        text[-1] = 0
        repeated = repeated_starts(text, suffix_array(text, 258), size, size)
        row = np.repeat(np.arange(n), np.diff(own))
        at = np.arange(len(row))
        repeated = repeated[: len(row)] & (at + size < own[row + 1])
        several = part.column(2).to_numpy() > 1
        repeated |= several[row] & (at + size < own[row + 1])
        # runs of starts, each start covering size bytes
        hits = np.flatnonzero(repeated)
        new = np.ones(len(hits), dtype=bool)
        new[1:] = (row[hits[1:]] != row[hits[:-1]]) | (hits[1:] > hits[:-1] + size)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(hits)) - 1 if len(hits) else first
        rows = row[hits[first]]
        columns = [part.column(i).take(pa.array(rows)) for i in (0, 1)]
        columns += [pa.array(hits[first] - own[rows]), pa.array(hits[last] - own[rows] + size)]
        return pa.RecordBatch.from_arrays(columns, ["hash", "context", "from", "to"])

    # Suffix arrays cost time by bytes: tasks have a fixed number of them, which no merging of partitions changes.
    total = contexts.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    ordered = contexts.repartition(max(1, -(-total // TASK_BYTES)), "hash").sortWithinPartitions("hash")
    return ordered.select("hash", "context", "n", "bytes").mapInArrow(run, "hash long, context long, from long, to long")


def _window_spans(contexts: DataFrame, size: int) -> DataFrame:
    """The same for the contexts of crowded anchors, by counting their strings of ``size`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, last, data, offsets in slices(*text_bytes(batch.column(3))):
                windows = np.maximum(np.diff(offsets) - size + 1, 0)
                ends = np.cumsum(windows)
                at = np.arange(ends[-1]) + np.repeat(offsets[:-1] - (ends - windows), windows)
                owner = np.repeat(np.arange(last - row), windows)
                prefix = prefix_hash(data)
                value = span_hash(prefix, at, at + size)
                # a second, independent hash of the string
                other = span_hash(prefix_hash(data ^ np.uint8(0x55)), at, at + size)
                keys = [batch.column(i).slice(row, last - row).take(pa.array(owner)) for i in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(at - offsets[owner]), pa.array(value.view(np.int64)), pa.array(mix(other).view(np.int64))],
                    ["hash", "context", "n", "from", "value", "other"],
                )

    rows = contexts.select("hash", "context", "n", "bytes").mapInArrow(run, "hash long, context long, n long, from long, value long, other long")
    counts = rows.groupBy("value", "other").agg(F.sum("n").alias("times"))
    found = rows.join(counts.where("times > 1"), ["value", "other"])
    return found.select("hash", "context", "from", (F.col("from") + size).alias("to"))


def repeated_spans(docs: DataFrame, size: int = SIZE, k: int = ANCHOR) -> DataFrame:
    """``doc_id``, ``row_key`` (hash of the text) and ``spans``: the repeated runs of each document that has any."""
    occurrences = _occurrences(docs, _count_anchors(docs, size, k), size, k)
    mixed = occurrences.where("mixed")
    distinct = mixed.groupBy("hash", "context").agg(F.count("*").alias("n"), F.first("bytes").alias("bytes"))
    distinct = written(distinct, "repeat-distinct")
    crowded = distinct.groupBy("hash").agg(F.count("*").alias("kinds")).where(F.col("kinds") > GROUP).select("hash")
    crowded = written(crowded, "repeat-crowded")
    spans = _shard_spans(distinct.join(crowded, "hash", "left_anti"), size)
    if crowded.limit(1).count():
        spans = spans.unionByName(_window_spans(distinct.join(crowded, "hash", "left_semi"), size))
    spans = written(spans.groupBy("hash", "context").agg(F.collect_list(F.struct("from", "to")).alias("runs")), "repeat-runs")
    runs = mixed.select("doc_id", "row_key", "hash", "context", "start").join(spans, ["hash", "context"]).select(
        "doc_id", "row_key", F.explode("runs").alias("run"), "start"
    )
    parts = runs.select("doc_id", "row_key", (F.col("start") + F.col("run.from")).alias("start"), (F.col("start") + F.col("run.to")).alias("end"))
    parts = parts.unionByName(occurrences.where("NOT mixed").select("doc_id", "row_key", "start", "end"))
    # Rows with equal id and text have equal spans: as a set they are no more than those of one row.
    return parts.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def unite(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the given ones (touching runs are one)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def _cut(docs: DataFrame, size: int, k: int, cut, schema: str) -> DataFrame:
    """``docs`` with their spans through ``cut(raw bytes, starts, ends, row)``."""
    names = docs.columns
    spans = repeated_spans(docs, size, k).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "spans")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *[c.alias(f"_{i}") for i, c in enumerate(_key())])
    same = F.col("_0").eqNullSafe(F.col("_id")) & (F.col("_1") == F.col("_key"))
    return keyed.join(spans, same, "left").select(F.col("row"), F.col("spans")).mapInArrow(cut, schema)


def _runs_of(spans: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.array([(s["start"], s["end"]) for s in spans], dtype=np.int64)
    return unite(pairs[:, 0], pairs[:, 1])


def removal_digests(docs: DataFrame, size: int = SIZE, k: int = ANCHOR) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of every row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = batch.column(0).field("text")
            for i in range(batch.num_rows):
                raw = (texts[i].as_py() or "").encode()
                starts, ends = _runs_of(batch.column(1)[i].as_py())
                edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(raw)]
                sha = hashlib.sha256()
                for a, b in zip(edges[::2], edges[1::2]):
                    sha.update(raw[a:b])
                rows.append((len(raw), int((ends - starts).sum()), len(starts), sha.hexdigest()))
            columns = [batch.column(0).field("doc_id"), *[pa.array([r[j] for r in rows], t) for j, t in enumerate([pa.int64()] * 3 + [pa.string()])]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _cut(slim, size, k, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, size: int = SIZE, k: int = ANCHOR) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text``; a code point that is partly covered stays whole.

    ``n_chars``, where the table has it, is the new length; null texts stay null.
    """
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for row, spans in zip(rows, batch.column(1).to_pylist()):
                if spans and row["text"]:
                    raw = np.frombuffer(row["text"].encode(), dtype=np.uint8)
                    starts, ends = _runs_of(spans)
                    lead = (raw & 0xC0) != 0x80
                    keep = np.ones(len(raw), dtype=bool)
                    for a, b in zip(starts.tolist(), ends.tolist()):
                        while a < b and not lead[a]:
                            a += 1
                        while b > a and b < len(raw) and not lead[b]:
                            b -= 1
                        keep[a:b] = False
                    row["text"] = raw[keep].tobytes().decode()
                    if "n_chars" in row:
                        row["n_chars"] = len(row["text"])
            yield from pa.Table.from_pylist(rows, schema=arrow_schema(schema)).to_batches()

    return _cut(docs, size, k, cut, schema)


def arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
