"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

The shingles of a text are its runs of five lower-cased (A-Z) words, or its
whole sequence of words if it has fewer. Each shingle is hashed once: the
leading bits name a bin and each bin keeps its smallest hash. An empty bin
copies the first bin that is not empty in a sequence of bins drawn by a hash of
(bin, attempt), the same for all documents. A fingerprint holds the ``BITS``
low bits of each bin, two bins a byte, in hex.

Likeness corrects the chance agreement of ``BITS`` bits:
``(agreeing bins / bins - c) / (1 - c)`` with ``c = 2^-BITS``, within 0 and 1.

Defined cases: a text without words (or null) has the empty fingerprint, which
is like itself (1) and unlike all others (0). Equal texts have equal
fingerprints. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import LOWER, distinct_per_text, mix, prefix_hash, slices, span_hash, text_bytes, word_shingles, words

WORDS, BIN_BITS, BITS = 5, 9, 4
BINS = 1 << BIN_BITS
#: Text of one range of documents in :func:`edited_neighbours`.
RANGE_BYTES = 16 << 20


def signatures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low bits of each bin (texts x bins, uint8), and which texts have any shingle."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    shingles, at = word_shingles(span_hash(prefix_hash(data), starts, ends), first, WORDS)
    hashes, _, at = distinct_per_text(shingles, at)
    n = len(offsets) - 1
    cell = np.repeat(np.arange(n) * BINS, np.diff(at)) + (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    least = np.append(True, cell[1:] != cell[:-1]) if len(cell) else np.zeros(0, dtype=bool)
    out, full = np.zeros(n * BINS, dtype=np.uint8), np.zeros(n * BINS, dtype=bool)
    out[cell[least]] = (mix(hashes[least]) >> np.uint64(64 - BITS)).astype(np.uint8)
    full[cell[least]] = True
    some = np.diff(at) > 0
    empty = np.flatnonzero(~full & np.repeat(some, BINS))
    attempt = 0
    while len(empty):
        attempt += 1
        own = (empty & (BINS - 1)).astype(np.uint64)
        donor = (mix(own * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        donor += empty & ~(BINS - 1)
        found = full[donor]
        out[empty[found]] = out[donor[found]]
        empty = empty[~found]
    return out.reshape(n, BINS), some


def packed(bins: np.ndarray, some: np.ndarray) -> list[str]:
    """Hex fingerprints."""
    pairs = bins[:, ::2] << np.uint8(4) | bins[:, 1::2]
    return [row.tobytes().hex() if s else "" for row, s in zip(pairs, some.tolist())]


def likeness(bins: np.ndarray, some: np.ndarray, others: np.ndarray, other_some: np.ndarray) -> np.ndarray:
    chance = 2.0**-BITS
    agree = (bins == others).mean(axis=1)
    value = np.clip((agree - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some & other_some, value, np.where(some == other_some, 1.0, 0.0))


def _signatures_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [signatures(data, offsets) for _, _, data, offsets in slices(*text_bytes(column))]
    if not parts:
        return np.zeros((0, BINS), dtype=np.uint8), np.zeros(0, dtype=bool)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(*text_bytes(batch.column(1))):
                prints = packed(*signatures(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def in_ranges(docs: DataFrame) -> DataFrame:
    """``range``, ``ahead``, ``doc_id``, ``text`` by descending ``doc_id``, in partitions that follow each other.

    The first document of each range is also in the range before it, last and
    with ``ahead`` true; the first of all is so in the last range. One shuffle
    of the texts; only one id per range reaches the driver. Null ids come last,
    equal ids in the order of a hash of their text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // RANGE_BYTES))
    order = F.coalesce((-F.col("doc_id")).cast("double"), F.lit(float("inf")))  # null ids come last
    ids = rows.where("doc_id IS NOT NULL").select(order.alias("order"))
    cuts = sorted(set(ids.approxQuantile("order", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    edges = [-float("inf"), *(cuts or [0.0]), float("inf")]
    ranged = Bucketizer(splits=edges, inputCol="order", outputCol="range", handleInvalid="keep").transform(
        rows.withColumn("order", order)
    )
    ranged = ranged.select(F.col("range").cast("int").alias("range"), "doc_id", F.xxhash64("text").alias("hash"), "text")
    heads = ranged.groupBy("range").agg(F.min_by(F.struct("doc_id", "hash"), F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), "hash")).alias("head")).collect()
    heads = sorted(((r["range"], r["head"]["doc_id"], r["head"]["hash"]) for r in heads), key=lambda h: h[0])
    before = [(heads[i - 1][0], doc_id, h) for i, (_, doc_id, h) in enumerate(heads)]
    ahead = spark.createDataFrame(before, "before int, head_id long, head_hash long")
    is_head = ranged["doc_id"].eqNullSafe(ahead["head_id"]) & (ranged["hash"] == ahead["head_hash"])
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("ahead"))
    other = F.struct(F.col("before").alias("range"), F.lit(True).alias("ahead"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, other))
    dealt = ranged.join(F.broadcast(ahead), is_head, "left").select(F.explode(places).alias("place"), "doc_id", "hash", "text")
    dealt = dealt.select("place.range", "place.ahead", "doc_id", "hash", "text").repartitionById(len(edges), F.col("range"))
    return dealt.sortWithinPartitions("range", "ahead", F.col("doc_id").desc_nulls_last(), "hash").drop("hash")


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness.

    The edited text has the last third (floor) of the code points replaced by
    the first as many (or all) of the next document in descending ``doc_id``;
    after the last comes the first.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            for a, b, _, _ in slices(*text_bytes(batch.column(3)), 4 << 20):
                part = batch.slice(a, b - a)
                if held is not None:
                    part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                if part.num_rows > 1:
                    yield rows(part)
                held = part.slice(part.num_rows - 1)

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        """Results of all rows but the last, each with the row after it."""
        ranges, later = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)
        texts = part.column(3).to_pylist()
        own = np.flatnonzero((ranges[:-1] == ranges[1:]) & ~later[:-1])
        bins, some = _signatures_of(part.column(3))
        edited = []
        for i in own.tolist():
            cut = len(texts[i]) // 3
            edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
        new_bins, new_some = _signatures_of(pa.array(edited, pa.large_string()))
        columns = [
            part.column(2).take(pa.array(own)),
            pa.array([len(texts[i]) for i in own.tolist()], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array(packed(bins[own], some[own]), pa.string()),
            pa.array(packed(new_bins, new_some), pa.string()),
            pa.array(likeness(bins[own], some[own], new_bins, new_some)),
            pa.array(likeness(bins[own], some[own], bins[own + 1], some[own + 1])),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_ranges(docs).mapInArrow(run, schema)
