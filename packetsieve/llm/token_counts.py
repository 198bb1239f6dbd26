"""Token counts of flat token files, by a scan for the end-of-document id.

A file is a run of little-endian unsigned 16- or 32-bit ids without header or
index; each document ends with the separator. Files are read in blocks of
``BLOCK`` bytes by tasks of their own. A block finds its separators with one
vectorised comparison and counts the ids between them. A prefix scan over the
blocks' numbers of separators gives every piece the number of its document;
the pieces at the edges of blocks are added up, so a document may span any
number of blocks. Ids after the last separator count as a last document.

Defined cases: two separators in a row are a document of no ids; an empty file
has no document; a length that is no multiple of the width raises
``ValueError``. In the query a null text has no ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .storage import dealt, get, partition, put
from .tables import written
from .textbytes import slices, text_bytes
from .unigram import UnigramEncoder, Vocabulary

BLOCK = 4 << 20
FILE_BYTES = 16 << 20


def count_tokens(spark: SparkSession, folder: str, separator: int, width: int = 2, block: int = BLOCK, listed: DataFrame | None = None) -> DataFrame:
    """``name``, ``document`` (from 0 in its file) and ``n_tokens`` (without the separator) for the files of ``folder``."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    if listed is not None:
        files = files.join(listed.select("name"), "name", "left_semi")
    step = block // width * width
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))
    blocks = files.where("length > 0").select("name", "length", F.posexplode(starts).alias("block", "start"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, number, start in zip(*(c.to_pylist() for c in batch.columns)):
                if length % width:
                    raise ValueError(f"{name}: {length} bytes are no whole number of ids")
                ids = np.frombuffer(get(folder, name, start, min(step, length - start)), dtype=f"<u{width}")
                ends = np.flatnonzero(ids == separator)
                edges = np.concatenate([[-1], ends, [len(ids)]])
                pieces = np.diff(edges) - 1
                n = len(pieces)
                edge = np.zeros(n, dtype=bool)
                edge[[0, -1]] = True
                # the piece after the last separator is none if it is empty: whatever follows starts there
                columns = [pa.array([name] * n), pa.array(np.full(n, number)), pa.array(np.arange(n)), pa.array(pieces), pa.array(edge), pa.array(np.arange(n) < n - 1)]
                yield pa.RecordBatch.from_arrays(columns, ["name", "block", "piece", "n", "edge", "closed"])

    found = written(dealt(blocks, "name", "block").mapInArrow(scan, "name string, block long, piece long, n long, edge boolean, closed boolean"), "separator-scan")
    per_block = found.groupBy("name", "block").agg((F.count("*") - 1).alias("separators"))
    before = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = per_block.select("name", "block", F.coalesce(F.sum("separators").over(before), F.lit(0)).alias("base"))
    numbered = found.join(base, ["name", "block"]).select("name", (F.col("base") + F.col("piece")).alias("document"), "n", "edge", "closed")
    inner = numbered.where("NOT edge").select("name", "document", F.col("n").alias("n_tokens"))
    stitched = numbered.where("edge").groupBy("name", "document").agg(F.sum("n").alias("n_tokens"), F.max("closed").alias("closed"))
    return inner.unionByName(stitched.where("closed OR n_tokens > 0").select("name", "document", "n_tokens"))


def write_flat_files(docs: DataFrame, folder: str, vocabulary: Vocabulary, separator: int) -> DataFrame:
    """Write ``docs`` as flat 16-bit files; returns the written ``name``, ``document``, ``doc_id``."""
    if len(vocabulary.scores) > 1 << 16:
        raise ValueError("the vocabulary has ids of more than 16 bits")
    encoder = UnigramEncoder(docs, vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        ids: list[int | None] = []
        held = 0
        for batch in batches:
            for a, b, data, offsets in slices(*text_bytes(batch.column(1))):
                flat, at = encoder.encode(data, offsets)
                parts.append(np.insert(flat, at[1:], separator).astype("<u2").tobytes())
                ids += batch.column(0).slice(a, b - a).to_pylist()
                held += len(parts[-1])
                if held >= FILE_BYTES:
                    yield flush(parts, ids)
                    parts, ids, held = [], [], 0
        if ids:
            yield flush(parts, ids)

    def flush(parts: list[bytes], ids: list[int | None]) -> pa.RecordBatch:
        name = put(folder, f"part-{partition():06d}-{uuid.uuid4().hex[:8]}.bin", b"".join(parts))
        return pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(np.arange(len(ids))), pa.array(ids, pa.int64())], ["name", "document", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return written(rows.mapInArrow(write, "name string, document long, doc_id long"), "flat-files")


def document_token_counts(docs: DataFrame, vocabulary: Vocabulary, separator: int) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every row, counted in flat files written for it."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "flat")
    listed = write_flat_files(docs, folder, vocabulary, separator)
    names = listed.select("name").distinct()
    if not listed.limit(1).count():
        return listed.select("doc_id", F.col("document").alias("n_tokens"))
    counted = count_tokens(spark, folder, separator, listed=names)
    return listed.join(counted, ["name", "document"]).select("doc_id", "n_tokens")
