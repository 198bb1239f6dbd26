"""Phrase collocations by Rabin-Karp fingerprints.

Prefix sums of a polynomial give the fingerprint of every n-gram of a slice at
once. Fingerprints are counted first, as packed arrays that are dealt out by
their leading bits; only those that are frequent enough go on, as a Bloom filter
of bounded size. A further pass takes the occurrences that the filter lets
through, compares each with the first one of its fingerprint in the slice, byte
by byte, and makes text of the first ones only. Counts are then added up by
text, so neither a collision nor the filter can change a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, bloom_of
from .ranks import ranked
from .tables import written
from .textbytes import LOWER, U64, KeyCounter, count_keys, mix, prefix_hash, slices, span_hash, text_bytes

#: Bytes that end a piece, and those that end a word.
CUT = np.zeros(256, dtype=bool)
CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = CUT.copy()
GAP[[0x20, 0x09]] = True
NO_LANG = "und"
#: Text behind one bucket of fingerprints, and fingerprints that a task holds before it passes them on.
BUCKET_BYTES = 1 << 20
HELD_KEYS = 1 << 19
#: Text that is hashed at a time; small slices keep a worker's memory low.
SLICE_BYTES = 1 << 18
#: Phrases whose texts a task holds before it passes them on.
HELD_PHRASES = 200_000


class Words:
    """The words of a slice of texts, lower-cased (A-Z) and joined by single spaces.

    Any n-gram within a piece is one run of bytes in ``joined``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        inside = ~GAP[data]
        before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        before[edge] = False
        after[edge - 1] = False
        starts = np.flatnonzero(inside & ~before)
        self.sizes = np.flatnonzero(inside & ~after) + 1 - starts
        #: The text of each word, and a number that is equal for words of one piece only.
        self.text = np.searchsorted(offsets, starts, "right") - 1
        self.piece = np.cumsum(CUT[data])[starts] + self.text
        n = len(starts)
        self.at = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(self.sizes + 1, out=self.at[1:])
        self.joined = np.full(self.at[-1], 0x20, dtype=np.uint8)
        self.joined[np.arange(int(self.sizes.sum())) + np.repeat(np.arange(n), self.sizes)] = data[inside]
        self.prefix = prefix_hash(self.joined)

    def ngrams(self, n: int, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of all n-grams, and their fingerprints, salted by text."""
        last = len(self.sizes) - n + 1
        if last <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
        first = np.flatnonzero(self.piece[:last] == self.piece[n - 1 :]) if n > 1 else np.arange(last)
        keys = span_hash(self.prefix, self.at[first], self.end(first, n))
        return first, mix(keys + salts[self.text[first]])

    def end(self, first: np.ndarray, n: int) -> np.ndarray:
        return self.at[first + n] - 1


def _salts(langs: list[str]) -> np.ndarray:
    """A number for each language, so that equal n-grams of two languages have two fingerprints."""
    known = {lang: int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") for lang in set(langs)}
    return np.array([known[lang] for lang in langs], dtype=U64)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``data[a:a + size]`` equals ``data[b:b + size]``, for all pairs of starts; sizes are 1 or more."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    window = np.ndarray((len(data),), dtype="<u8", buffer=padded, strides=(1,))
    same, todo, at = np.ones(len(a), dtype=bool), np.arange(len(a)), 0
    while len(todo):
        left = np.minimum(sizes[todo] - at, 8)
        mask = U64(0xFFFFFFFFFFFFFFFF) >> (U64(8) * (8 - left).astype(U64))
        equal = ((window[a[todo] + at] ^ window[b[todo] + at]) & mask) == 0
        same[todo[~equal]] = False
        at += 8
        todo = todo[equal & (sizes[todo] > at)]
    return same


# Counting fingerprints


def _packed(bits: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys and their counts, one row for each bucket of leading bits."""
    bucket = (keys >> U64(64 - bits)).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(keys))
    for some in range(0, len(cuts) - 1, 256):
        ends = list(zip(cuts[some : some + 256].tolist(), cuts[some + 1 : some + 257].tolist()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[[a for a, _ in ends]], pa.int64()),
                pa.array([keys[a:b].tobytes() for a, b in ends], pa.binary()),
                pa.array([counts[a:b].astype(np.int64).tobytes() for a, b in ends], pa.binary()),
            ],
            ["bucket", "keys", "counts"],
        )


def _counted(rows: DataFrame, orders: list[int], bits: int, shorter) -> DataFrame:
    """``bucket``, ``keys`` and ``counts`` of the fingerprints of these orders, counted per task.

    ``shorter``, a broadcast filter of frequent fingerprints one order below,
    leaves out the n-grams of which either part is not frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = KeyCounter(HELD_KEYS)
        for batch in batches:
            salts = _salts(batch.column(0).to_pylist())
            for a, b, data, offsets in slices(*text_bytes(batch.column(1)), SLICE_BYTES):
                words = Words(data, offsets)
                for n in orders:
                    first, keys = words.ngrams(n, salts[a:b])
                    if shorter is not None and len(first):
                        parts, part_keys = words.ngrams(n - 1, salts[a:b])
                        frequent = np.zeros(len(words.sizes) + 1, dtype=bool)
                        frequent[parts] = shorter.value.has(part_keys)
                        keys = keys[frequent[first] & frequent[first + 1]]
                    counter.add(keys)
                if counter.full():
                    yield from _packed(bits, *counter.take())
        yield from _packed(bits, *counter.take())

    return rows.mapInArrow(run, "bucket long, keys binary, counts binary")


def _frequent(counted: DataFrame, least: int) -> DataFrame:
    """``keys`` with a total of ``least`` or more, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, held = None, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return count_keys(*(np.concatenate(x) for x in zip(*parts)))

        def passed() -> pa.RecordBatch:
            keys, counts = merged()
            return pa.RecordBatch.from_arrays([pa.array([keys[counts >= least].tobytes()], pa.binary())], ["keys"])

        for batch in batches:
            for own, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if own != bucket:
                    if parts:
                        yield passed()
                    bucket, parts, held = own, [], 0
                parts.append((np.frombuffer(keys.as_buffer(), dtype=U64), np.frombuffer(counts.as_buffer(), dtype=np.int64)))
                held += len(parts[-1][0])
                if held > HELD_KEYS:
                    parts = [merged()]
                    held = len(parts[0][0])
        if parts:
            yield passed()

    return counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "keys binary")


# From fingerprints to text


def _merged(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """The rows of all batches, one for each language and text."""
    table = pa.Table.from_batches(held).group_by(["lang", "n", "phrase"], use_threads=False)
    summed = table.aggregate([("a", "sum"), ("doc_id", "min")]).rename_columns(["lang", "n", "phrase", "a", "doc_id"])
    return summed.combine_chunks().to_batches()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together by text as they come; a task holds some ``HELD_PHRASES`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > 2 * HELD_PHRASES:
            held = _merged(held)
            rows = sum(b.num_rows for b in held)
            if rows > HELD_PHRASES:
                yield from _cut(held)
                held, rows = [], 0
    if held:
        yield from _cut(_merged(held))


def _cut(batches: list[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The runs of bytes as strings."""
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    gathered = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(gathered)).cast(pa.string())


TEXT_SCHEMA = "lang string, n int, phrase string, a long, doc_id long"


def _occurrences(rows: DataFrame, longest: int, frequent) -> DataFrame:
    """Text, count and an occurrence (``doc_id``) of each phrase in a task, and under n = 0 each language's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _summed(slice_rows(batches))

    def slice_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            salts = _salts(langs)
            for a, b, data, offsets in slices(*text_bytes(batch.column(1)), SLICE_BYTES):
                words = Words(data, offsets)
                names, ids = batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a)
                per_text = np.bincount(words.text, minlength=b - a)
                yield _row_batch(names, np.zeros(b - a, dtype=np.int32), pa.nulls(b - a, pa.string()), per_text, ids)
                for n in range(1, longest + 1):
                    yield _phrases(words, n, salts[a:b], frequent.value, names, ids)

    return rows.mapInArrow(run, TEXT_SCHEMA)


def _row_batch(langs: pa.Array, n: np.ndarray, phrases: pa.Array, counts: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs, pa.array(n, pa.int32()), phrases, pa.array(counts, pa.int64()), ids], ["lang", "n", "phrase", "a", "doc_id"])


def _phrases(words: Words, n: int, salts: np.ndarray, frequent: Bloom, langs: pa.Array, ids: pa.Array) -> pa.RecordBatch:
    first, keys = words.ngrams(n, salts)
    passed = frequent.has(keys)
    first, keys = first[passed], keys[passed]
    order = np.argsort(keys, kind="stable")
    first, keys = first[order], keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(new) - 1
    starts, sizes = words.at[first], words.end(first, n) - words.at[first]
    leader = np.flatnonzero(new)[group] if len(group) else group
    # An occurrence that differs from the first of its fingerprint is a row of its own.
    lang = langs.dictionary_encode().indices.to_numpy()[words.text[first]]
    same = (sizes == sizes[leader]) & (lang == lang[leader])
    same[same] = same_bytes(words.joined, starts[same], starts[leader[same]], sizes[same])
    counts = np.bincount(group, weights=same, minlength=int(new.sum())).astype(np.int64)
    chosen = np.concatenate([np.flatnonzero(new), np.flatnonzero(~same)])
    text = pa.array(words.text[first[chosen]])
    counts = np.concatenate([counts, np.ones(len(chosen) - len(counts), dtype=np.int64)])
    return _row_batch(langs.take(text), np.full(len(chosen), n, dtype=np.int32), _strings(words.joined, starts[chosen], sizes[chosen]), counts, ids.take(text))


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """``lang``, ``n``, ``phrase``, ``a`` and ``doc_id`` of all phrases of 1 to ``longest`` words with ``a`` of ``least`` or more.

    ``a`` counts all occurrences, ``doc_id`` is the smallest id of a document with
    one of the first occurrences (null where those have no id). A row with n = 0
    has the number of all words of a language.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(8, (size // BUCKET_BYTES).bit_length())
    found, filtered = [], None
    for orders in [list(range(1, min(longest, 2) + 1)), *[[n] for n in range(3, longest + 1)]]:
        found.append(written(_frequent(_counted(rows.drop("doc_id"), orders, bits, filtered), least), "frequent"))
        if orders[-1] < longest:
            filtered = spark.sparkContext.broadcast(bloom_of(found[-1]))
    keys = found[0]
    for more in found[1:]:
        keys = keys.unionByName(more)
    texts = _occurrences(rows, longest, spark.sparkContext.broadcast(bloom_of(keys)))
    counted = texts.groupBy("lang", "n", "phrase").agg(F.sum("a").alias("a"), F.min("doc_id").alias("doc_id"))
    return written(counted.where((F.col("a") >= least) | (F.col("n") == 0)), "phrases")


# Scores


def scored_phrases(phrases: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """``lang``, ``phrase``, ``n_in_phrase``, ``a``, ``l``, ``r``, ``score`` of the phrases of two words or more.

    A phrase is cut after each of its words but the last; the cut with the lowest
    score counts, and of equal ones the first. The numbers are decimals of 38
    digits until the score is floored.
    """
    known = phrases.select("lang", "phrase", "a")
    cuts = phrases.where("n >= 2").select("lang", "phrase", F.col("n").alias("n_in_phrase"), "a", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.withColumns({"front": F.expr("substring_index(phrase, ' ', k)"), "back": F.expr("substring_index(phrase, ' ', k - n_in_phrase)")})
    front = known.select("lang", F.col("phrase").alias("front"), F.col("a").alias("l"))
    back = known.select("lang", F.col("phrase").alias("back"), F.col("a").alias("r"))
    cuts = cuts.join(front, ["lang", "front"]).join(back, ["lang", "back"])
    wide = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    score = F.expr(f"(cast({scale} as decimal(7,0)) * wide_a * wide_a) div (wide_l * wide_r)")
    cuts = cuts.withColumns({f"wide_{c}": v for c, v in wide.items()}).withColumn("score", score)
    lowest = cuts.groupBy("lang", "phrase", "n_in_phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "n_in_phrase", "a", "cut.l", "cut.r", "cut.score")


def without_covered(scored: DataFrame, percent: int = 50) -> DataFrame:
    """Phrases that no longer one holds with at least ``percent`` of their count."""
    inner = F.expr(
        "flatten(transform(sequence(2, n_in_phrase - 1), m -> "
        "transform(sequence(1, n_in_phrase - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    )
    longer = scored.where("n_in_phrase >= 3").select("lang", F.explode(inner).alias("phrase"), "a")
    covers = longer.groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    kept = scored.join(covers, ["lang", "phrase"], "left").where(f"cover IS NULL OR 100 * cover < {percent} * a")
    return kept.drop("cover")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """The best ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those
    into words ``[^\\x20\\x09]+``. A null language is ``und``, a null or empty text
    has no word, and equal rows count each. Ranks go by score and count, both
    descending, then by the phrase's bytes. Further columns of ``docs`` are ignored.
    """
    phrases = frequent_phrases(docs, longest, least)
    words = phrases.where("n = 0").select("lang", F.col("a").alias("words"))
    kept = without_covered(written(scored_phrases(phrases), "scored"), percent)
    placed = ranked(kept, "lang", [F.col("score").desc(), F.col("a").desc(), "phrase"], "collocations").where(F.col("rank") < top)
    # One row for each language.
    named = placed.join(words, "lang").withColumn("n", F.col("words"))
    return named.select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
