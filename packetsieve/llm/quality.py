"""Quality rules: n-gram perplexity under a modified Kneser-Ney model, with bands for each language.

Each language has two models over lower-cased bytes, of order 6, so their size
is bound by the bytes that follow each other and not by the vocabulary. Spark
counts the n-grams of every reference text: all documents that pass the base
rules and have at most one symbol in ten words. Copies of a text count once, in
the models and in the quartiles. A hash of the text deals it to one of two
folds, and it is scored by the model of its language's other fold: no text is
scored by what it taught. Continuation counts, discounts and interpolation are
array work in buckets of n-grams. Scoring looks keys up in arrays sorted by
hash, which tasks load from files. A document is rejected when its perplexity lies outside the band of its
language and fold: the median of the reference texts there, less ``below`` or
plus ``above`` times the distance between their quartiles. From few texts the
quartiles are uncertain, and the band is wider by ``(n + WIDER) / n``.

Defined cases: a null text counts as empty, has one symbol (its end) and fails
the base rules; null languages form a language of their own; equal rows get
equal verdicts; an empty table gives no rows. Columns other than ``doc_id``,
``text`` and ``lang`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kneser_ney import MODEL_ROWS, SLOTS, Model, Pass, fit_kneser_ney, in_pass, loaded, passes_of, slots_of
from .tables import as_row, columns_of, written
from .textbytes import (
    LEADS,
    LOWER,
    SPACE,
    byte_ngrams,
    distinct_per_text,
    per_text,
    prefix_hash,
    slices,
    span_hash,
    text_bytes,
    word_shingles,
    words,
)

ORDER = 6
#: By so many distinct texts the distance between quartiles is twice as wide as measured.
WIDER = 8
#: Quartile distances below and above the median.
BELOW, ABOVE = 6.0, 6.0
#: Tenths of a thousandth of log10(perplexity): the classes in which quartiles are counted.
CLASSES = 10_000
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True

BASE_FIELDS = "doc_id long, lang string, row_key long, group long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def is_reference(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Which texts of a slice the model learns from."""
    n = stats["n_words"]
    return (n >= 20) & (100 * stats["n_repeat_words"] <= 30 * n) & (10 * stats["n_symbols"] <= n)


def _reference(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return is_reference(base_statistics(data, offsets))


def base_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text of a slice: words, their code points, symbols, repeated lines and words."""
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    prefix = prefix_hash(data)
    stats = {
        "n_words": np.diff(first),
        "word_chars": per_text(LEADS[data] & ~SPACE[data], offsets),
        "n_symbols": per_text(SYMBOL[data], offsets),
    }
    # lines: from a text's start or the byte after a \n to the next \n or its end
    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_text = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1]))
    line_ends = np.append(line_starts[1:] - 1, 0)
    last = np.append(line_text[1:] != line_text[:-1], True)
    line_ends[last] = offsets[line_text[last] + 1]
    spoken = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    hashes = span_hash(prefix, line_starts[spoken], line_ends[spoken])
    at = np.searchsorted(line_text[spoken], np.arange(n + 1))
    _, _, kinds = distinct_per_text(hashes, at)
    stats["n_dup_lines"] = np.diff(at) - np.diff(kinds)
    # words in 8-word windows that occur twice or more
    hashes = span_hash(prefix, starts, ends)
    windows, at = word_shingles(hashes, first, 8)
    values, times, kinds = distinct_per_text(windows, at)
    covered = np.zeros(len(starts) + 8, dtype=np.int64)
    for i in np.flatnonzero(per_text(times > 1, kinds)).tolist():
        several = values[kinds[i] : kinds[i + 1]][times[kinds[i] : kinds[i + 1]] > 1]
        found = first[i] + np.flatnonzero(np.isin(windows[at[i] : at[i + 1]], several))
        covered[found] += 1
        covered[found + 8] -= 1
    stats["n_repeat_words"] = per_text(np.cumsum(covered)[: len(starts)] > 0, first)
    return stats


def perplexity(docs: DataFrame, model: Model, group: Column | None = None) -> DataFrame:
    """``doc_id``, ``lang``, the base counts, ``n_bytes`` (with the end) and ``log10_prob`` of every row.

    ``group`` says which group's model scores a row.
    """
    base = [f.split()[0] for f in BASE_FIELDS.split(", ")]
    schema = f"{BASE_FIELDS}, n_bytes long, log10_prob double"
    by = (F.lit(0) if group is None else group).cast("long").alias("group")
    rows = docs.select(F.col("doc_id").cast("long"), "lang", row_key().alias("row_key"), by, "text")
    passes, times = passes_of(model, MODEL_ROWS)

    def score(part: Pass) -> DataFrame:
        owned = np.zeros(SLOTS, dtype=bool)
        owned[part.slots] = True

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kn = loaded(part.key, model, part.names)
            for batch in batches:
                for a, b, data, offsets in slices(*text_bytes(batch.column(4))):
                    stats = base_statistics(data, offsets)
                    grams, at = byte_ngrams(LOWER[data], offsets, model.order)
                    groups = np.repeat(batch.column(3).to_numpy()[a:b].view(np.uint64), np.diff(at))
                    if times > 1:
                        mine = owned[slots_of(grams, model)]
                        logs = np.zeros(len(grams))
                        logs[mine] = kn.log10(grams[mine], groups[mine])
                    else:
                        logs = kn.log10(grams, groups)
                    columns = [batch.column(i).slice(a, b - a) for i in range(4)]
                    columns += [pa.array(stats[name].astype(np.int64)) for name in base[4:]]
                    columns += [pa.array(np.diff(at)), pa.array(per_text(logs, at))]
                    yield pa.RecordBatch.from_arrays(columns, [*base, "n_bytes", "log10_prob"])

        return rows.where(in_pass(F.col("group"), part, model)).mapInArrow(run, schema)

    scored = score(passes[0])
    for part in passes[1:]:
        scored = scored.unionByName(score(part))
    if times == 1:
        return scored
    # Every row was read ``times`` times, and equal rows get equal scores.
    fields = [*base, "n_bytes"]
    added = scored.groupBy(*fields).agg(F.expr(f"CAST(count(*) DIV {times} AS INT)").alias("_m"), F.sum("log10_prob").alias("log10_prob"))
    every = F.explode(F.sequence(F.lit(1), "_m")).alias("_i")
    return added.select(*fields, (F.col("log10_prob") / F.col("_m")).alias("log10_prob"), every).drop("_i")


def row_key(prefix: str = "") -> Column:
    """Equal for rows with equal text and language, which get equal verdicts."""
    text, lang = F.col(f"{prefix}text"), F.col(f"{prefix}lang")
    return F.xxhash64(F.coalesce(text, F.lit("")), F.coalesce(lang, F.lit("")), lang.isNull())


def fold() -> Column:
    """The fold of a row, 0 or 1: the same for equal texts."""
    return F.pmod(F.xxhash64(F.lit("fold"), F.coalesce("text", F.lit(""))), F.lit(2)).cast("long")


def group_of(lang: Column, fold: Column) -> Column:
    """A number for the model of a language's fold."""
    return F.xxhash64(F.coalesce(lang, F.lit("")), lang.isNull(), fold)


def distinct_texts(docs: DataFrame, key: Column, bound: int = 1_000_000) -> DataFrame:
    """``text`` and ``lang`` of one row for each ``key``.

    Only texts with copies are shuffled, one of them for each task and key. Up to
    ``bound`` keys of such texts are broadcast.
    """
    rows = docs.select(key.alias("_key"), "text", "lang")
    several = written(rows.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key"), "text-copies")
    n = several.count()
    if not n:
        return rows.drop("_key")
    several = F.broadcast(several) if n <= bound else several
    once = rows.join(several, "_key", "left_anti")
    again = rows.join(several, "_key", "left_semi").groupBy("_key").agg(F.first("text").alias("text"), F.first("lang").alias("lang"))
    return once.unionByName(again).drop("_key")


def bands(scored: DataFrame, below: float, above: float) -> DataFrame:
    """``group``, ``lower`` and ``upper`` of log10(perplexity), from exact counts of its classes over distinct texts."""
    # copies count once; their sums may differ in the last digits
    distinct = scored.groupBy("group", "row_key").agg(F.min("log10_ppl").alias("log10_ppl"))
    classes = distinct.groupBy("group", F.floor(F.col("log10_ppl") * CLASSES).alias("class")).agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("group").orderBy("class")
    ranked = classes.select("group", "class", F.sum("n").over(up_to).alias("upto"), F.sum("n").over(Window.partitionBy("group")).alias("all"))
    quartile = [F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("class"))).alias(f"q{q}") for q in (1, 2, 3)]
    spread = (F.col("q3") - F.col("q1") + 1) / CLASSES * (1 + WIDER / F.col("all"))
    return ranked.groupBy("group").agg(F.max("all").alias("all"), *quartile).select(
        "group",
        (F.col("q2") / CLASSES - below * spread).alias("lower"),
        ((F.col("q2") + 1) / CLASSES + above * spread).alias("upper"),
    )


def quality(docs: DataFrame, below: float = BELOW, above: float = ABOVE, order: int = ORDER) -> DataFrame:
    """One row per document: base counts, ``base_failed``, ``log10_ppl``, its band, and ``kept``.

    The base rules fail fewer than 20 words, or over 30 % of the words in repeated
    8-word windows. A language's fold without reference texts has no band, and
    its documents are kept if they pass the base rules.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    reference = ~F.col("base_failed") & (10 * F.col("n_symbols") <= F.col("n_words"))
    other = group_of(F.col("lang"), 1 - fold())
    model = fit_kneser_ney(distinct_texts(docs, row_key()), order, _reference, group_of(F.col("lang"), fold()))
    scored = written(
        perplexity(docs, model, other).select(
            "*", failed.alias("base_failed"), (-F.col("log10_prob") / F.col("n_bytes")).alias("log10_ppl")
        ),
        "kn-scored",
    )
    band = bands(scored.where(reference), below, above)
    inside = F.col("log10_ppl").between(F.col("lower"), F.col("upper"))
    return scored.join(F.broadcast(band) if _few_languages(band) else band, "group", "left").select(
        *[c for c in scored.columns if c != "group"], "lower", "upper", (~F.col("base_failed") & F.coalesce(inside, F.col("lower").isNull())).alias("kept")
    )


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with all their columns."""
    rejected = quality(docs, **options).where(~F.col("kept")).select("doc_id", "row_key").distinct()
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (row_key("row.") == F.col("row_key"))
    return columns_of(as_row(docs).join(rejected, same, "left_anti"))


def _few_languages(band: DataFrame, bound: int = 100_000) -> bool:
    """Whether the bands may be broadcast: at most ``bound`` rows of a name and two numbers."""
    return band.limit(bound + 1).count() <= bound
