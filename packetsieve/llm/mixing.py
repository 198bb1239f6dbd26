"""Soft-membership mixing: rates per document whose expected token totals by domain meet targets.

1. A labelled table trains a naive Bayes classifier on which words a document
   has. It learns from at most ``LABELLED`` labelled documents, those whose ids
   have the smallest hashes. Words are known by a 64-bit hash. Of all V words of
   these documents it uses those whose information about the domain is at least
   ln(V) nats, which chance alone gives to fewer than one word: the odds of the
   others are within chance, and their errors would add up with a text's length.
   It gives every document a posterior over the domains, which are the labels'
   values. One pass cuts all texts into words and finds those of the model.
2. Projected-gradient least squares fits a rate of at least 0 per document. The
   residual is ``sum(rate * tokens * posterior) - target`` for each domain; a
   step takes ``posterior . g`` off every rate and projects to 0. ``g`` is the
   residual scaled by the Gram matrix of the posteriors (ridge added), halved
   until the residual falls. A rate is a function of the document's posterior
   and the steps so far, so the state is the list of steps: nothing is kept
   per document, and an iteration is one sum over all of them.
3. A document appears ``floor(rate)`` times, and once more with a chance of the
   rest, drawn by a hash of its id.

Everything is DataFrame expressions. The driver sees domain sums only.

Defined cases: a null text has no words and gets the prior; rows with equal ids
share one rate (their words are pooled); rows without an id share one with those
of the same text only. A label that is null or without its document is ignored. Without labels there is
one domain, "all". An empty table gives no rows. A domain without a target has
target 0; targets out of reach are met as closely as rates of at least 0 can.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import as_row, columns_of, written

#: Labelled documents that the classifier learns from at most.
LABELLED = 20_000
#: Words of the classifier that one broadcast may hold; more are joined by shuffle.
BROADCAST_WORDS = 1_000_000
RIDGE, STEPS, TOLERANCE = 1e-6, 40, 1e-6
#: Stands in every row once; no word is empty.
EVERY_ROW = ""
KEY = ["doc_id", "text_key"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` (tells rows without id apart by their text) and ``text``."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    return docs.select(doc_id.alias("doc_id"), F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(0).alias("text_key"), text.alias("text"))


def _words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text, and empty ones at its ends."""
    return F.split(text, "[\\x20\\x09-\\x0D]+")


def _word_key(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def learned_from(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``doc_id``, ``domain`` and ``text`` of the labelled rows that the classifier learns from."""
    known = labels.where("domain IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most ``most`` rows of two small values.
    return _keyed(docs).join(F.broadcast(written(known, "mixing-labels")), "doc_id").select("doc_id", "domain", "text")


def fit_classifier(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[DataFrame, dict[str, float]]:
    """``word``, ``logs`` (a log odds of presence per domain, in order), and the log prior of each domain.

    ``labels`` has ``doc_id`` and ``domain``.
    """
    labelled = learned_from(docs, labels, most)
    words = labelled.select("doc_id", "domain", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    words = words.select("doc_id", "domain", F.when(F.col("word") != "", _word_key(F.col("word"))).alias("word")).distinct()
    counts = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count_distinct("doc_id").alias("n")).collect()}
    if not counts:
        return docs.sparkSession.createDataFrame([], "word long, logs array<double>"), {"all": 0.0}
    domains = sorted(counts)
    seen = words.where("word IS NOT NULL").groupBy("word").agg(
        *[F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)]
    )
    seen = written(seen, "mixing-words")
    all_of, kinds = sum(counts.values()), seen.count()
    p = [(F.col(f"n{i}") + 0.5) / (counts[d] + 1.0) for i, d in enumerate(domains)]
    # mutual information of a word's presence and the domain, in nats times documents
    found = sum(F.col(f"n{i}") for i in range(len(domains)))
    cell = lambda n, row, column: F.when(n > 0, n * F.ln(n * all_of / (row * column))).otherwise(0.0)
    told = sum(cell(F.col(f"n{i}"), found, counts[d]) + cell(counts[d] - F.col(f"n{i}"), all_of - found, counts[d]) for i, d in enumerate(domains))
    seen = seen.where(told >= float(np.log(max(kinds, 1))))
    seen = seen.select("word", F.array(*[F.ln(x / (1 - x)) for x in p]).alias("logs"), F.array(*[F.ln(1 - x) for x in p]).alias("absent"))
    seen = written(seen, "mixing-model")
    missing = seen.agg(*[F.sum(F.col("absent")[i]).alias(str(i)) for i in range(len(domains))]).first()
    prior = {d: float(np.log(counts[d] / all_of) + (missing[i] or 0.0)) for i, d in enumerate(domains)}
    return seen.select("word", "logs"), prior


def posteriors(docs: DataFrame, model: DataFrame, prior: dict[str, float]) -> DataFrame:
    """Written: ``doc_id``, ``text_key``, ``n_tokens``, and ``posterior`` (array in the order of ``prior``) of each id.

    Each row's distinct words are looked up in the model, together with an entry that
    every row has and that carries its number of words, so nothing else reads the texts.
    """
    n = len(prior)
    spark = docs.sparkSession
    mark = spark.range(1).select(F.xxhash64(F.lit(EVERY_ROW)).alias("word"), F.lit(None).cast("array<double>").alias("logs"))
    known = model.unionByName(mark)
    few = model.count() <= BROADCAST_WORDS
    rows = _keyed(docs).select(*KEY, _words(F.col("text")).alias("words"))
    ends = (F.element_at("words", 1) == "").cast("long") + ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("long")
    rows = rows.select(*KEY, (F.size("words") - ends).alias("n_tokens"), F.explode(F.array_distinct(F.concat(F.array(F.lit(EVERY_ROW)), "words"))).alias("word"))
    rows = rows.select(*KEY, _word_key(F.col("word")).alias("word"), F.when(F.col("word") == EVERY_ROW, F.col("n_tokens")).alias("n_tokens"))
    hits = rows.join(F.broadcast(known) if few else known, "word")
    # rows of one id may share words, and so may spellings with capitals
    hits = hits.groupBy(*KEY, "word").agg(F.first("logs").alias("logs"), F.sum("n_tokens").alias("n_tokens"))
    scored = hits.groupBy(*KEY).agg(F.sum("n_tokens").alias("n_tokens"), *[F.sum(F.col("logs")[i]).alias(f"l{i}") for i in range(n)])
    score = [F.lit(v) + F.coalesce(F.col(f"l{i}"), F.lit(0.0)) for i, v in enumerate(prior.values())]
    largest = F.greatest(*score) if n > 1 else score[0]
    shifted = scored.select(*KEY, "n_tokens", F.array(*[F.exp(s - largest) for s in score]).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return written(shifted.select(*KEY, "n_tokens", F.transform("e", lambda x: x / total).alias("posterior")), "mixing-posteriors")


def rate(steps: list[list[float]]) -> Column:
    """A document's rate after the given steps, from 1."""
    if not steps:
        return F.lit(1.0)
    dot = lambda g: F.aggregate(F.zip_with("posterior", g, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    every = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps])
    return F.aggregate(every, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - dot(g)))


def fit_rates(members: DataFrame, targets: list[float]) -> tuple[list[list[float]], list[float], list[float]]:
    """The steps, and the tokens by domain before and after them."""
    n = len(targets)
    at = lambda i: F.col("posterior")[i]

    def totals(steps: list[list[float]]) -> np.ndarray:
        r = rate(steps)
        row = members.select("n_tokens", "posterior", r.alias("r")).agg(*[F.coalesce(F.sum(F.col("r") * F.col("n_tokens") * at(i)), F.lit(0.0)).alias(str(i)) for i in range(n)]).first()
        return np.array(row, dtype=float)

    def gram(steps: list[list[float]]) -> np.ndarray:
        """Sums of tokens * p_i * p_j over the documents whose rate is above 0."""
        active = members.where(rate(steps) > 0)
        pairs = [(i, j) for i in range(n) for j in range(i, n)]
        row = active.agg(*[F.coalesce(F.sum(F.col("n_tokens") * at(i) * at(j)), F.lit(0.0)).alias(f"{i}_{j}") for i, j in pairs]).first()
        out = np.zeros((n, n))
        for (i, j), v in zip(pairs, row):
            out[i, j] = out[j, i] = v
        return out

    target = np.array(targets, dtype=float)
    scale = max(1.0, target.sum())
    steps: list[list[float]] = []
    first = now = totals(steps)
    while len(steps) < STEPS:
        residual = now - target
        error = np.abs(residual).max() / scale
        if error <= TOLERANCE or not now.any() and not steps:
            break
        g = np.linalg.solve(gram(steps) + RIDGE * scale * np.eye(n), residual)
        size = 1.0
        while True:
            step = (size * g).tolist()
            later = totals([*steps, step])
            gained = 1 - np.square(later - target).sum() / np.square(residual).sum()
            if gained > 0 or size < 1e-3:
                break
            size /= 2
        if gained < 1e-6:
            break
        steps.append(step)
        now = later
    return steps, first.tolist(), now.tolist()


def _rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float], growth: float) -> DataFrame:
    """Key, ``n_tokens``, ``posteriors``, ``rate`` and ``copies`` of each id."""
    model, prior = fit_classifier(docs, labels)
    domains = list(prior)
    members = posteriors(docs, model, prior)
    total = members.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    wanted = {d: targets.get(d, 0.0) for d in domains} if len(domains) > 1 else {domains[0]: 1.0}
    norm = sum(wanted.values()) or 1.0
    steps, _, _ = fit_rates(members, [growth * total * wanted[d] / norm for d in domains])
    drawn = (F.pmod(F.xxhash64(F.lit("mixing"), *KEY), F.lit(1 << 32)) / F.lit(float(1 << 32))) < (F.col("rate") - F.floor("rate"))
    rated = members.withColumn("rate", rate(steps))
    names = F.array(*[F.lit(d) for d in domains])
    return rated.select(*KEY, "n_tokens", F.map_from_arrays(names, "posterior").alias("posteriors"), "rate", (F.floor("rate") + drawn.cast("long")).alias("copies"))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], growth: float = 1.0) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``posteriors`` (map by domain), ``rate`` and ``copies`` of each id.

    ``targets`` are shares of the wanted total, which is ``growth`` times all tokens.
    """
    return _rated(docs, labels, targets, growth).drop("text_key")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], growth: float = 1.0) -> DataFrame:
    """``docs`` with every row as often as the rate of its id says."""
    rates = written(_rated(docs, labels, targets, growth).select(*KEY, "copies").where("copies > 0"), "mixing-copies")
    rows, doc_id = as_row(docs), F.col("row.doc_id").cast("long")
    text_key = F.when(doc_id.isNull(), F.xxhash64(F.coalesce("row.text", F.lit("")))).otherwise(0)
    joined = rows.join(rates, doc_id.eqNullSafe(F.col("doc_id")) & (text_key == F.col("text_key")))
    return columns_of(joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))))


def label_domains(labels: DataFrame) -> DataFrame:
    """The label table's domains, "toxic" and "clean"."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("domain"))
