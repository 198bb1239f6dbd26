"""A corpus pipeline over ``documents``: each stage works on all that the one before it kept.

Every stage keeps null and empty texts as its operator defines them, and ignores
further columns; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetsieve.llm.mixing import label_domains, mixed
from packetsieve.llm.quality import kept_documents
from packetsieve.llm.queries import MIX, vocabulary
from packetsieve.llm.repeats import without_repeats
from packetsieve.llm.setsketch import one_of_each
from packetsieve.llm.tables import table, written
from packetsieve.llm.unigram import encode, from_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose perplexity lies in the band of their language."""
    return kept_documents(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more on five-word shingles."""
    return one_of_each(docs, k=5, percent=80).select(*COLUMNS)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes and more that stand anywhere else as well."""
    return without_repeats(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their document's rate says, so that token totals by domain meet the targets."""
    return mixed(docs, label_domains(table(spark, sf_dir, "labels")), MIX).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row."""
    ids = encode(docs, from_model(vocabulary("piece_bpe_32k.model")), keep=("doc_id", "lang", "source"))
    return ids.select("*", F.size("ids").alias("n_ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("suffix-array dedup", repeat_removal),
    ("mixing", mixing),
    ("unigram encoding", encoding),
]
#: Perplexity, sketches and suffix arrays have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
