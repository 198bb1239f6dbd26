"""One query per operator over the test tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_round_trip
from .collocations import collocations
from .context_tree import tree_scores
from .fingerprints import edited_neighbours
from .merkle import changed_third, versions
from .mixing import label_domains, mixing_rates
from .oracles import CHAT, COLLOCATIONS, MERKLE
from .quality import quality
from .rans import token_file_digests
from .repeats import removal_digests
from .setsketch import near_duplicates
from .tables import table
from .token_counts import document_token_counts
from .unigram import from_model
from .unigram import round_trip as unigram_round_trip
from .warc import round_trip


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return scored.select("doc_id", *base, "base_failed", "kept", "lang", "log10_ppl", "lower", "upper")


def op4_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
    return linked.select("doc_id", "n_shingles", "component_id", "kept")


def op5_unigram_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_round_trip(table(spark, sf_dir, "documents"), from_model(vocabulary("piece_bpe_32k.model")))


#: Shares of all tokens by domain: toxic text is almost left out, and clean text fills its place.
MIX = {"clean": 0.998, "toxic": 0.002}


def op6_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing_rates(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), MIX)
    shares = [F.coalesce(F.col("posteriors")[d], F.lit(0.0)).alias(f"p_{d}") for d in MIX]
    return rates.select("doc_id", "n_tokens", *shares, "rate", "copies")


def op7_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))


def op8_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return tree_scores(table(spark, sf_dir, "documents"), held_out)


def op2_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op3_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = from_model(vocabulary("piece_bpe_32k.model"))
    return document_token_counts(table(spark, sf_dir, "documents"), pieces, separator=2)


def op10_one_permutation_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents"))


def op11_rabin_karp_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_merkle_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = versions(table(spark, sf_dir, "documents"), changed_third())
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_round_trip(given.unionByName(planted))


QUERIES = {
    "op1_kneser_ney_quality": op1_kneser_ney_quality,
    "op2_zstd_warc": op2_zstd_warc,
    "op3_rans_token_files": op3_rans_token_files,
    "op4_setsketch_near_duplicates": op4_setsketch_near_duplicates,
    "op5_unigram_viterbi": op5_unigram_viterbi,
    "op6_soft_membership_mixing": op6_soft_membership_mixing,
    "op7_suffix_array_repeats": op7_suffix_array_repeats,
    "op8_context_tree_scores": op8_context_tree_scores,
    "op9_separator_scan": op9_separator_scan,
    "op10_one_permutation_fingerprints": op10_one_permutation_fingerprints,
    "op11_rabin_karp_collocations": op11_rabin_karp_collocations,
    "op12_merkle_versions": op12_merkle_versions,
    "op13_chat_round_trip": op13_chat_round_trip,
}
ORACLES = {
    "op11_rabin_karp_collocations": COLLOCATIONS,
    "op12_merkle_versions": MERKLE,
    "op13_chat_round_trip": CHAT,
}
