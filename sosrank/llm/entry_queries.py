"""The registered queries of the operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sosrank.llm import (
    best_fit_packing,
    byte_bpe,
    exact_dedup,
    hard_negatives,
    html_extraction,
    language_id,
    line_dedup,
    simhash_fingerprints,
    simhash_neardup,
    substring_dedup,
    token_output,
    toxicity,
    whitening,
)
from sosrank.llm.common import crc32_mod, read_table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"), batches=2)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_fingerprints.edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = crc32_mod("doc_id", 4) == 2
    dictionaries = language_id.fit(docs.filter(~held))
    return language_id.identify(docs, dictionaries, {"held_out": held})


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_neardup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(read_table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(read_table(spark, sf_dir, "documents"), WORD_BPE)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(read_table(spark, sf_dir, "documents"), WORD_BPE)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_bpe.encode(read_table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)
    return found.select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.dedup_lines(read_table(spark, sf_dir, "documents")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_exact_dedup, op2_document_fingerprints, op3_language_id, op4_toxicity, op5_simhash_neardup,
        op6_html_extraction, op7_best_fit_packing, op8_substring_dedup, op9_token_output, op10_byte_bpe,
        op11_hard_negatives, op12_line_dedup, op13_whitening)
}
ORACLES: dict[str, str] = {"op1_exact_dedup": exact_dedup.ORACLE, "op8_substring_dedup": substring_dedup.ORACLE,
                            "op11_hard_negatives": hard_negatives.ORACLE,
                            "op12_line_dedup": line_dedup.ORACLE}
