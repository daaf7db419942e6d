"""The queries of the operators in this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import Scratch, documents
from tessel.llm.decontam import find_contamination
from tessel.llm.licenses import scan_licenses
from tessel.llm.line_runs import ALONE_WORDS, LAST, repeated_runs
from tessel.llm.near_dup import near_duplicates
from tessel.llm.oracle import SQL  # noqa: F401
from tessel.llm.packing import pack
from tessel.llm.pseudo_likelihood import score_documents
from tessel.llm.quality import COUNTS, quality_rules
from tessel.llm.token_files import read_token_files, write_token_files
from tessel.llm.tokens import vocabulary_path
from tessel.llm.toxicity import toxicity
from tessel.llm.unit_dedup import repeated_spans


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each match."""
    return scan_licenses(documents(spark, sf_dir, "doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = quality_rules(documents(spark, sf_dir, "doc_id", "text", "source"), "doc_id")
    return ruled.select("row.doc_id", *COUNTS, "base_failed", "kept", "host_strict")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-files").path("set")
    write_token_files(documents(spark, sf_dir, "doc_id", "text"), path, vocabulary_path("byte_bpe_50k.json"))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(documents(spark, sf_dir, "doc_id", "text"), vocabulary_path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir, "doc_id", "text"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated.alias("contaminated"))


def op9_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each span to remove."""
    return repeated_spans(documents(spark, sf_dir, "doc_id", "text"))


def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each run of lines to delete."""
    runs = repeated_runs(documents(spark, sf_dir, "doc_id", "text"), alone_words=ALONE_WORDS)
    real = lambda x: F.nullif(F.col(x), F.lit(LAST))
    return runs.select(real("doc").alias("doc_id"), F.col("lines")[0].alias("first_line"), F.size("lines").cast("long").alias("n_lines"), "n_words", real("first_doc").alias("first_doc_id"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op6_pseudo_likelihood": op6_pseudo_likelihood,
    "op7_near_dup": op7_near_dup,
    "op8_decontamination": op8_decontamination,
    "op9_unit_dedup": op9_unit_dedup,
    "op10_line_runs": op10_line_runs,
    "op4_token_files": op4_token_files,
    "op5_packing": op5_packing,
}
