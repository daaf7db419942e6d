"""A corpus pipeline over `documents`: quality rules, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last give the columns of `docs`.

Decisions are about rows: each text is judged by itself, whatever its doc_id, so rows with a null or
a repeated doc_id are treated as any others. Of rows that are equal in doc_id and text, near dedup
keeps one. Null and empty texts break a quality rule; where a stage meets them all the same, it keeps
them, and packing gives the end id. An empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import Scratch, joined, tuned
from tessel.llm.decontam import find_contamination
from tessel.llm.line_runs import line_dedup
from tessel.llm.near_dup import near_duplicates
from tessel.llm.packing import pack
from tessel.llm.quality import quality_rules
from tessel.llm.tokens import vocabulary_path

#: Words of a line that is a run by itself; tests/llm/test_pipeline.py holds lines of 11 words to the rule of two lines.
ALONE_WORDS = 12


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep."""
    return quality_rules(docs).where("kept").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated runs of lines; those left without a word go."""
    return line_dedup(docs, alone_words=ALONE_WORDS)


#: Pieces of text whose ids a packing worker keeps; fewer than op5's, as the executors hold what earlier stages left.
KEPT_PIECES = 60_000
#: Rows of two numbers that a stage broadcasts at most; they are counted.
MOST_GONE = 500_000


def text_key() -> Column:
    """A text, as a hash of it."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def doc_key() -> Column:
    """doc_id, null last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_key")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` whose keys (the columns of `gone`) aren't in `gone`."""
    keys = [{"text_key": text_key(), "doc_key": doc_key()}[x] for x in gone.columns]
    return joined(docs.select(F.struct(*docs.columns).alias("row"), *keys), gone, gone.columns, "left_anti", MOST_GONE).select("row.*")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id, and of these the least hash of the text."""
    scratch = Scratch(spark, "near-dup-stage")
    found = near_duplicates(docs.select(text_key().alias("doc_id"), "text")).where("n_shingles > 0")
    texts = scratch.save(found.select(F.col("doc_id").alias("text_key"), F.col("component_id").alias("group")).distinct(), "texts")
    rows = scratch.save(docs.select(doc_key(), text_key()), "rows")
    grouped = scratch.save(rows.join(texts, "text_key"), "grouped")
    best = grouped.groupBy("group").agg(F.min(F.struct("doc_key", "text_key")).alias("best"), F.count("*").alias("n")).where("n > 1").select("group", "best")
    gone = grouped.join(scratch.save(best, "best"), "group").where(F.struct("doc_key", "text_key") != F.col("best")).select("doc_key", "text_key").distinct()
    left = without(docs, scratch.save(gone, "gone"))
    equal = scratch.save(rows.groupBy("doc_key", "text_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_key", "text_key"), "equal")
    if equal.isEmpty():
        return left
    keyed = left.select(F.struct(*left.columns).alias("row"), doc_key(), text_key())
    one = keyed.join(equal.hint("merge"), ["doc_key", "text_key"], "left_semi").dropDuplicates(["doc_key", "text_key"])
    return without(left, equal).unionByName(one.select("row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark phrases."""
    found = find_contamination(docs.select(text_key().alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return without(docs, Scratch(spark, "contaminated").save(bad.select(F.col("doc_id").alias("text_key")).distinct(), "gone"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, with their ids."""
    packed = pack(docs, vocabulary_path("word_bpe_49k.json"), kept_pieces=KEPT_PIECES, keep=False)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Tokenising isn't expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over all of `documents`."""
    scratch = Scratch(tuned(spark), "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
        docs = out
    return docs
