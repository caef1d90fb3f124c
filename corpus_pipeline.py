"""A training-corpus pipeline: language ID, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's docs.  All but the last return the columns of documents.  A stage learns and counts on
what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, language, neardup, packing, repeats
from siltstone.llm.common import fresh_path, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a repeated passage, and its words where these have fewer bytes.
PASSAGE = 240
WORDS = 51


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language stay, however short or mixed; `und` (no text, no letter) go."""
    out = language.identify(docs, *language.learn(docs), carry=("text", "lang", "source", "n_chars"))
    return out.where(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the least id, and of equal rows with that id one."""
    return neardup.one_of_each(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every byte of a repeated string of PASSAGE bytes or WORDS words; of a character that a cut divides nothing stays.  No document goes."""
    out = repeats.kept_bytes(docs, length=PASSAGE, words=WORDS, carry=("text", "lang", "source", "n_chars"), form="text")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length(text).cast("long")).alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage stay."""
    out = decontaminate.mark_benchmark(docs, read_table(spark, sf_dir, "benchmark"), carry=("text", "lang", "source", "n_chars"))
    return out.where(F.size("hit_words") == 0).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    pieces = packing.cut_pieces(docs, packing.tokenizer_path("word_bpe_49k.json"), "word")
    return packing.pack(pieces).select(F.col("k").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again, on documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
