"""The corpus pipeline: toxicity, near duplicates, benchmark passages, secrets, then SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; a stage's result is written as Parquet
and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soldlens.llm import decontaminate, ngram_join, secret_scan, sentencepiece_codec, toxicity
from soldlens.llm._shared import stash, table
from soldlens.llm.queries import model_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars follows the text."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, and the text's ids with the byte span of each."""
    return sentencepiece_codec.encode(docs, model_path(), keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("sentencepiece", encoded),
]
#: The stages learn models and encode with a model file, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
