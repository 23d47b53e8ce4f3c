"""Queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from soldlens.llm import bm25, chat, decontaminate, html_extract, importance, ngram_join, secret_scan, sentencepiece_codec, toxicity, url_filter
from soldlens.llm._shared import table


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark, sf_dir):
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_join(spark, sf_dir):
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), model_path())


def op5_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_importance(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_top_k(spark, sf_dir):
    return bm25.every_twentieth(table(spark, sf_dir, "documents"))


def op9_chat(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    return chat.conversation_digests(chat.format_turns(chat.canonical_turns(rows)), arranged=True)


def op10_html_extract(spark, sf_dir):
    return html_extract.main_text(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_join": op3_ngram_join,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_decontaminate": op5_decontaminate,
    "op6_url_filter": op6_url_filter,
    "op7_importance": op7_importance,
    "op8_top_k": op8_top_k,
    "op9_chat": op9_chat,
    "op10_html_extract": op10_html_extract,
}
ORACLE_SQL: dict[str, str] = {}
