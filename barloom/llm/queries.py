"""The queries of this package, for registration by the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import chat_format, decontaminate, exact_dedup, html_extract, ngram_join, quality, sp_bpe, suffix_dedup, token_count, url_filter
from barloom.session import read_table

#: Vocabulary file of the tokenizer operators; found at run time, never copied.
MODEL = "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_bpe.digest_texts(read_table(spark, sf_dir, "documents"), model_path())


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.mark_exact_duplicates(docs, payload=False)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat_format.probe_rows(spark))
    return chat_format.digests(chat_format.format_chats(chat_format.events_from_turns(turns)))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read_table(spark, sf_dir, "documents"), model_path())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.classify(docs, read_table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("doc_id", "held_out", "score", "predicted")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.link_documents(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Query]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_chat_format": op4_chat_format,
        "op5_html_extract": op5_html_extract,
        "op6_decontamination": op6_decontamination,
        "op7_token_counts": op7_token_counts,
        "op8_quality": op8_quality,
        "op9_ngram_join": op9_ngram_join,
        "op10_suffix_dedup": op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": url_filter.ORACLE,
        "op3_exact_dedup": exact_dedup.ORACLE,
        "op4_chat_format": chat_format.ORACLE,
        "op6_decontamination": decontaminate.ORACLE,
        "op9_ngram_join": ngram_join.ORACLE,
    }
