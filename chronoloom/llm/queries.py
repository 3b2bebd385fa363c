"""Registered queries of the corpus operators: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import chat_format, decontaminate, html_text, language_id, lexical_search, license_scan, merkle, ngram_join, packing, piece_codec, quality_knn, quality_rules, warc
from chronoloom.llm.common import read_table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs).drop("matches")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.with_hostile_turns(read_table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_conversations(turns))


def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.response_records(read_table(spark, sf_dir, "pages")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_documents(read_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.score_documents(read_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.score_documents(read_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove_documents(read_table(spark, sf_dir, "documents"))


REGISTERED = (
    op1_license_scan,
    op2_chat_format,
    op3_quality_knn,
    op4_warc_derivatives,
    op5_quality_rules,
    op6_sentencepiece,
    op7_language_id,
    op8_ngram_jaccard,
    op9_decontaminate,
    op10_html_text,
    op11_ranked_search,
    op12_mixture_packing,
    op13_merkle_manifest,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in REGISTERED}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.ORACLE_SQL,
        "op2_chat_format": chat_format.ORACLE_SQL,
        "op4_warc_derivatives": warc.ORACLE_SQL,
        "op5_quality_rules": quality_rules.ORACLE_SQL,
        "op8_ngram_jaccard": ngram_join.ORACLE_SQL,
        "op9_decontaminate": decontaminate.ORACLE_SQL,
        "op11_ranked_search": lexical_search.ORACLE_SQL,
        "op13_merkle_manifest": merkle.ORACLE_SQL,
    }
