"""The operators as queries over the test tables, with their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyfold.llm import (
    decontaminate,
    filter_audit,
    html_extract,
    jaccard_links,
    packing,
    passage_sketch,
    periodic_runs,
    pii,
    quality_crf,
    quality_rules,
    substring_dedup,
    toxicity,
    url_filter,
)


def tokenizer_path() -> str:
    """The vocabulary that the packing query uses; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.dedup(_read(spark, folder, "documents"), min_line_words=1, each_row=True)


def op2_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(_read(spark, folder, "pages"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(_read(spark, folder, "documents"))


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_links.report(_read(spark, folder, "documents"))


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(_read(spark, folder, "documents"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_read(spark, folder, "documents"), tokenizer_path())


def op8_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    return quality_crf.predictions(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.predictions(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(_read(spark, folder, "pages"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op12_passage_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return passage_sketch.fingerprints(_read(spark, folder, "documents"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.report(_read(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_html_extract": op2_html_extract,
        "op3_pii": op3_pii,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_decontaminate": op5_decontaminate,
        "op6_quality_rules": op6_quality_rules,
        "op7_packing": op7_packing,
        "op8_quality_crf": op8_quality_crf,
        "op9_toxicity": op9_toxicity,
        "op10_url_filter": op10_url_filter,
        "op11_filter_audit": op11_filter_audit,
        "op12_passage_sketch": op12_passage_sketch,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_decontaminate": decontaminate.oracle_sql(),
        "op6_quality_rules": quality_rules.oracle_sql(),
        "op10_url_filter": url_filter.oracle_sql(),
        "op11_filter_audit": filter_audit.oracle_sql(),
    }
