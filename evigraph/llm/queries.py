"""The queries opN_<name> over the test tables, and SQL for those that SQL expresses."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitplane, decontaminate, html_extract, lm_scoring, ngram_join, packing, pii, quality_rules, secret_scan, url_filters, vocab
from .runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.Params(vocab.default_path("byte_bpe_50k.json")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.score(docs, lm_scoring.fit(docs))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly"
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op10_bit_plane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.token_table(table(spark, sf_dir, "documents"), vocab.default_path("word_bpe_49k.json"), end_id=1)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_url_filters, op3_packing, op4_decontamination, op5_lm_scoring, op6_pii, op7_quality_rules, op8_secret_scan, op9_html_extraction, op10_bit_plane_ids)}
ORACLES: dict[str, str] = {
    "op2_url_filters": url_filters.verdict_sql(url_filters.standard_rules()),
    "op4_decontamination": decontaminate.contamination_sql(),
}
