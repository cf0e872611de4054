"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, packing.

Each stage reads what the one before it kept, as written Parquet, and its
decisions take effect: documents that the quality rules reject go; one document
of each near-duplicate group stays (that of the least doc_id; texts of one doc_id
are judged each by itself); documents that
hold a benchmark window go; personal data is replaced in the texts (and n_chars
follows); the rest is packed into sequences of token ids. All stages but the
last return the columns of ``documents``.

Defined results: the operators' own for nulls, empty and very long texts, ties and
repeated rows; a table emptied by a stage flows on as empty; extra columns, whatever
they are called, pass through all stages but the last.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evigraph.llm import decontaminate, ngram_join, packing, pii, quality_rules, vocab
from evigraph.llm.runtime import free_name, fresh_path, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = free_name(docs, "found")
    out = pii.pseudonymise(docs, found=found)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size(found) > 0, length).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{x}`") for x in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.Params(vocab.default_path("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", remove_benchmark),
    ("personal_data", replace_personal_data),
    ("packing", pack_sequences),
]

#: The learned quality verdict and the vocabulary's ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
