"""A training corpus from raw documents: quality rules, near duplicates, benchmarks, secrets, packing.

Each stage is a function (spark, docs, sf_dir) of what its predecessor kept; its result is written as Parquet and
read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflux.llm import decontaminate, packing, repetition, secrets, simhash
from folioflux.llm.queries import tokenizer_path
from folioflux.llm.rows import quoted, read, table


def _filtered(docs: DataFrame, judge, verdict) -> DataFrame:
    """The rows a row-wise operator accepts, with all their columns, whatever they are named."""
    at = docs.columns.index("text")
    judged = judge(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{at}")
    return judged.filter(verdict).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the repetition rules keep; null, empty and very short texts go."""
    return _filtered(docs, repetition.quality_rules, F.col("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: one with its smallest id, or one without id where no row of it has any."""
    return simhash.one_per_group(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up less than a twentieth."""
    items = read(spark, sf_dir, "benchmark")
    return _filtered(docs, lambda d, text: decontaminate.decontaminate(d, items, text), ~F.col("contaminated"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return clean.select(*[quoted(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their place in packed sequences."""
    pieces = packing.tokenize(docs, tokenizer_path(), keep_ids=False)
    return packing.pack(pieces).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("benchmarks", benchmarks), ("secrets", secret_scan), ("packing", pack)]

#: SQL cannot express the fingerprints' hash and the tokenizer; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
