"""From raw documents to stored token ids: five stages, each written as Parquet and read back by the next.

A stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planwalk.llm import decontaminate, jaccard_join, lang_id, mixing, store, token_store


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language known from all labelled ones; those without letters and close calls go."""
    return lang_id.accept(docs, lang_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies: sets of five-word shingles that overlap to 0.8 link."""
    return jaccard_join.keep_one(docs, size=5, threshold=(4, 5))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter one."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources takes its words; rows repeat."""
    return mixing.apply_mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts into a content-addressed store and returns what reading it back gives for each document."""
    import public_tokenizers

    path = store.new_path(spark, "pipeline-tokens")
    root = token_store.write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.verify_store(spark, path, root)


STAGES = [
    ("language_id", languages),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", without_benchmark),
    ("source_mix", source_mix),
    ("token_store", token_output),
]

#: SQL can't express the learned and the hashed stages; tests hold the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
