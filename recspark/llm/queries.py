"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from recspark.llm import (
    decontamination,
    exact_dedup,
    merkle,
    ngram_join,
    packing,
    pii,
    quality_rules,
    spelling,
    substring_dedup,
    token_counts,
    tool_calls,
    toxicity,
    warc,
)
from recspark.llm.common import table


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base metrics and the line-frequency verdict for every document."""
    return quality_rules.line_rules(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against the whole benchmark."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    return pii.digest(table(spark, sf_dir, "documents"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of text that occur more than once in all documents."""
    return substring_dedup.repeated(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and near-duplicate component of every document."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its revision."""
    docs = token_counts.revision_edits(table(spark, sf_dir, "documents"))
    return token_counts.counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all conversations, linked to their results and put in order."""
    calls, results = tool_calls.extract(table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, tool_calls.schema_table(spark))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common form of every word of the documents."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and tampered version of every document."""
    return merkle.manifest(table(spark, sf_dir, "documents")).drop("copied")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays for every document."""
    found = exact_dedup.exact_dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return found.withColumnRenamed("digest", "text_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline`` over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    found = (op1_substring_dedup, op2_packing, op3_warc, op4_ngram_join, op5_token_counts, op6_quality_rules,
             op7_tool_calls, op8_toxicity, op9_pii, op10_decontamination,
             op11_spelling_variants, op12_merkle_manifest, op13_exact_dedup, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.SQL, "op4_ngram_join": ngram_join.SQL, "op6_quality_rules": quality_rules.SQL,
            "op7_tool_calls": tool_calls.SQL,
            "op10_decontamination": decontamination.SQL, "op11_spelling_variants": spelling.SQL,
            "op12_merkle_manifest": merkle.SQL, "op13_exact_dedup": exact_dedup.SQL}
