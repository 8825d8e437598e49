"""The registered queries over the operators of this package."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    chat,
    curriculum,
    decontaminate,
    divergence,
    filter_audit,
    fuzzy_lines,
    imatch,
    jaccard_join,
    language,
    paragraphs,
    quality,
    warc,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score."""
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language."""
    docs = table(spark, sf_dir, "documents")
    return language.predicted(docs, ["doc_id"]).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target, the words the mix takes of it and the position of
    its first pass, in training order (those not taken last)."""
    plan = curriculum.curriculum(table(spark, sf_dir, "documents"), keep=["doc_id"])
    first = F.when(F.col("taken") > 0, curriculum.position(F.col("start")))
    return plan.select(
        "doc.doc_id", "size", "source_size", "target", "taken", first.alias("first_position")
    ).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that stay."""
    return fuzzy_lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc.doc_id", "text", "n_lines", "n_removed")


def op5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated paragraph and passage of all documents but the first of each."""
    return paragraphs.repeated(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its component."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every document that repeats a benchmark item, as it is or edited."""
    return decontaminate.contaminations(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return imatch.edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and conversion records of all pages."""
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op10_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    marked = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_conversations(rows.union(marked)))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of the five filters over all documents, step by step within each language."""
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of all pairs of sources of a language, and the terms that mark each source."""
    return divergence.audited(table(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and its bytes read back from them."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language": op2_language,
    "op3_curriculum_mix": op3_curriculum_mix,
    "op4_fuzzy_lines": op4_fuzzy_lines,
    "op5_paragraphs": op5_paragraphs,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_decontamination": op7_decontamination,
    "op8_imatch": op8_imatch,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_chat_template": op10_chat_template,
    "op11_filter_audit": op11_filter_audit,
    "op12_source_divergence": op12_source_divergence,
    "op13_bpe": op13_bpe,
}
