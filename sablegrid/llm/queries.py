"""The corpus operators as queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, epsgrid, fst, jaccard, langid, linededup, packing, quality, tokenfile, toxicity
from .session import documents, ship


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE encoding and decoding of every document."""
    return bpe.encode_decode(documents(ship(spark), sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and line-frequency verdict of every document."""
    return quality.line_quality(documents(ship(spark), sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(documents(ship(spark), sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of repeated three-line windows."""
    return linededup.dedup_lines(documents(spark, sf_dir, dealt=False).select("doc_id", "text"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles overlap by three quarters."""
    return jaccard.jaccard_components(documents(ship(spark), sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs = documents(ship(spark), sf_dir)
    return toxicity.score_documents(docs, toxicity.fit_grammar(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = documents(ship(spark), sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by compiled transducers."""
    return fst.count_tokens(documents(ship(spark), sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as flat files and read back."""
    return tokenfile.token_files(documents(ship(spark), sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of embeddings with a cosine of at least 0.9."""
    return epsgrid.near_vectors(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_line_frequency, op3_packing, op4_line_dedup, op5_jaccard, op6_toxicity, op7_language, op8_token_counts, op9_token_files, op10_epsilon_grid)}
ORACLE_SQL: dict[str, str] = {"op2_line_frequency": quality.SQL, "op4_line_dedup": linededup.SQL, "op5_jaccard": jaccard.SQL, "op10_epsilon_grid": epsgrid.SQL}
