"""A training corpus from ``documents``: filtered, deduplicated and packed, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablegrid.llm import jaccard, langid, linededup, packing, quality
from sablegrid.llm.session import documents, ship, stage

#: A document goes when no language holds more than this share of its letters.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one known language; texts without letters go, and those of which no language holds half."""
    ship(spark)
    judged = langid.predict(docs, langid.fit(docs), keep=True)
    return judged.where((judged["_l_lang_pred"] != "und") & (judged["_l_score"] >= LEAST_SCORE)).select(*docs.columns)


def apply_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted, without the lines their host repeats."""
    judged = quality.line_quality(docs, keep=True)
    return judged.where("_q_kept").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows; those with nothing left go."""
    return linededup.dedup_lines(docs).where(r"text rlike '[^\\x20\\x09-\\x0D]'").select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the smallest id, null last, then text hash.

    A document is an id with a text. Rows without an id take part like all others, different texts under
    one id are judged apart, and of rows that share id and text one stays. Documents are told apart by
    64-bit hashes of id and text.
    """
    rows = docs.withColumn("_p_row", F.xxhash64("doc_id", "text"))
    parts = jaccard.jaccard_components(rows, "_p_row").select("_p_row", "component_id").distinct()
    named = parts.join(rows.select("_p_row", "doc_id").distinct(), "_p_row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_p_row")).alias("first")
    kept = named.groupBy("component_id").agg(first).select("first._p_row")
    # Copies are combined in the tasks; the join finds them dealt by the same key.
    return rows.dropDuplicates(["_p_row"]).join(kept, "_p_row", "left_semi").select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", identify_language), ("quality", apply_quality), ("line dedup", dedup_lines), ("n-gram join", dedup_documents), ("packing", pack_documents)]
#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written and read again."""
    docs = documents(ship(spark), sf_dir)
    for k, (_, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
