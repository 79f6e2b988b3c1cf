"""Corpus pipeline: language ID, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatspark.llm import decontam, langid, line_dedup, ngram_join, packing
from seatspark.llm.shared import saved


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (no letter, so also null and empty texts) go.

    Learns from the rows that are not held out. Without a row to learn from, all
    documents with a letter stay. Repeated rows stay or go together.
    """
    net = langid.fit_language_model(docs, ~langid.held_out(F.col("doc_id"), 5, 0))
    if net is None:
        return docs.where(langid.has_letter(F.col("text")))
    return langid.predict_language(docs, net).where(F.col("lang_pred") != langid.UNDETERMINED).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars is counted anew. No document goes."""
    out = line_dedup.dedup_lines(docs).select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, the one of smallest doc_id stays.

    Texts without words link with nothing and stay; so do rows with null doc_id.
    """
    found = saved(ngram_join.ngram_jaccard_join(docs, n=5, percent=80).where("doc_id != component_id").select(
        "doc_id").distinct(), "copies")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts and rows with null doc_id stay.

    Repeated rows stay or go together. An empty benchmark removes nothing.
    """
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, packed into sequences of 2048 ids: a row a piece.

    Null and empty texts are the end id alone; repeated rows and null doc_ids are packed like others.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", languages), ("lines", lines), ("near_duplicates", near_duplicates),
          ("decontamination", decontaminated), ("packing", packed)]

#: The language model, the exact-overlap search and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
