"""Corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination and encoding, in this order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common
from lodestone.llm.bpe import bpe
from lodestone.llm.decontamination import decontaminate
from lodestone.llm.language_id import language_id
from lodestone.llm.line_dedup import line_dedup
from lodestone.llm.near_dedup import near_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter; those that are null or have none go, whatever the prediction is."""
    return language_id(docs.select(*COLUMNS), lettered=True).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates that stand in an earlier document; n_chars follows."""
    kept = line_dedup(docs, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest id. Rows of one id and text stay or go together."""
    copies = near_dedup(docs).where(~F.col("kept")).select(F.col("doc_id").alias("copy"), F.col("text_sha256").alias("sha")).distinct()
    own = docs.withColumn("own", F.sha2(F.coalesce("text", F.lit("")), 256))
    return own.join(copies, own.doc_id.eqNullSafe(copies.copy) & (own.own == copies.sha), "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the allowed edits; rows of one id stay or go together."""
    held = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("held")).distinct()
    return docs.join(held, docs.doc_id.eqNullSafe(held.held), "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens and the digests of its ids and of what they decode to."""
    return bpe(docs, texts=False)


STAGES = [
    ("language_id", identify),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_copies),
    ("decontamination", decontaminated),
    ("bpe", encode),
]

#: SQL can express neither the string kernels nor the sketches, so tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each writes Parquet in the shared folder, and the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{common.shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out.write.parquet(f"{top}/{k}-{name}")
            out = docs = spark.read.parquet(f"{top}/{k}-{name}")
    return out
