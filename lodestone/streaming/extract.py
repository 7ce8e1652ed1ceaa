"""Extraction over a stream of chunks: the same columns, with duplicates dropped within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import extract


def read_chunks(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Chunks from Parquet files as they arrive: doc_id, chunk_id, text, char_start, ingested_at."""
    schema = "doc_id long, chunk_id string, text string, char_start int, ingested_at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def indicators(chunks: DataFrame, delay: str = "1 hour", tlds=fixed.TLDS) -> DataFrame:
    """Each (doc_id, type, normalized) once within the delay, with its ingest time."""
    known = chunks.withWatermark("ingested_at", delay)
    found = extract.found(known.select("doc_id", "ingested_at", "text"), tlds).select("doc_id", "ingested_at", "type", "normalized")
    return found.dropDuplicatesWithinWatermark(["doc_id", "type", "normalized"])
