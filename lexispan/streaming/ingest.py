"""Streaming ingest: documents as they arrive, normalised, guarded and counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise
from ..operators.guards import any_injection


def document_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New JSON-lines documents of a folder: ``doc_id, text, ts``."""
    return spark.readStream.schema("doc_id LONG, text STRING, ts TIMESTAMP").option("maxFilesPerTrigger", max_files).json(path)


def clean_stream(docs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each document once within the watermark, normalised, with a mark for signs of instructions."""
    once = docs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_id"])
    text = normalise(F.coalesce("text", F.lit("")))
    return once.select("doc_id", "ts", text.alias("text"), any_injection(text).alias("suspect"))


def hourly_counts(docs: DataFrame, late: str = "1 hour") -> DataFrame:
    """``window, n, n_suspect`` by hour of arrival; windows close with the watermark."""
    marked = docs.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.sum(F.col("suspect").cast("int")).alias("n_suspect"))


def sliding_counts(docs: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """``window, n, n_suspect`` of overlapping windows; what arrives after the watermark is left out."""
    marked = docs.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"), F.sum(F.col("suspect").cast("int")).alias("n_suspect"))


def bursts(docs: DataFrame, gap: str = "10 minutes", late: str = "1 hour", key: str = "suspect") -> DataFrame:
    """``window, key, n``: sessions of arrivals less than ``gap`` apart."""
    return docs.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
