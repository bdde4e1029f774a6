"""The corpus pipeline: documents in, token counts of the mixed, deduplicated corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet to the shared folder and reads it again as the next stage's documents. All stages but
the last return the columns of ``documents``. Stages with Python workers bound the session's
batches to them, as the next stage's JVM still holds what larger ones took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.llm.bpe import encode_documents
from lexispan.llm.common import DOC_COLUMNS, materialise, small_batches, table
from lexispan.llm.line_dedup import dedup_lines
from lexispan.llm.mixing import by_length, mix
from lexispan.llm.quality import classify
from lexispan.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    small_batches(spark)
    return classify(docs.select(*DOC_COLUMNS), table(spark, sf_dir, "labels")).where("keep").select(*DOC_COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; every document stays."""
    return dedup_lines(docs.select(*DOC_COLUMNS)).select(*DOC_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    small_batches(spark)
    return drop_near_duplicates(docs.select(*DOC_COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: rows repeat, and documents not taken go.

    A document without words has no share in any target and goes.
    """
    taken = mix(docs.select(*DOC_COLUMNS), preference=by_length).where("taken > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*DOC_COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, with digests of ids and decoded text."""
    small_batches(spark)
    return encode_documents(docs.select(*DOC_COLUMNS), ids=True).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", encode),
]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
