"""The pipeline's stages: contract, effect of decisions, and agreement with the operators."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexispan.llm.bpe import Bpe, tokenizer_path
from lexispan.llm.common import BATCH_BYTES, DOC_COLUMNS


def test_stages_in_order_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    seen, at = [docs], docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name.split()[0]}"
        at.write.mode("overwrite").parquet(path)
        at = spark.read.parquet(path)
        seen.append(at)
    for df in seen[1:-1]:
        assert tuple(df.columns) == DOC_COLUMNS
    good, lines, near, mixed, encoded = seen[1:]
    assert 0 < good.count() <= docs.count() and lines.count() == good.count() and near.count() <= lines.count()
    assert good.join(docs, ["doc_id", "text"], "left_anti").count() == 0
    assert lines.where("n_chars <> length(text)").count() == 0
    assert mixed.groupBy("doc_id").count().where("count > 3").count() == 0
    assert encoded.count() == mixed.count()
    own = Bpe(tokenizer_path())
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in encoded.limit(30).collect():
        ids = next(iter(own.encode([texts[r.doc_id]])))[0]
        assert ",".join(map(str, r.token_ids)) == ids and r.n_tokens == len(r.token_ids)


BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def _largest_batch(spark):
    """Bytes of the largest batch that a Python worker gets of 6000 texts of 2000 bytes in one task."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    found = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("ab cd efgh"), 200).alias("text")).mapInArrow(run, "n long, size long").collect()
    assert sum(r.n for r in found) == 6000
    return max(r.size for r in found)


@pytest.mark.parametrize("stage", [corpus_pipeline.quality, corpus_pipeline.near_duplicates, corpus_pipeline.encode])
def test_stages_with_python_workers_bound_their_batches(spark, sf, none, stage):
    spark.conf.unset(BOUND)
    try:
        stage(spark, none, sf)
        assert _largest_batch(spark) < 1.2 * BATCH_BYTES
        spark.conf.set(BOUND, "500000b")  # a caller's own bound stays
        stage(spark, none, sf)
        assert _largest_batch(spark) < 600_000
    finally:
        spark.conf.unset(BOUND)


def test_registered_only_where_present():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
