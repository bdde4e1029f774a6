"""Cutting lineage: iterative and many-stage plans go through the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there.

    The folder is that of the context or of spark.checkpoint.dir. Where neither is set, a local
    run makes one of its own; on a cluster that would lose rows, so it is an error there. The
    plan above then starts at files that outlive a lost executor, and is analysed anew only
    from there on.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexispan-"))
    return df.checkpoint()
