"""Shared helpers: input tables, the shared scratch folder, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words as all contracts count them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a local run makes one of its own. On a cluster executors would write to
    their own disks and rows would be missing without an error, so there it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lexispan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch of rows on its way to a Python worker.
BATCH_BYTES = 2_000_000


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to this session's Python workers in batches of about 2 MB, unless its caller has set a size.

    Spark's own bound (64 MB, 10,000 rows) makes a batch of a whole task's texts. An executor's JVM copies it several
    times outside its heap, and the C library keeps such blocks in each thread's arena. Results don't depend on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, f"{BATCH_BYTES}b")


#: What this worker keeps for later tasks, by its name: of one operator alone, as Spark uses workers again.
_KEPT: dict[tuple, object] = {}


def kept_in_worker(name: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a worker; what another name keeps goes."""
    if name not in _KEPT:
        let_go()
        _KEPT[name] = make()
    return _KEPT[name]


def let_go() -> None:
    """Give back the memory that an earlier operator's tasks keep in this worker."""
    if _KEPT:
        _KEPT.clear()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim is not None:
            trim(0)


#: Bits of the filters that spare shuffles: 16 MB at any size.
_FILTER_BITS = 1 << 27


def _bits(column: str) -> tuple[Column, Column]:
    place = F.pmod(F.col(column), F.lit(_FILTER_BITS))
    return F.bitmap_bucket_number(place), F.bitmap_bit_position(place)


def maybe_in(rows: DataFrame, members: DataFrame, column: str, flag: str) -> DataFrame:
    """``rows`` with ``flag``: false only where ``column`` isn't in ``members``, by a bitmap of fixed size (16 MB)."""
    bucket, bit = _bits(column)
    maps = members.select(bucket.alias("__ls_bucket"), bit.alias("bit")).groupBy("__ls_bucket").agg(F.bitmap_construct_agg("bit").alias("__ls_map"))
    byte = F.conv(F.hex(F.substring("__ls_map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))) != 0
    joined = rows.withColumn("__ls_bucket", bucket).join(F.broadcast(maps), "__ls_bucket", "left")
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__ls_bucket", "__ls_map")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every node of an edge list with the smallest node it can reach.

    ``edges`` has two long columns. Each round hooks every node that has a smaller neighbour
    to the smallest one, shortens the pointers, and contracts the graph; rounds grow with the
    logarithm of the graph, and every round is written to the shared folder. Null ends and
    self-loops are ignored; no edges give an empty result with columns ``node, label``.
    """
    hi, lo = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    live = materialise(edges.where(F.col(a) != F.col(b)).select(hi, lo).distinct(), "edges")
    nodes = live.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    labels = nodes.select("node", F.col("node").alias("label"))
    while not live.isEmpty():
        hook = live.groupBy("u").agg(F.min("v").alias("to"))
        for _ in range(3):
            nxt = hook.select(F.col("u").alias("u2"), F.col("to").alias("to2"))
            hook = hook.join(nxt, F.col("to") == F.col("u2"), "left").select("u", F.coalesce("to2", "to").alias("to"))
        hook = materialise(hook, "hooks")
        labels = materialise(
            labels.join(hook, F.col("label") == F.col("u"), "left").select("node", F.coalesce("to", "label").alias("label")),
            "labels",
        )
        left = hook.select(F.col("u").alias("hu"), F.col("to").alias("tu"))
        right = hook.select(F.col("u").alias("hv"), F.col("to").alias("tv"))
        x, y = F.coalesce("tu", "u"), F.coalesce("tv", "v")
        live = materialise(
            live.join(left, F.col("u") == F.col("hu"), "left")
            .join(right, F.col("v") == F.col("hv"), "left")
            .where(x != y)
            .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
            .distinct(),
            "edges",
        )
    return labels
