"""Session set-up and the shared scratch area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession


def build_session(app_name: str = "riskloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on; extra settings win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot key even when that costs one more shuffle further up.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # HotSpot leaves methods above 8000 bytecodes uncompiled; fall back before that.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Timestamps are UTC instants everywhere; pin the session to it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster the
    executors would each write to their own disk.
    """
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared scratch area and return a scan of it.

    Cuts lineage in a way that survives the loss of executors, fixes the result
    of range partitioning so that two readers see the same split, and gives the
    optimizer real sizes for its broadcast decision.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def materialize_counting(df: DataFrame, condition: Column, label: str = "stage") -> tuple[DataFrame, int]:
    """``materialize`` that also counts the stored rows meeting a condition.

    The count reads the stored file: an observation while writing would attach an object to
    the session that freshly fitted models cannot be sent out with.
    """
    stored = materialize(df, label)
    return stored, stored.where(condition).count()


def at_once(spark: SparkSession, *parts: Callable[[], object]) -> list:
    """Results of independent parts, submitted side by side: chains of small jobs leave cores idle."""
    with ThreadPoolExecutor(len(parts)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(part)) for part in parts]]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core for a scan that comes in fewer splits than there are cores.

    A large table has more splits than that and is returned as it is, so no
    shuffle is added where it would cost.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def fan_out(df: DataFrame) -> DataFrame:
    """Deal rows out evenly before each of them turns into many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
