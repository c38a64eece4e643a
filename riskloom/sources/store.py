"""Readers with explicit schemas, the partitioned store, verified publishing and reports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# Columns and types of a raw schedule file.
RAW_SCHEMA = (
    "FlightDate DATE, Reporting_Airline STRING, Origin STRING, Dest STRING, CRSDepTime INT, CRSArrTime INT, "
    "CRSElapsedTime DOUBLE, Distance DOUBLE, Cancelled INT, Diverted INT, ArrDel15 DOUBLE, ArrDelay DOUBLE"
)


class MissingInputError(FileNotFoundError):
    """An expected part of the input is not there."""


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str, columns: Sequence[str] = ()) -> DataFrame:
    """Columns of ``schema`` by their names in the header, in any order and among any others.

    The files are read as strings under their own header and only the wanted columns are
    parsed; a value that does not parse is NULL, a column that is missing an error.
    """
    wanted = StructType.fromDDL(schema)
    fields = [wanted[c] for c in columns] if columns else wanted.fields
    df = spark.read.option("header", True).option("enforceSchema", False).csv(paths)
    missing = [f.name for f in fields if f.name not in df.columns]
    if missing:
        raise MissingInputError(f"no column {', '.join(missing)} in the header")
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields])


def read_store(spark: SparkSession, root: str, columns: Sequence[str] = ()) -> DataFrame:
    """The partitioned store; filters on its partition columns skip directories."""
    df = spark.read.parquet(root)
    return df.select(*columns) if columns else df


def require_months(df: DataFrame, years: Sequence[int], year: str = "year", month: str = "month") -> DataFrame:
    """Raise unless every month of every year has rows."""
    spark = df.sparkSession
    expected = spark.range(12).select((F.col("id") + 1).cast("int").alias("_m")).withColumn(
        "_y", F.explode(F.array(*[F.lit(y) for y in years]))
    )
    found = df.select(F.col(year).alias("_fy"), F.col(month).alias("_fm")).distinct()
    gaps = expected.join(found, (F.col("_y") == F.col("_fy")) & (F.col("_m") == F.col("_fm")), "left_anti")
    missing = sorted((r["_y"], r["_m"]) for r in gaps.collect())
    if missing:
        raise MissingInputError(f"no rows for {', '.join(f'{y}-{m:02d}' for y, m in missing)}")
    return df


def write_store(df: DataFrame, root: str, partition_by: Sequence[str] = ("year", "month"), overwrite: bool = False) -> None:
    """Write zstd Parquet by partition; a finished store is kept unless ``overwrite``.

    A folder without the mark of a finished write is what an earlier run left half-way; it
    is written anew.

    Overwriting replaces only the partitions present in ``df``. The rebalance
    brings a partition's rows together without many small files, and splits a
    partition too large for one task.
    """
    writer = df.hint("rebalance", *[F.col(c) for c in partition_by]).write.partitionBy(*partition_by).option("compression", "zstd")
    if overwrite:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)
    elif not exists(df.sparkSession, f"{root}/_SUCCESS"):
        writer.mode("overwrite").option("partitionOverwriteMode", "static").parquet(root)


def finished_parts(spark: SparkSession, root: str) -> DataFrame | None:
    """The record of finished partitions of a store (their values and rows), if there is one."""
    return spark.read.parquet(f"{root}/_finished") if exists(spark, f"{root}/_finished") else None


def resume_store(df: DataFrame, root: str, partition_by: Sequence[str] = ("year", "month"), at_a_time: int = 12) -> int:
    """Write the partitions of ``df`` that are not finished yet; returns how many were written.

    After every ``at_a_time`` partitions a record with their row counts is added below ``root``.
    What a killed run left of a partition without a record is replaced; finished partitions
    keep their files whatever ``df`` holds for them. Rows with a null partition value raise.
    """
    spark, keys = df.sparkSession, list(partition_by)
    wanted = df.select(*keys).distinct()
    done = finished_parts(spark, root)
    if done is not None:
        on = [wanted[k] == done[k] for k in keys]
        wanted = wanted.join(done, on, "left_anti")
    pending = sorted(tuple(r) for r in wanted.collect())  # one row per partition, not per row
    if any(v is None for part in pending for v in part):
        raise ValueError("a partition value is null")
    for low in range(0, len(pending), at_a_time):
        batch = pending[low : low + at_a_time]
        inside = reduce(or_, [reduce(and_, [F.col(k) == F.lit(v) for k, v in zip(keys, part)]) for part in batch])
        write_store(df.where(inside), root, keys, overwrite=True)
        counts = spark.read.parquet(root).where(inside).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
        counts.coalesce(1).write.mode("append").parquet(f"{root}/_finished")
    return len(pending)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def publish_exact(df: DataFrame, path: str, rows: int, overwrite: bool = False) -> bool:
    """Write beside the target, check the row count, then rename into place.

    Returns False when the target is already there. A wrong count leaves the
    target as it was and raises.
    """
    spark = df.sparkSession
    if exists(spark, path) and not overwrite:
        return False
    staging = f"{path}.part-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(staging)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    written = spark.read.parquet(staging).count()
    if written != rows:
        files.delete(source, True)
        raise ValueError(f"expected {rows} rows, wrote {written}")
    if overwrite:
        files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"could not publish {path}")
    return True


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A report table as CSV with a header, or as JSON lines."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown report format {fmt}")


def read_report(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
