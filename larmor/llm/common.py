"""Shared helpers: tables in the shared scratch folder, bounded collects, safe column names."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    It is set here only where the session has none, which is the case in local tests.
    """
    key = "spark.checkpoint.dir"
    path = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="larmor-checkpoint-")
        spark.conf.set(key, path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._scratch = [path]
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete the scratch tables behind results of ``materialize`` that nothing reads any more; others are left alone."""
    for df in tables:
        spark = df.sparkSession
        for path in df.__dict__.pop("_scratch", []):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of ended steps deleted: Spark does so once the driver has collected their handles as garbage.

    Without a call they stay until the driver happens to run short of memory, and the disk holds those of all steps.
    """
    gc.collect()
    spark._jvm.System.gc()


def bounded_chunks(df: DataFrame, size: Column, limit: int) -> Iterator[list]:
    """Rows of ``df`` on the driver in lists whose summed ``size`` stays near ``limit``; one list at a time."""
    chunk, held = [], 0
    for row in df.withColumn("__size", size).toLocalIterator():
        chunk.append(row)
        held += row["__size"] or 0
        if held >= limit:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def crc32_of(doc_id: str | Column) -> Column:
    """CRC-32 of the id as text; a null id counts as the empty string."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
