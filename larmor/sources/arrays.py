"""Dense arrays and acquisitions as files: raw binaries, header-and-data pairs, acquisition tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("kspace", "kdata", "gating", "noise", "acq_meta", "image")


def endian_swap(value: Column) -> Column:
    """The four bytes of an integer in opposite order."""
    byte = lambda i: F.shiftrightunsigned(value, 8 * i).bitwiseAND(F.lit(255))
    out = F.shiftleft(byte(0), 24)
    for i in range(1, 4):
        out = out.bitwiseOR(F.shiftleft(byte(i), 24 - 8 * i))
    return out


def read_raw(spark: SparkSession, path: str, shape: tuple[int, ...], dtype: str = "<f4", swap: bool = False) -> DataFrame:
    """Raw arrays, first axis fastest -> ``path, i, value`` (or ``re, im``); a file of another size raises."""
    kind = np.dtype(dtype)
    complex_ = kind.kind == "c"
    want = int(np.prod(shape)) * kind.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                if len(data) != want:
                    raise ValueError(f"{name} has {len(data)} bytes, not {want}")
                x = np.frombuffer(data, kind)
                x = x.byteswap() if swap else x
                parts = [x.real, x.imag] if complex_ else [x]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.arange(len(x))), *[pa.array(p.astype(float)) for p in parts]], names=["path", "i", *names])

    names = ["re", "im"] if complex_ else ["value"]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, i long, " + ", ".join(f"{n} double" for n in names))


def _open(spark: SparkSession, path: str, append: bool):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.append(where) if append and fs.exists(where) else fs.create(where, True)


def write_raw(df: DataFrame, path: str, order: list[str], parts: list[str], dtype: str = "<f4", append: bool = False, rows: int = 1 << 16) -> int:
    """One file of the parts, interleaved, in ``order``; bytes written.  A single ordered file is written by one writer, a stretch of rows at a time."""
    out, written, held = _open(df.sparkSession, path, append), 0, []
    try:
        for row in df.select(*order, *parts).orderBy(*order).select(*parts).toLocalIterator():
            held.append(tuple(row))
            if len(held) == rows:
                data = np.array(held, dtype).tobytes()
                out.write(bytearray(data))
                written, held = written + len(data), []
        if held:
            data = np.array(held, dtype).tobytes()
            out.write(bytearray(data))
            written += len(data)
    finally:
        out.close()
    return written


def write_magnitude(df: DataFrame, path: str, order: list[str], append: bool = False) -> int:
    return write_raw(df.withColumn("m", F.hypot("re", "im")), path, order, ["m"], append=append)


def write_phase(df: DataFrame, path: str, order: list[str], append: bool = False) -> int:
    return write_raw(df.withColumn("p", F.atan2("im", "re")), path, order, ["p"], append=append)


def write_header_pair(df: DataFrame, base: str, axes: dict[str, int], lead: int = 0) -> None:
    """``base.hdr`` (dimensions, padded with ones to five or more) and ``base.cfl`` (complex floats, first axis fastest).

    Places without a row are zero.
    """
    spark = df.sparkSession
    full = spark.range(1).select(*[F.lit(0).alias("__one")])
    for a, n in axes.items():
        full = full.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dense = full.drop("__one").join(df.select(*[F.col(a).cast("int").alias(a) for a in axes], "re", "im"), list(axes), "left").fillna(0.0, ["re", "im"])
    write_raw(dense, f"{base}.cfl", list(axes)[::-1], ["re", "im"])
    dims = [1] * lead + list(axes.values())
    out = _open(spark, f"{base}.hdr", False)
    out.write(bytearray(("# Dimensions\n" + " ".join(map(str, dims + [1] * (5 - len(dims)))) + "\n").encode()))
    out.close()


def write_acquisition(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Each table as Parquet; sample tables are partitioned by encode."""
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown table {name!r}; one of {TABLES}")
        writer = df.write.mode(mode)
        (writer.partitionBy("encode") if name in ("kspace", "kdata") and "encode" in df.columns else writer).parquet(f"{path}/{name}")


def read_acquisition(spark: SparkSession, path: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The named tables; a missing one raises where it is read."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
