"""Coil algebra in long form: Gramians, root sums of squares, channel matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larmor.functions import cplx


def energy(df: DataFrame, by: list[str] | None = None, re: str = "re", im: str = "im") -> DataFrame:
    e = F.sum(cplx.norm2(cplx.pair(re, im))).alias("energy")
    return df.groupBy(*by).agg(e) if by else df.agg(e)


def conj_sum(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: ``sum a * conj(b)`` over equal keys."""
    other = b.select(*keys, F.col("re").alias("__re"), F.col("im").alias("__im"))
    p = cplx.mul(cplx.pair("re", "im"), cplx.conj(cplx.pair("__re", "__im")))
    return a.join(other, keys).agg(F.sum(p[0]).alias("re"), F.sum(p[1]).alias("im"))


def gramian(wide: DataFrame, channels: list[tuple[str, str]], centred: bool = False) -> DataFrame:
    """``(i, j, re, im)`` of ``sum x_i * conj(x_j)`` from one pass over rows that hold all channels.

    All sums are made in a single aggregation without a shuffle of rows.  ``centred`` gives the
    covariance ``sum conj(x_i - m_i) * (x_j - m_j) / (n - 1)`` by the same sums.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(channels):
        aggs += [F.sum(F.col(a[0]).cast("double")).alias(f"sr{i}"), F.sum(F.col(a[1]).cast("double")).alias(f"si{i}")]
        for j, b in enumerate(channels):
            p = cplx.mul(cplx.pair(*a), cplx.conj(cplx.pair(*b)))
            aggs += [F.sum(p[0]).alias(f"r{i}_{j}"), F.sum(p[1]).alias(f"i{i}_{j}")]
    sums = wide.agg(*aggs)
    rows = []
    for i in range(len(channels)):
        for j in range(len(channels)):
            re, im = F.col(f"r{i}_{j}"), F.col(f"i{i}_{j}")
            if centred:
                m = cplx.mul((F.col(f"sr{i}"), F.col(f"si{i}")), cplx.conj((F.col(f"sr{j}"), F.col(f"si{j}"))))
                re, im = (re - m[0] / F.col("n")) / (F.col("n") - 1), -(im - m[1] / F.col("n")) / (F.col("n") - 1)
            rows.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), re.alias("re"), im.alias("im")))
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def root_sum_squares(df: DataFrame, voxel: list[str]) -> DataFrame:
    return df.groupBy(*voxel).agg(F.sqrt(F.sum(cplx.norm2(cplx.pair("re", "im")))).alias("sos"))


def sos_normalise(df: DataFrame, voxel: list[str]) -> DataFrame:
    """Each coil over the root sum of squares of all at its voxel; 0 where there is no signal."""
    total = F.sqrt(F.sum(cplx.norm2(cplx.pair("re", "im"))).over(Window.partitionBy(*voxel)))
    return df.withColumn("__s", total).withColumns({p: F.when(F.col("__s") > 0, F.col(p) / F.col("__s")).otherwise(0.0) for p in ("re", "im")}).drop("__s")


def combine(images: DataFrame, maps: DataFrame, voxel: list[str], coil: str = "coil") -> DataFrame:
    """``sum over coils of image * conj(map)`` at each voxel."""
    m = maps.select(coil, *voxel, F.col("re").alias("__re"), F.col("im").alias("__im"))
    p = cplx.mul(cplx.pair("re", "im"), cplx.conj(cplx.pair("__re", "__im")))
    return images.join(m, [coil, *voxel]).groupBy(*voxel).agg(F.sum(p[0]).alias("re"), F.sum(p[1]).alias("im"))


def strongest(df: DataFrame, coil: str = "coil") -> DataFrame:
    """One row: the coil of largest energy, the first of several."""
    per = energy(df, [coil])
    return per.orderBy(F.desc("energy"), coil).limit(1)


def phase_reference(df: DataFrame, voxel: list[str], coil: str = "coil") -> DataFrame:
    """Phase of coil 0 removed and unit norm over coils at each voxel."""
    w = Window.partitionBy(*voxel)
    re0, im0 = (F.max(F.when(F.col(coil) == 0, F.col(p))).over(w) for p in ("re", "im"))
    angle = -F.atan2(im0, re0)
    turned = cplx.rotate(cplx.pair("re", "im"), angle)
    return sos_normalise(df.withColumns({"re": turned[0], "im": turned[1]}), voxel)


def matrix_table(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """Small complex matrix as ``(row, col, mre, mim)``."""
    return spark.createDataFrame([(i, j, float(v.real), float(v.imag)) for i, line in enumerate(np.asarray(matrix, complex)) for j, v in enumerate(line)], "row int, col int, mre double, mim double")


def apply_matrix(df: DataFrame, matrix: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """``y[row] = sum over col of matrix[row, col] * x[col]`` along an axis of small extent."""
    p = cplx.mul(cplx.pair("mre", "mim"), cplx.pair("re", "im"))
    met = df.join(F.broadcast(matrix), F.col(axis) == F.col("col"))
    return met.groupBy(*keys, F.col("row").alias("__row")).agg(F.sum(p[0]).alias("re"), F.sum(p[1]).alias("im")).withColumnRenamed("__row", axis)


def _collected(gram: DataFrame, n: int) -> np.ndarray:
    out = np.zeros((n, n), complex)
    for r in gram.collect():  # n * n numbers
        out[r["i"], r["j"]] = complex(r["re"], r["im"])
    return out


def whitening_matrix(wide: DataFrame, channels: list[tuple[str, str]]) -> np.ndarray:
    """Inverse of the conjugate transpose of the upper Cholesky factor of the noise Gramian: ``D G D^H = 1``."""
    gram = _collected(gramian(wide, channels), len(channels))
    lower = np.linalg.cholesky(gram)
    return np.linalg.inv(lower)


def compression_matrix(wide: DataFrame, channels: list[tuple[str, str]], virtual: int) -> np.ndarray:
    """Rows: the leading ``virtual`` principal directions of the channels (identity if that is all of them or more)."""
    if virtual > len(channels):
        return np.eye(len(channels), dtype=complex)
    gram = _collected(gramian(wide, channels), len(channels))
    value, vector = np.linalg.eigh(gram)
    return vector[:, np.argsort(-value)[:virtual]].conj().T
