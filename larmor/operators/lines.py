"""Transforms along one axis of lines in long form: ``keys, n, re, im`` or a real value."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daubechies(taps: int, symmetric: bool = False) -> list[float]:
    """Low-pass taps of the orthogonal wavelet with ``taps`` taps, by spectral factorisation.

    Half of the polynomial's roots make the filter: those inside the unit circle, or the choice with the
    most symmetric taps.
    """
    p = taps // 2
    halfband = [math.comb(p - 1 + k, k) for k in range(p)][::-1]
    groups: list[list[complex]] = []
    for y in np.roots(halfband) if p > 1 else []:
        if y.imag >= -1e-12:  # one root of each conjugate pair stands for both
            z = np.roots([1, 4 * y - 2, 1])
            inside = complex(z[np.argmin(np.abs(z))])
            groups.append([inside] if abs(inside.imag) < 1e-12 else [inside, inside.conjugate()])
    best, least = None, math.inf
    for choice in product([False, True], repeat=len(groups) if symmetric else 0):
        roots = [1 / r if flip else r for g, flip in zip(groups, choice or [False] * len(groups), strict=True) for r in g]
        h = np.real(np.poly([-1.0] * p + roots))
        h *= math.sqrt(2) / h.sum()
        skew = float(np.abs(h - h[::-1]).sum())
        if skew < least:
            best, least = h, skew
    return best.tolist()


#: Low-pass taps by name; the number is that of the taps.
LOW_PASS = {f"db{n}": daubechies(n) for n in (2, 4, 6, 8)} | {f"sym{n}": daubechies(n, n == 8) for n in (2, 4, 6, 8)}


def dft(df: DataFrame, keys: list[str], size: int, axis: str = "n", inverse: bool = False) -> DataFrame:
    """Orthonormal discrete Fourier transform of a short axis, each point met by each frequency."""
    sign = 1.0 if inverse else -1.0
    spread = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    angle = F.lit(sign * 2 * math.pi / size) * ((F.col(axis) * F.col("k")) % size)
    c, s = F.cos(angle), F.sin(angle)
    root = math.sqrt(size)
    re, im = F.col("re") * c - F.col("im") * s, F.col("re") * s + F.col("im") * c
    return spread.groupBy(*keys, "k").agg((F.sum(re) / root).alias("re"), (F.sum(im) / root).alias("im"))


def high_pass(low: list[float]) -> list[float]:
    """The mirror filter: taps reversed with alternating sign."""
    return [(-1) ** i * c for i, c in enumerate(reversed(low))]


def wavelet(df: DataFrame, keys: list[str], size: int, taps: list[float], axis: str = "n", value: str = "x", shift: int = 0) -> DataFrame:
    """One periodic analysis level: half ``size`` averages, then as many details, at places 0 .. size - 1."""
    low, high = taps, high_pass(taps)
    tap = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for f, (a, b) in enumerate(zip(low, high, strict=True))]))
    # Place p of either half takes the points (2p - f + shift) mod size.
    met = df.withColumn("__t", tap).withColumn("__q", F.pmod(F.col(axis) + F.col("__t.f") - shift, F.lit(size))).where("__q % 2 = 0")
    halves = met.groupBy(*keys, F.expr("cast(__q div 2 as int)").alias(axis)).agg(F.sum(F.col(value) * F.col("__t.a")).alias("lo"), F.sum(F.col(value) * F.col("__t.b")).alias("hi"))
    parts = F.explode(F.array(F.struct(F.col(axis).alias("n"), F.col("lo").alias("x")), F.struct((F.col(axis) + size // 2).alias("n"), F.col("hi").alias("x"))))
    return halves.select(*keys, parts.alias("p")).select(*keys, F.col("p.n").alias(axis), F.col("p.x").alias(value))


def inverse_wavelet(df: DataFrame, keys: list[str], size: int, taps: list[float], axis: str = "n", value: str = "x", shift: int = 0) -> DataFrame:
    """The transpose of ``wavelet``, which for orthogonal taps is its inverse."""
    low, high = taps, high_pass(taps)
    half = size // 2
    tap = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for f, (a, b) in enumerate(zip(low, high, strict=True))]))
    met = df.withColumn("__t", tap).withColumn("__p", F.col(axis) % half)
    place = F.pmod(2 * F.col("__p") - F.col("__t.f") + shift, F.lit(size)).cast("int")
    part = F.col(value) * F.when(F.col(axis) < half, F.col("__t.a")).otherwise(F.col("__t.b"))
    return met.groupBy(*keys, place.alias(axis)).agg(F.sum(part).alias(value))


def subband(axis: str, size: int, levels: int):
    """Band number of a place after ``levels`` analysis levels: 0 the finest details, ``levels`` the averages."""
    band = F.lit(levels)
    for level in range(levels, 0, -1):
        band = F.when(F.col(axis) >= size >> level, F.lit(level - 1)).otherwise(band)
    return band


def difference(df: DataFrame, keys: list[str], axis: str = "n", value: str = "x") -> DataFrame:
    """First place: the sum of the line; others: the value before minus the value."""
    w = Window.partitionBy(*keys)
    return df.withColumn(value, F.when(F.col(axis) == 0, F.sum(value).over(w)).otherwise(F.lag(value).over(w.orderBy(axis)) - F.col(value)))


def difference_matrix(n: int) -> np.ndarray:
    a = np.eye(n, k=-1) - np.eye(n)
    a[0] = 1
    return a


def haar_matrix(n: int) -> np.ndarray:
    """Orthonormal averages and differences over halves of halves; ``n`` a power of two."""
    if n & (n - 1):
        raise ValueError("the number of frames must be a power of two")
    rows = [np.full(n, 1 / math.sqrt(n))]
    width = n
    while width > 1:
        for at in range(0, n, width):
            row = np.zeros(n)
            row[at : at + width // 2], row[at + width // 2 : at + width] = 1, -1
            rows.append(row / math.sqrt(width))
        width //= 2
    return np.array(rows)


def _taps(sigma: float, reach: int) -> list[float]:
    return [math.exp(-(d**2) / (2 * sigma**2)) for d in range(-reach, reach + 1)]


def gaussian(df: DataFrame, keys: list[str], size: int, sigma: float, reach: int, normalised: bool = True, axis: str = "n", value: str = "x") -> DataFrame:
    """Convolution with symmetric Gaussian taps, zero outside the line."""
    taps = _taps(sigma, reach)
    total = sum(taps) if normalised else 1.0
    tap = F.explode(F.array(*[F.struct(F.lit(d - reach).alias("d"), F.lit(t / total).alias("w")) for d, t in enumerate(taps)]))
    met = df.withColumn("__t", tap).withColumn("__n", F.col(axis) + F.col("__t.d")).where((F.col("__n") >= 0) & (F.col("__n") < size))
    return met.groupBy(*keys, F.col("__n").alias(axis)).agg(F.sum(F.col(value) * F.col("__t.w")).alias(value))


def laplacian(df: DataFrame, keys: list[str], size: int, axis: str = "n", value: str = "x") -> DataFrame:
    """Value minus the mean of its two periodic neighbours."""
    tap = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in ((-1, -0.5), (0, 1.0), (1, -0.5))]))
    met = df.withColumn("__t", tap)
    return met.groupBy(*keys, F.pmod(F.col(axis) + F.col("__t.d"), F.lit(size)).cast("int").alias(axis)).agg(F.sum(F.col(value) * F.col("__t.w")).alias(value))
