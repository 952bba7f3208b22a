"""Quadratic regularisation of images, blurs over masks, and transforms along the frame or encode axis."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larmor.functions import cplx
from larmor.operators import blocks, coils, lines, shape

KINDS = ("none", "tv", "phase", "lowres")


def normalised_blur(df: DataFrame, keys: list[str], axes: dict[str, int], sigma: dict[str, float], value: str = "x") -> DataFrame:
    """``keys, axes, value``: Gaussian blur over the blur of the mask of positive values, axis by axis; 0 where the mask is not reached.

    The reach along an axis is three times the whole part of its sigma.
    """
    df = df.select(*keys, *axes, F.col(value), (F.col(value) > 0).cast("double").alias("__mask"))
    for a, size in axes.items():
        reach = 3 * int(sigma[a])
        taps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(math.exp(-(d**2) / (2 * sigma[a] ** 2))).alias("w")) for d in range(-reach, reach + 1)])
        met = df.withColumn("__t", F.explode(taps)).withColumn("__at", F.col(a) + F.col("__t.d")).where((F.col("__at") >= 0) & (F.col("__at") < size))
        rest = [c for c in axes if c != a]
        summed = [F.sum(F.col(c) * F.col("__t.w")).alias(c) for c in (value, "__mask")]
        df = met.groupBy(*keys, *rest, "__at").agg(*summed).withColumnRenamed("__at", a)
    return df.select(*keys, *axes, F.when(F.col("__mask") > 0, F.col(value) / F.col("__mask")).otherwise(0.0).alias(value))


def laplacian(df: DataFrame, keys: list[str], axes: dict[str, int], parts: tuple[str, ...] = ("re", "im")) -> DataFrame:
    """Value minus the mean of its two periodic neighbours on every axis; dense images, one exchange."""
    n, moves = len(axes), []
    for a, size in axes.items():
        for step in (1, size - 1):
            moves.append(F.struct(F.lit(-0.5 / n).alias("w"), *[((F.col(b) + step) % size if b == a else F.col(b)).cast("int").alias(b) for b in axes]))
    own = F.struct(F.lit(1.0).alias("w"), *[F.col(b).cast("int").alias(b) for b in axes])
    spread = df.select(*keys, *parts, F.explode(F.array(own, *moves)).alias("m"))
    return spread.groupBy(*keys, *[F.col(f"m.{a}").alias(a) for a in axes]).agg(*[F.sum(F.col(p) * F.col("m.w")).alias(p) for p in parts])


def above_low_resolution(df: DataFrame, keys: list[str], axes: dict[str, int], pad: int = 32) -> DataFrame:
    """What an image has above its low resolution: padded with zeros, windowed in k-space within a radius of twice the padding, cropped.

    The window is 0 at the centre and 1 from the radius on.
    """
    #: The window's coefficients.
    window = (0.355768, -0.487396, 0.144232, -0.012604)

    def smooth(x: np.ndarray) -> np.ndarray:
        k = blocks.fft(np.pad(x, pad))
        grids = np.meshgrid(*[np.arange(n) - n / 2 for n in k.shape], indexing="ij")
        r = np.sqrt(sum(g * g for g in grids)) / (2 * pad)
        w = sum(c * np.cos(i * np.pi * r) for i, c in enumerate(window))
        return blocks.fft(np.where(r < 1, k * w, k), inverse=True)[tuple(slice(pad, pad + n) for n in x.shape)]

    return blocks.on_blocks(df, keys, axes, smooth)


def gradient(df: DataFrame, keys: list[str], axes: dict[str, int], kind: str) -> DataFrame:
    """``keys, axes, re, im``: what regularisation of this kind adds to a residual, before its scale."""
    if kind == "none":
        return df.select(*keys, *axes, "re", "im")
    if kind == "tv":
        return laplacian(df, keys, axes)
    if kind == "phase":
        return df.select(*keys, *axes, F.lit(0.0).alias("re"), "im")
    if kind == "lowres":
        return above_low_resolution(df, keys, axes)
    raise ValueError(f"unknown kind {kind!r}; one of {KINDS}")


def scale(df: DataFrame, keys: list[str], axes: dict[str, int], kind: str, weight: float, normal_energy: float, per_volume: bool = False) -> float:
    """``weight`` times the energy of the normal operator's image over that of the gradient; of one volume, the root of that ratio.

    A gradient without energy gives 0.
    """
    total = coils.energy(gradient(df, keys, axes, kind)).first()["energy"] or 0.0
    if not weight or not total:
        return 0.0
    ratio = normal_energy / total
    return weight * (math.sqrt(ratio) if per_volume else ratio)


def regularise(residual: DataFrame, df: DataFrame, keys: list[str], axes: dict[str, int], kind: str, factor: float) -> DataFrame:
    """``residual + factor * gradient(df)`` over equal voxels."""
    g = gradient(df, keys, axes, kind).select(*keys, *axes, F.col("re").alias("__re"), F.col("im").alias("__im"))
    return residual.join(g, [*keys, *axes]).select(*keys, *axes, *[(F.col(p) + F.col(f"__{p}") * factor).alias(p) for p in ("re", "im")])


def principal_frames(df: DataFrame, axes: dict[str, int], axis: str, size: int, block: int = 8) -> np.ndarray:
    """Unitary matrix of principal directions along ``axis``, from sums over blocks; only ``size`` squared numbers reach the driver."""
    cells = [F.floor(F.col(a) / min(block, n)).alias(f"b{a}") for a, n in axes.items()]
    wide = df.groupBy(*cells).agg(*[F.sum(F.when(F.col(axis) == f, F.col(p)).otherwise(0.0)).alias(f"{p}{f}") for f in range(size) for p in ("re", "im")])
    gram = coils._collected(coils.gramian(wide, [(f"re{f}", f"im{f}") for f in range(size)]), size)
    value, vector = np.linalg.eigh(gram)
    return vector[:, np.argsort(-value)].conj().T


def along(df: DataFrame, keys: list[str], axis: str, size: int, kind: str, inverse: bool = False, composite: DataFrame | None = None, basis: np.ndarray | None = None) -> DataFrame:
    """Frames or encodes transformed by name: none, dft, diff, wavelet, pca (by ``basis``) or composite; one place is left as it is."""
    if kind == "none" or size == 1:
        return df
    if kind == "composite":
        return shape.subtract_composite(df, composite, keys, ["re", "im"], 1 if inverse else -1)
    if kind == "dft":
        place = np.arange(size)
        matrix = np.exp(-2j * np.pi * np.outer(place, place) / size) / math.sqrt(size)
    elif kind == "diff":
        matrix = lines.difference_matrix(size)
    elif kind == "wavelet":
        matrix = lines.haar_matrix(size)
    elif kind == "pca":
        matrix = basis
    else:
        raise ValueError(f"unknown transform {kind!r}")
    if inverse:
        matrix = np.linalg.inv(matrix)
    return coils.apply_matrix(df, coils.matrix_table(df.sparkSession, matrix), keys, axis)


def correct_phase(df: DataFrame, keys: list[str], phase: DataFrame, restore: bool = False) -> DataFrame:
    """Images turned back by ``phase(keys, angle)``, or turned again to restore them."""
    turned = cplx.rotate(cplx.pair("re", "im"), F.col("angle") * (1 if restore else -1))
    return df.join(phase, keys).withColumns({"re": turned[0], "im": turned[1]}).drop("angle")
