"""Coil sensitivity maps from calibration data: kernel eigenvectors, normalisation, intensity correction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larmor.functions import cplx
from larmor.operators import coils


def calibration_matrix(kspace: np.ndarray, radius: tuple[float, ...], kernel: tuple[int, ...]) -> np.ndarray:
    """Rows: all coils' samples under the kernel at each centre inside the ellipsoid; ``kspace`` is (coil, axes ...)."""
    shape = kspace.shape[1:]
    offsets = [np.arange(k) - k // 2 for k in kernel]
    rows = []
    for centre in np.ndindex(*shape):
        d = [(c - n // 2) / max(r, 1e-9) for c, n, r in zip(centre, shape, radius, strict=True)]
        if sum(v * v for v in d) > 1 or any(c + o[0] < 0 or c + o[-1] >= n for c, o, n in zip(centre, offsets, shape, strict=True)):
            continue
        box = tuple(slice(c + o[0], c + o[-1] + 1) for c, o in zip(centre, offsets, strict=True))
        rows.append(kspace[(slice(None), *box)].ravel())
    return np.array(rows)


def row_space(calibration: np.ndarray, coils_n: int, kernel: tuple[int, ...], threshold: float) -> np.ndarray:
    """Right singular vectors with ``s >= s0 * sqrt(threshold)`` as kernels (vector, coil, axes ...)."""
    _, s, v = np.linalg.svd(calibration, full_matrices=False)
    return v[s >= s[0] * np.sqrt(threshold)].reshape(-1, coils_n, *kernel)


def eigen_maps(kernels_: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Per voxel the leading left singular vector of (coils x kernels), after padding and transforming the kernels.

    Coil 0 has phase 0 and the coils have unit norm.
    """
    many, n = kernels_.shape[:2]
    padded = np.zeros((many, n, *shape), complex)
    box = tuple(slice(s // 2 - k // 2, s // 2 - k // 2 + k) for s, k in zip(shape, kernels_.shape[2:], strict=True))
    padded[(slice(None), slice(None), *box)] = kernels_
    axes = tuple(range(2, 2 + len(shape)))
    image = np.fft.fftshift(np.fft.ifftn(np.fft.ifftshift(padded, axes), axes=axes), axes)
    matrix = np.moveaxis(image.reshape(many, n, -1), -1, 0).transpose(0, 2, 1)
    u = np.linalg.svd(matrix, full_matrices=False)[0][:, :, 0].conj()
    u = u * np.exp(-1j * np.angle(u[:, :1]))
    return u.T.reshape(n, *shape)


def intensity_correction(images: DataFrame, voxel: list[str], least: float = 0.05, noise: float = 0.1) -> DataFrame:
    """``voxel, bias``: regularised inverse of the root sum of squares, over its maximum; 0 below ``least`` of it."""
    sos = coils.root_sum_squares(images, voxel)
    top = sos.agg(F.max("sos").alias("__top"))
    scaled = sos.crossJoin(F.broadcast(top)).withColumn("s", F.when(F.col("__top") > 0, F.col("sos") / F.col("__top")).otherwise(0.0))
    bias = F.when(F.col("s") < least, 0.0).otherwise(F.col("s") / (F.col("s") * F.col("s") + noise**2))
    return scaled.select(*voxel, bias.alias("bias"))


def body_coil_normalise(images: DataFrame, body: DataFrame, voxel: list[str]) -> DataFrame:
    """Coil images over their root sum of squares, with the body coil's phase removed."""
    b = body.select(*voxel, F.atan2("im", "re").alias("__angle"))
    joined = images.join(b, voxel)
    turned = cplx.rotate(cplx.pair("re", "im"), -F.col("__angle"))
    return coils.sos_normalise(joined.withColumns({"re": turned[0], "im": turned[1]}).drop("__angle"), voxel)
