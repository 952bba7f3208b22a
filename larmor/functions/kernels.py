"""Interpolation kernels of gridding as closed expressions of the distance in cells."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half widths of the kernels.
HALF_WIDTH = {"triangle": 1.0, "kaiser_bessel": 2.5, "sinc": 2.5, "polynomial": 2.0, "polynomial_2": 2.0}
#: Power series of the modified Bessel function I0, valid at every argument when long enough.
_I0_TERMS = 30
#: Coefficients of the polynomial kernels, from the constant up.
POLYNOMIAL = (1.0, 0.04522831, -3.36020304, 1.12417012, 2.82448025, -1.63447764)
POLYNOMIAL_2 = (1.0, 0.03056504, -3.01961845, 0.6679865, 2.77924058, -1.45923643)
#: Points of a kernel table for each cell; values between are interpolated linearly.
TABLE_POINTS = 600


def bessel_i0(x: Column) -> Column:
    """Modified Bessel function of the first kind and order zero by its power series in ``(x/2)^2``."""
    q = x * x / 4.0
    value = F.lit(1.0)
    for k in range(_I0_TERMS, 0, -1):
        value = F.lit(1.0) + q / float(k * k) * value
    return value


def kaiser_bessel_beta(width: float, grid_factor: float) -> float:
    """Shape parameter, floored where the square root would not be real."""
    inner = width**2 / grid_factor**2 * (grid_factor - 0.5) ** 2 - 0.8
    return math.pi * math.sqrt(inner) if inner > 0 else math.sqrt(max((2 * math.pi * width / grid_factor) ** 2 - 9.6752, 0.0))


def kaiser_bessel_table(half: float, grid_factor: float) -> list[float]:
    """Values at distances 0, 1/600, ... up to the half width, 0 beyond it."""
    beta = kaiser_bessel_beta(2 * half, grid_factor)
    x = np.arange(int(half * TABLE_POINTS) + 1) / (half * TABLE_POINTS)
    return [*(np.i0(beta * np.sqrt(1 - x * x)) / np.i0(beta)).tolist(), 0.0]


def weight(distance: Column, kind: str = "triangle", half_width: float | None = None, grid_factor: float = 1.5) -> Column:
    """Kernel value at a signed distance; zero outside the half width."""
    half = HALF_WIDTH[kind] if half_width is None else half_width
    x = F.abs(distance) / half
    if kind == "triangle":
        value = F.lit(1.0) - x
    elif kind in ("polynomial", "polynomial_2"):
        value = F.lit(0.0)
        for c in reversed(POLYNOMIAL if kind == "polynomial" else POLYNOMIAL_2):
            value = value * x + F.lit(c)
    elif kind == "kaiser_bessel":
        table = F.lit(kaiser_bessel_table(half, grid_factor))
        place = F.floor(F.least(F.abs(distance), F.lit(half)) * TABLE_POINTS).cast("int")
        low = F.element_at(table, place + 1)
        value = low + (F.abs(distance) * TABLE_POINTS - place) * (F.element_at(table, place + 2) - low)
    elif kind == "sinc":
        z = distance * math.pi
        value = F.when(distance == 0, 1.0).otherwise(F.sin(z) / z) * (F.lit(0.54) + F.lit(0.46) * F.cos(x * math.pi))
    else:
        raise ValueError(f"unknown kernel {kind!r}; one of {sorted(HALF_WIDTH)}")
    return F.when(x <= 1, value).otherwise(0.0)
