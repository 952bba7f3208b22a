"""Masked polynomial fits and momentum of accelerated iterations."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exponents(axes: int, order: int) -> list[tuple[int, ...]]:
    """All monomials of total degree up to ``order``."""
    return [e for e in product(range(order + 1), repeat=axes) if sum(e) <= order]


def monomials(axes: list[str], order: int) -> list[Column]:
    out = []
    for e in exponents(len(axes), order):
        term = F.lit(1.0)
        for a, k in zip(axes, e, strict=True):
            for _ in range(k):
                term = term * F.col(a).cast("double")
        out.append(term)
    return out


def moments(df: DataFrame, axes: list[str], value: str, order: int, mask: Column | None = None) -> DataFrame:
    """Sums of products ``(i, j, value)`` of the normal equations in one aggregation; ``j = -1`` is the right side."""
    kept = df if mask is None else df.where(mask)
    m = monomials(axes, order)
    aggs, rows = [], []
    for i, a in enumerate(m):
        for j, b in [*enumerate(m), (-1, F.col(value).cast("double"))]:
            name = f"m{i}_{j}".replace("-", "r")
            aggs.append(F.sum(a * b).alias(name))
            rows.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(name).alias("value")))
    return kept.agg(*aggs).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def fit(df: DataFrame, axes: list[str], value: str, order: int, mask: Column | None = None) -> np.ndarray:
    """Least-squares coefficients in the order of ``exponents``; only the moments come to the driver."""
    n = len(exponents(len(axes), order))
    left, right = np.zeros((n, n)), np.zeros(n)
    for r in moments(df, axes, value, order, mask).collect():
        if r["j"] < 0:
            right[r["i"]] = r["value"]
        else:
            left[r["i"], r["j"]] = r["value"]
    return np.linalg.lstsq(left, right, rcond=None)[0]


def evaluate(axes: list[str], order: int, coefficients: np.ndarray) -> Column:
    return sum((F.lit(float(c)) * m for c, m in zip(coefficients, monomials(axes, order), strict=True)), F.lit(0.0))


def subtract(df: DataFrame, axes: list[str], value: str, order: int, coefficients: np.ndarray) -> DataFrame:
    return df.withColumn(value, F.col(value) - evaluate(axes, order, coefficients))


def momentum(new: Column, old: Column, step: int) -> Column:
    """``(1 + b) * new - b * old`` with ``b = (step - 1) / (step + 1)``."""
    b = (step - 1) / (step + 1)
    return F.lit(1 + b) * new - F.lit(b) * old
