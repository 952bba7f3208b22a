"""Thresholds of wavelet coefficients, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def soft(x: Column, t: Column | float) -> Column:
    """``x * (1 - t / |x|)``, 0 up to the threshold."""
    t = F.lit(float(t)) if isinstance(t, (int, float)) else t
    return F.when(F.abs(x) <= t, 0.0).otherwise(x * (F.lit(1.0) - t / F.abs(x)))


def hard(x: Column, t: Column | float) -> Column:
    t = F.lit(float(t)) if isinstance(t, (int, float)) else t
    return F.when(F.abs(x) <= t, 0.0).otherwise(x)


def soft_complex(re: Column, im: Column, t: float) -> tuple[Column, Column]:
    """Both parts shrunk by the magnitude."""
    m = F.sqrt(re * re + im * im)
    factor = F.when(m <= t, 0.0).otherwise(F.lit(1.0) - F.lit(float(t)) / m)
    return re * factor, im * factor


def soft_split(re: Column, im: Column, t: float, imaginary_scale: float = 1.0) -> tuple[Column, Column]:
    """Parts shrunk one by one, the imaginary part while scaled."""
    s = float(imaginary_scale)
    return soft(re, t), soft(im * s, t) / s


def fraction(df: DataFrame, magnitude: Column, share: float, by: list[str] | None = None) -> DataFrame:
    """The magnitude below which ``share`` of the points lie: exact percentile."""
    p = F.percentile(magnitude, F.lit(float(share))).alias("threshold")
    return df.groupBy(*by).agg(p) if by else df.agg(p)


def robust_noise(df: DataFrame, magnitude: Column, by: list[str] | None = None) -> DataFrame:
    """Median magnitude over 0.6745."""
    p = (F.percentile(magnitude, F.lit(0.5)) / 0.6745).alias("noise")
    return df.groupBy(*by).agg(p) if by else df.agg(p)


def visu(noise: Column, n: Column) -> Column:
    """``noise / 8 * sqrt(2 ln(n / 8))``."""
    return noise / 8.0 * F.sqrt(F.lit(2.0) * F.log(n / 8.0))


def bayes(df: DataFrame, x: str, noise: float, by: list[str]) -> DataFrame:
    """Per band ``noise^2 / sqrt(max(var / 2 - noise^2, 0))``; the largest coefficient where that is not finite."""
    v = df.groupBy(*by).agg(F.var_pop(x).alias("__v"), F.max(F.abs(x)).alias("__m"))
    left = F.col("__v") / 2.0 - noise**2
    return v.select(*by, F.when(left > 0, F.lit(noise**2) / F.sqrt(left)).otherwise(F.col("__m")).alias("threshold"))


def sure(df: DataFrame, x: str, noise: float, by: list[str], candidates: int = 40) -> DataFrame:
    """Per band the threshold of least SURE cost, searched upwards from 0 until the cost first stops falling.

    Candidates are ``noise / 8 * sqrt(2 ln n) * j / (candidates - 1)`` with the band's number of coefficients ``n``;
    the cost is ``n s^2 - 2 s^2 #(|x| < t) + sum min(|x|, t)^2``.  All costs come from one pass over the coefficients.
    """
    top = df.groupBy(*by).agg((F.lit(noise / 8.0) * F.sqrt(F.lit(2.0) * F.log(F.count(F.lit(1)).cast("double")))).alias("__top"))
    a, t = F.abs(F.col(x)), [F.col("__top") * F.lit(float(j)) / F.lit(candidates - 1.0) for j in range(candidates)]
    cost = lambda c: F.count(F.lit(1)) * F.lit(noise**2) - F.lit(2 * noise**2) * F.sum((a < c).cast("int")) + F.sum(F.pow(F.least(a, c), F.lit(2.0)))
    # The table of bands has one row for each, and bands are few: levels times axes.
    per = df.join(F.broadcast(top), by).groupBy(*by).agg(F.first("__top").alias("__top"), F.array(*[F.round(cost(c), 9) for c in t]).alias("__c"))
    ends = F.filter(F.sequence(F.lit(1), F.lit(candidates - 1)), lambda j: F.get(F.col("__c"), j) >= F.get(F.col("__c"), j - 1))
    best = F.coalesce(F.array_min(ends), F.lit(candidates)) - 1
    return per.select(*by, (F.col("__top") * best / F.lit(candidates - 1.0)).alias("threshold"), F.get(F.col("__c"), best).alias("cost"))


METHODS = ("none", "fixed", "fraction", "visu", "bayes", "sure")


def by_method(df: DataFrame, x: str, by: list[str], method: str, value: float = 0.0, noise: float = 0.0, cycle_spins: int = 1) -> DataFrame:
    """``by, threshold`` by the named method, divided among the cycle spins.

    ``fixed`` takes ``value``, ``fraction`` the magnitude below which that share of a band lies; ``visu`` takes the noise
    from each band where none is given.
    """
    bands = df.groupBy(*by)
    if method == "none":
        found = bands.agg(F.lit(0.0).alias("threshold"))
    elif method == "fixed":
        found = bands.agg(F.lit(float(value)).alias("threshold"))
    elif method == "fraction":
        found = fraction(df, F.abs(F.col(x)), value, by)
    elif method == "visu":
        own = F.lit(float(noise)) if noise else F.percentile(F.abs(F.col(x)), F.lit(0.5)) / 0.6745
        found = bands.agg(own.alias("n"), F.count(F.lit(1)).alias("k")).select(*by, visu(F.col("n"), F.col("k")).alias("threshold"))
    elif method == "bayes":
        found = bayes(df, x, noise, by)
    elif method == "sure":
        found = sure(df, x, noise, by).select(*by, "threshold")
    else:
        raise ValueError(f"unknown method {method!r}; one of {METHODS}")
    return found.withColumn("threshold", F.col("threshold") / F.lit(float(cycle_spins)))


def multiband(df: DataFrame, x: str, by: list[str], method: str, hard_cut: bool = False, **more) -> DataFrame:
    """Every band cut by its own threshold; thresholds are one row for each band and travel to the rows."""
    found = df.join(F.broadcast(by_method(df, x, by, method, **more)), by)
    return found.withColumn(x, (hard if hard_cut else soft)(F.col(x), F.col("threshold"))).drop("threshold")
