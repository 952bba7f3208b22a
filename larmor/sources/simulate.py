"""Simulated acquisitions: trajectories, phantoms, bolus signals, noise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def radial_trajectory(spark: SparkSession, shots: int, points: int) -> DataFrame:
    """3D radial spokes on a spiral over the sphere: ``shot, pos, kx, ky, kz, kw, kt, time``."""
    shot = spark.range(shots).withColumnRenamed("id", "shot").withColumn("z", (2.0 * F.col("shot") - shots + 1) / shots)
    angle = F.lit(math.sqrt(math.pi * shots)) * F.asin("z")
    flat = F.sqrt(F.lit(1.0) - F.col("z") * F.col("z"))
    shot = shot.withColumns({"dx": F.cos(angle) * flat, "dy": F.sin(angle) * flat})
    rows = shot.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("r", F.col("pos") * 0.5)
    return rows.select("shot", "pos", (F.col("r") * F.col("dx")).alias("kx"), (F.col("r") * F.col("dy")).alias("ky"), (F.col("r") * F.col("z")).alias("kz"), (F.col("r") * F.col("r")).alias("kw"), (F.col("pos") * 4e-6).alias("kt"), F.col("shot").cast("double").alias("time"))


def golden_radial(spark: SparkSession, shots: int, points: int) -> DataFrame:
    """2D spokes by the golden angle: ``shot, pos, kx, ky``."""
    angle = F.col("shot") * F.lit(math.pi * (math.sqrt(5) - 1))
    rows = spark.range(shots).withColumnRenamed("id", "shot").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    r = F.col("pos") - points // 2
    return rows.select("shot", "pos", (r * F.cos(angle)).alias("kx"), (r * F.sin(angle)).alias("ky"))


def voxels(spark: SparkSession, size: int) -> DataFrame:
    """``z, y, x`` of a cube."""
    i = F.col("id")
    return spark.range(size**3).select(F.floor(i / size**2).cast("int").alias("z"), F.floor(i / size % size).cast("int").alias("y"), (i % size).cast("int").alias("x"))


def shells(spark: SparkSession, size: int) -> DataFrame:
    """Nested shells of 0 and 1 within a radius of 0.45: ``z, y, x, value``."""
    at = lambda c: (F.col(c) - size / 2.0) / size
    r = F.sqrt(at("x") ** 2 + at("y") ** 2 + at("z") ** 2)
    value = F.when((r < 0.45) & (F.floor(r * 10 / 0.9) % 2 == 0), 1.0).otherwise(0.0)
    return voxels(spark, size).withColumn("value", value)


def ellipsoid(spark: SparkSession, size: int) -> DataFrame:
    """Perfusion map: 1 inside, 4 in the shell, 0 outside; half axes 0.5, 0.35 and 0.25 of the cube."""
    at = lambda c, a: (F.col(c) - size * 0.5) / (size * a)
    r2 = at("x", 0.5) * at("x", 0.5) + at("y", 0.35) * at("y", 0.35) + at("z", 0.25) * at("z", 0.25)
    density = F.when(r2 < 0.75, 1).when(r2 < 1, 4).otherwise(0)
    return voxels(spark, size).withColumn("density", density)


def gamma_variate(t: Column, beta: Column, alpha: float = 2.0) -> Column:
    """``t^alpha exp(-t / beta) / (alpha! beta^alpha)``; 0 before the arrival."""
    return F.when(t < 0, 0.0).otherwise(F.pow(t, F.lit(alpha)) * F.exp(-t / beta) / (F.lit(math.gamma(alpha + 1)) * F.pow(beta, F.lit(alpha))))


#: Length of the time course, width of the bolus, share and width of the persistent signal.
DURATION, BOLUS, PERSISTENT, SLOWER = 3.0, 0.25, 0.25, 4.0


def bolus_signal(since: Column, arrival: Column, density: Column) -> Column:
    """A bolus that widens with its arrival, and a share of it that stays four times as long."""
    beta = (F.lit(1.0) + arrival * 2.0) * BOLUS
    return F.when(since > 0, density * (gamma_variate(since, beta) + gamma_variate(since, beta * SLOWER) * PERSISTENT)).otherwise(0.0)


def truth_course(segments: DataFrame, frames: int, keys: list[str]) -> DataFrame:
    """``keys, frame, time, signal``: the true time course of segments with ``arrival`` and ``density``."""
    every = segments.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))).withColumn("time", F.col("frame") * DURATION / frames)
    return every.select(*keys, "frame", "time", bolus_signal(F.col("time") - F.col("arrival"), F.col("arrival"), F.col("density")).alias("signal"))


def bolus_frames(segments: DataFrame, frames: int) -> DataFrame:
    """Signal per frame, summed over segments."""
    return truth_course(segments, frames, []).groupBy("frame").agg(F.sum("signal").alias("signal"))


def add_noise(df: DataFrame, sigma: float, seed: int = 11) -> DataFrame:
    """Complex Gaussian noise of standard deviation ``sigma / sqrt(2)`` in each part."""
    s = sigma / math.sqrt(2)
    return df.withColumns({"re": F.col("re") + F.lit(s) * F.randn(seed), "im": F.col("im") + F.lit(s) * F.randn(seed + 1)})


def relative_noise(df: DataFrame, factor: float, seed: int = 11) -> DataFrame:
    """Noise of ``factor / sqrt(2)`` times the mean magnitude in each part."""
    mean = df.agg(F.avg(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("__mean"))
    s = F.col("__mean") * F.lit(factor / math.sqrt(2))
    return df.crossJoin(F.broadcast(mean)).withColumns({"re": F.col("re") + s * F.randn(seed), "im": F.col("im") + s * F.randn(seed + 1)}).drop("__mean")


def acquisition_noise(df: DataFrame, factor: float, seed: int = 11) -> DataFrame:
    """Noise that raises a whitened unit variance to ``factor`` squared."""
    return add_noise(df, math.sqrt(factor * factor - 1), seed)
