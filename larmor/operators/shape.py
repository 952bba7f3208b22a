"""Projections, filters, masks and reshapes of samples and voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larmor.functions import cplx


def scale_fov(df: DataFrame, scale: dict[str, float], fov: dict[str, str] | None = None) -> DataFrame:
    """Trajectory columns times their scale; field-of-view columns times its absolute value."""
    for name, s in scale.items():
        df = df.withColumn(name, F.col(name) * F.lit(float(s)))
        if fov and name in fov:
            df = df.withColumn(fov[name], F.col(fov[name]) * F.lit(abs(float(s))))
    return df


def demodulate(df: DataFrame, frequency: float, re: str = "re", im: str = "im", time: str = "kt") -> DataFrame:
    """Samples times ``exp(i * 2 pi * frequency * time)``."""
    turned = cplx.rotate(cplx.pair(re, im), F.lit(6.283185307179586 * frequency) * F.col(time))
    return df.withColumns({re: turned[0], im: turned[1]})


def mod_time(df: DataFrame, period: float, time: str = "time") -> DataFrame:
    """Remainder of the time; the sign follows the time."""
    return df.withColumn(time, F.col(time) % F.lit(float(period)))


def checkerboard(*index: str) -> Column:
    """-1 where the indices sum to an even number, else +1."""
    s = sum((F.col(c) for c in index[1:]), F.col(index[0]))
    return F.when(F.pmod(s, F.lit(2)) == 1, 1).otherwise(-1)


def flip(df: DataFrame, axis: str, size: int) -> DataFrame:
    return df.withColumn(axis, F.lit(size - 1) - F.col(axis))


def unravel(index: Column, sizes: list[int]) -> list[Column]:
    """Mixed-radix digits of a linear index, first axis fastest."""
    out = []
    for n in sizes:
        out.append(index % n)
        index = F.floor(index / n)
    return [c.cast("int") for c in out]


def subframe(df: DataFrame, start: int, stop: int, stride: int, encode: str = "encode") -> DataFrame:
    """Encodes ``start .. stop`` by ``stride``, renumbered from 0."""
    e = F.col(encode)
    return df.where((e >= start) & (e <= stop) & ((e - start) % stride == 0)).withColumn(encode, F.floor((e - start) / stride).cast("int"))


def skip_encodes(df: DataFrame, listed: list[int], encode: str = "encode") -> DataFrame:
    return df.where(~F.col(encode).isin(listed)) if listed else df


def encodes_to_coils(df: DataFrame, coils: int, encode: str = "encode", coil: str = "coil") -> DataFrame:
    """Encode and coil as one coil axis of a single encode."""
    return df.withColumn(coil, F.col(encode) * coils + F.col(coil)).withColumn(encode, F.lit(0))


def complex_difference(df: DataFrame, keys: list[str], parts: list[str], encode: str = "encode") -> DataFrame:
    """Encodes from 1 on minus encode 0 at the same place, numbered from 0."""
    base = df.where(F.col(encode) == 0).select(*keys, *[F.col(p).alias(f"__{p}") for p in parts])
    rest = df.where(F.col(encode) > 0).join(base, keys)
    return rest.select(*keys, (F.col(encode) - 1).alias(encode), *[(F.col(p) - F.col(f"__{p}")).alias(p) for p in parts])


def circle_mask(position: list[Column], value: Column) -> Column:
    """Zero outside the unit circle or sphere of centred, normalised positions."""
    r2 = sum((p * p for p in position[1:]), position[0] * position[0])
    return F.when(r2 > 1, 0.0).otherwise(value)


def hole_fill(df: DataFrame, row: list[str], along: str, hit: Column) -> DataFrame:
    """Adds ``mask``: 1 between the first and the last hit of each row."""
    w = Window.partitionBy(*row)
    first, last = F.min(F.when(hit, F.col(along))).over(w), F.max(F.when(hit, F.col(along))).over(w)
    return df.withColumn("mask", F.coalesce((F.col(along) >= first) & (F.col(along) <= last), F.lit(False)).cast("int"))


def coil_rejection(df: DataFrame, coil: str, inside: Column, value: Column, least: float) -> DataFrame:
    """Per coil the fraction of absolute signal inside the shape, and whether it is kept."""
    per = df.groupBy(coil).agg(F.sum(F.when(inside, F.abs(value)).otherwise(0.0)).alias("__in"), F.sum(F.abs(value)).alias("__all"))
    share = F.when(F.col("__all") > 0, F.col("__in") / F.col("__all")).otherwise(0.0)
    return per.select(coil, share.alias("fraction")).withColumn("keep", (F.col("fraction") >= least).cast("int"))


def rejection_shape(axes: dict[str, int], radius: float, height: float | None = None, through: str | None = None) -> Column:
    """True inside a sphere of ``radius`` (shares of the axes' lengths); with ``height`` inside a cylinder along ``through``."""
    at = {a: (F.col(a) - n // 2) / (2.0 * (n // 2)) for a, n in axes.items()}
    across = [p for a, p in at.items() if height is None or a != through]
    inside = sum((p * p for p in across[1:]), across[0] * across[0]) < radius * radius
    return inside if height is None else inside & (F.abs(at[through]) < height)


def reject_coils(images: DataFrame, judged: DataFrame, coil: str, parts: list[str]) -> DataFrame:
    """Coils that ``coil_rejection`` does not keep become zero."""
    keep = F.broadcast(judged.select(coil, "keep"))  # one row for each coil
    return images.join(keep, coil).withColumns({p: F.when(F.col("keep") == 1, F.col(p)).otherwise(0.0) for p in parts}).drop("keep")


def above_fraction(df: DataFrame, value: Column, fraction: float) -> DataFrame:
    """Adds ``hit``: whether the value is above ``fraction`` of the largest."""
    top = df.agg(F.max(value).alias("__top"))
    return df.crossJoin(F.broadcast(top)).withColumn("hit", value > F.col("__top") * F.lit(fraction)).drop("__top")


def fov_box(df: DataFrame, axes: dict[str, int], value: Column, fraction: float, within: str = "box", through: str | None = None) -> DataFrame:
    """One row: for each axis the range of voxels above ``fraction`` of the maximum, symmetrised and rounded up to 16.

    ``within`` takes the voxels of the whole ``box``, of the inscribed ``sphere``, or of the ``cylinder`` along ``through``.
    """
    hits = above_fraction(df, value, fraction).where("hit")
    if within != "box":
        at = [F.col(a) * 2.0 / n - 1.0 for a, n in axes.items() if within == "sphere" or a != through]
        hits = hits.where(sum((p * p for p in at[1:]), at[0] * at[0]) <= 1.0)
    box = hits.agg(*[f(a).alias(f"{a}_{n}") for a in axes for n, f in (("min", F.min), ("max", F.max))])
    for a, size in axes.items():
        reach = F.greatest(F.lit(size // 2) - F.col(f"{a}_min"), F.col(f"{a}_max") - F.lit(size // 2))
        box = box.withColumn(f"{a}_size", F.least(F.ceil(reach * 2 / 16.0) * 16, F.lit(size)).cast("int"))
    return box


def with_shot_signal(samples: DataFrame, signal: DataFrame, shot: list[str], names: list[str]) -> DataFrame:
    """Every sample with the signal of its shot; samples of shots without one go."""
    return samples.join(signal.select(*shot, *names), shot)


def crop(df: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Half-open ranges on axes, renumbered from 0."""
    for a, (lo, hi) in limits.items():
        df = df.where((F.col(a) >= lo) & (F.col(a) < hi)).withColumn(a, F.col(a) - lo)
    return df


def zero_pad(df: DataFrame, keys: list[str], axis: str, before: int, size: int, parts: list[str]) -> DataFrame:
    """Every place of the larger axis, zero where the data has none."""
    full = df.select(*keys).distinct().withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    moved = df.withColumn(axis, F.col(axis) + before)
    return full.join(moved, [*keys, axis], "left").select(*keys, axis, *[F.coalesce(p, F.lit(0.0)).alias(p) for p in parts])


def k_radius_filter(df: DataFrame, radius: float, axes: tuple[str, ...] = ("kx", "ky", "kz")) -> DataFrame:
    r2 = sum((F.col(a) * F.col(a) for a in axes[1:]), F.col(axes[0]) * F.col(axes[0]))
    return df.where(r2 < float(radius) ** 2)


def range_stats(df: DataFrame, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Minimum, maximum and count of each value."""
    aggs = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("min", F.min), ("max", F.max))] + [F.count(F.lit(1)).alias("n")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def intensity_bias(df: DataFrame, bias: DataFrame, voxel: list[str], parts: list[str], correct: bool = True) -> DataFrame:
    """Images times (or, to undo, divided by) the correction volume ``bias`` at each voxel."""
    b = F.col("bias")
    change = (lambda c: c * b) if correct else (lambda c: F.when(b == 0, 0.0).otherwise(c / b))
    return df.join(bias, voxel).withColumns({p: change(F.col(p)) for p in parts}).drop("bias")


def subtract_composite(df: DataFrame, composite: DataFrame, voxel: list[str], parts: list[str], sign: int = -1) -> DataFrame:
    c = composite.select(*voxel, *[F.col(p).alias(f"__{p}") for p in parts])
    return df.join(c, voxel).withColumns({p: F.col(p) + sign * F.col(f"__{p}") for p in parts}).drop(*[f"__{p}" for p in parts])


def normalise_to_max(df: DataFrame, parts: tuple[str, str] = ("re", "im")) -> DataFrame:
    """Complex values over the largest magnitude."""
    top = df.agg(F.max(cplx.magnitude(cplx.pair(*parts))).alias("__top"))
    return df.crossJoin(F.broadcast(top)).withColumns({p: F.when(F.col("__top") > 0, F.col(p) / F.col("__top")).otherwise(0.0) for p in parts}).drop("__top")


def reset_density(df: DataFrame, solver: str, kw: str = "kw") -> DataFrame:
    """Weights of 1 for conjugate gradients and splitting; at most 0.1 for thresholded iterations."""
    return df.withColumn(kw, F.least(F.col(kw), F.lit(0.1)) if solver in ("ist", "fista") else F.lit(1.0))
