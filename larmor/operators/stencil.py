"""Gridding: samples to grid cells (scatter-add) and back (gather).

The stencil of a sample is generated by exploding one short sequence for each axis, so both directions
are narrow generators followed by one grouped sum; partial sums are made before the shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larmor.functions import cplx, kernels

#: So many cells of a grid, or places of samples, are sent to every executor; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Axis:
    """One axis: trajectory column, grid size and factor; Cartesian axes take the single cell ``floor(d)``."""

    name: str
    size: int
    factor: float = 1.0
    cartesian: bool = False
    transformed: bool = False

    @property
    def cell(self) -> str:
        return f"c{self.name}"

    def coordinate(self) -> Column:
        return F.col(self.name).cast("double") * F.lit(self.factor) + F.lit(self.size // 2)


def stencil(df: DataFrame, axes: list[Axis], kind: str = "triangle", half_width: float | None = None, grid_factor: float = 1.5, widen: Column | None = None) -> DataFrame:
    """Every (sample, cell) in reach with ``weight``; samples outside the grid have no rows.

    ``widen`` is a factor for each sample by which its kernel reaches farther.
    The sign of a transformed axis, ``2 * (cell mod 2) - 1``, is part of the weight.
    """
    half = kernels.HALF_WIDTH[kind] if half_width is None else half_width
    weight = F.lit(1.0)
    for a in axes:
        d = a.coordinate()
        if a.cartesian:
            df = df.withColumn(a.cell, F.floor(d).cast("int")).where((F.col(a.cell) >= 0) & (F.col(a.cell) < a.size))
        else:
            reach = half if widen is None else widen * half
            lo, hi = F.greatest(F.ceil(d - reach), F.lit(0)).cast("int"), F.least(F.floor(d + reach), F.lit(a.size - 1)).cast("int")
            df = df.where(lo <= hi).withColumn(a.cell, F.explode(F.sequence(lo, hi)))
            df = df.withColumn(f"__{a.name}", (F.col(a.cell) - d) / (F.lit(1.0) if widen is None else widen))
            weight = weight * kernels.weight(F.col(f"__{a.name}"), kind, half, grid_factor)
        if a.transformed:
            weight = weight * (F.lit(2.0) * F.pmod(F.col(a.cell), F.lit(2)) - 1.0)
    return df.withColumn("weight", weight).drop(*[f"__{a.name}" for a in axes])


def scatter(df: DataFrame, axes: list[Axis], parts: list[str], density: str | None = None, keys: list[str] | None = None, kind: str = "triangle", low_pass: float | None = None, **more) -> DataFrame:
    """Grid: ``keys, cells, sums of parts``; samples of zero density do not take part."""
    if density is not None:
        df = df.where(F.col(density) != 0)
    scale = F.lit(1.0) if density is None else F.col(density).cast("double")
    if low_pass is not None:
        r2 = sum((F.col(a.name).cast("double") ** 2 for a in axes if a.transformed), F.lit(0.0))
        scale = scale * F.exp(-r2 / F.lit(2.0 * low_pass**2))
    df = df.withColumns({p: F.col(p).cast("double") * scale for p in parts})
    spread = stencil(df.select(*(keys or []), *[a.name for a in axes], *parts), axes, kind, **more)
    return spread.groupBy(*(keys or []), *[a.cell for a in axes]).agg(*[F.sum(F.col(p) * F.col("weight")).alias(p) for p in parts])


def gather(samples: DataFrame, grid: DataFrame, axes: list[Axis], parts: list[str], sample_keys: list[str], keys: list[str] | None = None, density: str | None = None, kind: str = "triangle", **more) -> DataFrame:
    """Samples: interpolated parts of the grid; 0 for samples outside the grid or of zero density.

    The weights are not multiplied by the density.
    """
    found = interpolated(samples, grid, axes, parts, sample_keys, keys, density, kind, **more)
    return samples.select(*sample_keys).join(found, sample_keys, "left").select(*sample_keys, *[F.coalesce(p, F.lit(0.0)).alias(p) for p in parts])


def interpolated(samples: DataFrame, grid: DataFrame, axes: list[Axis], parts: list[str], sample_keys: list[str], keys: list[str] | None = None, density: str | None = None, kind: str = "triangle", **more) -> DataFrame:
    """One row per key that has cells in the grid; samples of equal keys are one sample."""
    keys = keys or []
    asked = samples if density is None else samples.where(F.col(density) != 0)
    looks = stencil(asked.select(*dict.fromkeys([*sample_keys, *keys]), *[a.name for a in axes]), axes, kind, **more)
    met = looks.join(grid, [*keys, *[a.cell for a in axes]])
    return met.groupBy(*sample_keys).agg(*[F.sum(F.col(p) * F.col("weight")).alias(p) for p in parts])


def widened(axes: list[Axis], acceleration: float) -> Column:
    """How much wider the kernel of a sample is: ``1 + kr / 128 * (acceleration - 1)``."""
    r = F.sqrt(sum((F.col(a.name).cast("double") ** 2 for a in axes[1:]), F.col(axes[0].name).cast("double") ** 2))
    return r / 128.0 * (acceleration - 1.0) + 1.0


def density_weights(samples: DataFrame, axes: list[Axis], sample_keys: list[str], store, rounds: int = 20, kind: str = "polynomial", acceleration: float = 1.0, drop=None, **more) -> DataFrame:
    """Fixed point of ``density_step`` from 1, then its absolute value times the cube of the widening: ``samples, w``.

    ``store`` writes a table and reads it back, so that the plan does not grow with the rounds; ``drop`` is called with
    stored tables that nothing reads any more.
    """
    w = samples.withColumn("w", F.lit(1.0))
    last: list[DataFrame] = []
    for _ in range(rounds):
        held: list[DataFrame] = []
        w = store(density_step(w, axes, sample_keys, kind=kind, widen=widened(axes, acceleration) if acceleration != 1 else None, store=lambda df, held=held: held.append(store(df)) or held[-1], **more))
        if drop is not None:
            drop(*held, *last)
        last = [w]
    return w.withColumn("w", F.abs("w") * F.pow(widened(axes, acceleration), F.lit(3.0)))


def residual(samples: DataFrame, axes: list[Axis], parts: tuple[str, str], density: str, sample_keys: list[str], keys: list[str], kind: str = "triangle") -> DataFrame:
    """``keys, residual``: gridded and interpolated back, scaled by ``D^H D / D^H R``, and compared with the data."""
    grid = scatter(samples, axes, list(parts), density, keys, kind)
    back = interpolated(samples, grid, axes, list(parts), [*keys, *sample_keys], keys, density, kind)
    data = samples.select(*keys, *sample_keys, *[F.col(p).cast("double").alias(f"d{p}") for p in parts])
    both = data.join(back, [*keys, *sample_keys], "left").fillna(0.0, list(parts))
    d, r = cplx.pair(*(f"d{p}" for p in parts)), cplx.pair(*parts)
    met = cplx.mul(cplx.conj(d), r)
    # The sum over |d - s r|^2 with s = D^H D / D^H R, from four sums.
    sums = both.groupBy(*keys).agg(F.sum(cplx.norm2(d)).alias("dd"), F.sum(met[0]).alias("pr"), F.sum(met[1]).alias("pi"), F.sum(cplx.norm2(r)).alias("rr"))
    size = F.col("pr") * F.col("pr") + F.col("pi") * F.col("pi")
    # Re(conj(D) s R) = D^H D, and |s|^2 = (D^H D)^2 / |D^H R|^2.
    return sums.select(*keys, F.when(size > 0, F.col("dd") * F.col("dd") / size * F.col("rr") - F.col("dd")).otherwise(F.col("dd")).alias("residual"))


def density_step(samples: DataFrame, axes: list[Axis], sample_keys: list[str], weight: str = "w", kind: str = "triangle", least: float = 1e-3, store=None, **more) -> DataFrame:
    """One fixed-point step ``w <- w / (C C^T w)``; 0 where the denominator is smaller than ``least``.

    ``widen`` holds for the way back only.  Both ways go by places: samples of equal coordinates are spread and looked
    up once, so that the stencil rows are never those of all samples, and the grid meets the places as a broadcast unless it
    is large.  With ``store`` the looked-up places are a table of their own, counted before it is sent to the executors.
    Samples of equal keys are one sample: their denominators are added.
    """
    names = [a.name for a in axes]
    places = samples.groupBy(*names).agg(F.sum(weight).alias(weight))
    if store is not None:
        places = store(places)
    grid = scatter(places, axes, [weight], kind=kind, **{k: v for k, v in more.items() if k != "widen"})
    cells = math.prod(a.size for a in axes)
    looks = stencil(places.select(*names), axes, kind, **more).join(F.broadcast(grid) if cells <= BROADCAST_ROWS else grid, [a.cell for a in axes])
    back = looks.groupBy(*names).agg(F.sum(F.col(weight) * F.col("weight")).alias("__d")).select(*[F.col(n).alias(f"__{n}") for n in names], "__d")
    if store is not None:
        back = store(back)
        back = F.broadcast(back) if back.count() <= BROADCAST_ROWS else back
    same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names])
    met = samples.join(back, same, "left").drop(*[f"__{n}" for n in names])
    # One shuffle of narrow rows.  Rows with a null in their key belong to no sample.
    met = met.withColumn("__sum", F.sum("__d").over(Window.partitionBy(*sample_keys)))
    unkeyed = reduce(Column.__or__, [F.col(k).isNull() for k in sample_keys])
    step = F.when(unkeyed | (F.coalesce(F.abs("__sum"), F.lit(0.0)) < least), 0.0).otherwise(F.col(weight) / F.col("__sum"))
    return met.withColumn(weight, step).drop("__d", "__sum")
