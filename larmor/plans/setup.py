"""From an acquisition to a solver: whitening, compression, density, coil maps, difference, gating, in this order."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larmor.operators import blocks, coilmaps, coils, gating, lines, shape, stencil
from larmor.plans import recon

MAPS = ("none", "ones", "lowres", "walsh", "kernel")


@dataclass(frozen=True)
class Calibration:
    """Sizes of the kernel method; flat for one slice."""

    kernel: int = 5
    radius: int = 8
    threshold: float = 1e-3

    def kernels(self, shape_: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(1 if n == 1 else self.kernel for n in shape_)

    def radii(self, shape_: tuple[int, ...]) -> tuple[float, ...]:
        return tuple(0.5 if n == 1 else float(self.radius) for n in shape_)


@dataclass(frozen=True)
class Setup:
    """What is done before the solver."""

    whiten: bool = False
    virtual_coils: int = 0
    compress_radius: float = 32.0
    density: str = "given"  # given or iterate
    density_rounds: int = 20
    density_acceleration: float = 1.0
    maps: str = "lowres"
    calibration: Calibration = field(default_factory=Calibration)
    blur: float = 0.0
    correct: bool = False
    reject_radius: float = 0.0
    reject_height: float | None = None
    reject_below: float = 0.3
    mask: float = 0.0
    difference: bool = False
    gate: str = "none"  # none, time, hist or resp
    frames: int = 1


def eigen_coil_maps(images: DataFrame, axes: dict[str, int], many: int, calibration: Calibration = Calibration()) -> DataFrame:
    """``coil, axes, re, im``: k-space of the coil images, calibration rows, their row space, and its eigenvectors in image space."""
    sizes = tuple(axes.values())

    def make(x: np.ndarray) -> np.ndarray:
        k = blocks.fft(x, axes=tuple(range(1, x.ndim)))
        rows = coilmaps.calibration_matrix(k, calibration.radii(sizes), calibration.kernels(sizes))
        return coilmaps.eigen_maps(coilmaps.row_space(rows, many, calibration.kernels(sizes), calibration.threshold), sizes)

    return blocks.on_blocks(images, [], {"coil": many, **axes}, make)


def walsh_coil_maps(images: DataFrame, axes: dict[str, int], many: int, block: int = 8) -> DataFrame:
    """``coil, axes, re, im``: leading singular vector of each voxel's neighbourhood over coils."""
    return blocks.on_blocks(images, [], {"coil": many, **axes}, lambda x: blocks.walsh_maps(x, block))


def coil_maps(images: DataFrame, axes: dict[str, int], many: int, s: Setup) -> DataFrame | None:
    """Maps ``coil, axes, re, im`` from low-resolution coil images of one frame, by the method of ``s``.

    One image's coils are one group of the kernel and Walsh methods: a group has an image's size, not the data's.
    """
    names = list(axes)
    if s.maps not in MAPS:
        raise ValueError(f"unknown maps {s.maps!r}; one of {MAPS}")
    if s.maps == "none":
        return None
    if s.maps == "ones" or many == 1:
        return images.select("coil", *names, F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    low = images.select("coil", *names, "re", "im")
    if s.blur:
        for a, n in axes.items():
            keys, reach = ["coil", *[b for b in names if b != a]], 3 * max(1, int(s.blur))
            parts = [lines.gaussian(low.select(*keys, a, p), keys, n, s.blur, reach, axis=a, value=p) for p in ("re", "im")]
            low = parts[0].join(parts[1], [*keys, a])
    if s.correct:
        low = shape.intensity_bias(low, coilmaps.intensity_correction(low, names), names, ["re", "im"])
    if s.reject_radius:
        through = names[0] if s.reject_height is not None else None
        inside = shape.rejection_shape(axes, s.reject_radius, s.reject_height, through)
        judged = shape.coil_rejection(low, "coil", inside, F.hypot("re", "im"), s.reject_below)
        low = shape.reject_coils(low, judged, "coil", ["re", "im"])
    low = recon.stored(low, "maps-low")
    if s.maps == "walsh":
        made = walsh_coil_maps(low, axes, many)
    elif s.maps == "kernel":
        made = eigen_coil_maps(low, axes, many, s.calibration)
    else:
        made = low
    made = coils.sos_normalise(made, names)
    if s.mask:
        rows, last = names[:-1] or ["__all"], names[-1]
        sos = coils.root_sum_squares(low, names).withColumn("__all", F.lit(0))
        filled = shape.hole_fill(shape.above_fraction(sos, F.col("sos"), s.mask), rows, last, F.col("hit"))
        kept = filled.select(*names, "mask")
        made = made.join(kept, names).withColumns({p: F.col(p) * F.col("mask") for p in ("re", "im")}).drop("mask")
    return made.select("coil", *names, "re", "im")


def gated(shots: DataFrame, s: Setup, time: str, signal: str, order: list[str]) -> DataFrame:
    """Shots with their ``frame`` by the gate's type: ranges of time, equal counts of time, or ranges of the respiratory signal."""
    if s.gate == "none" or s.frames == 1:
        return shots.withColumn("frame", F.lit(0))
    if s.gate == "hist":
        return gating.frame_hist(shots, s.frames, order)
    if s.gate == "resp":
        low, high = gating.respiratory_range(shots, signal, s.frames)
        return gating.frame_none(gating.scaled_frame(shots, signal, s.frames, low, high), s.frames)
    if s.gate == "time":
        return gating.frame_none(gating.scaled_frame(shots, time, s.frames), s.frames)
    raise ValueError(f"unknown gate {s.gate!r}")


def _turned(samples: DataFrame, matrix: np.ndarray, keys: list[str]) -> DataFrame:
    rest = [c for c in samples.columns if c not in {"coil", "re", "im", *keys}]
    other = samples.where("coil = 0").select(*keys, *rest)
    made = coils.apply_matrix(samples.select(*keys, "coil", "re", "im"), coils.matrix_table(samples.sparkSession, matrix), keys, "coil")
    return made.join(other, keys)


def prepare(spark: SparkSession, samples: DataFrame, sizes: dict[str, int], s: Setup = Setup(), options: recon.Options = recon.Options(), noise: DataFrame | None = None, shots: DataFrame | None = None) -> recon.Encoding:
    """``samples(coil, encode, shot, sample, k<axis>, kw, re, im)`` -> an encoding ready for ``recon``.

    ``noise`` holds rows ``re0, im0, re1, ...`` of all coils; ``shots`` holds ``shot, time, resp`` and names the frames.
    """
    names, keys = list(sizes), ["encode", "shot", "sample"]
    trajectory = [f"k{a}" for a in names]
    many = samples.agg(F.max("coil")).first()[0] + 1
    channels = [(f"re{c}", f"im{c}") for c in range(many)]
    if s.whiten and noise is not None:
        samples = recon.stored(_turned(samples, coils.whitening_matrix(noise, channels), keys), "whitened")
    if s.virtual_coils and s.virtual_coils < many:
        near = shape.k_radius_filter(samples, s.compress_radius, tuple(trajectory))
        wide = near.groupBy(*keys).agg(*[F.max(F.when(F.col("coil") == c, F.col(p))).alias(f"{p}{c}") for c in range(many) for p in ("re", "im")])
        samples = recon.stored(_turned(samples, coils.compression_matrix(wide, channels, s.virtual_coils), keys), "compressed")
        many = s.virtual_coils
    if s.density == "iterate":
        axes = [stencil.Axis(t, 2 * sizes[a] + 16, 2.0) for t, a in zip(trajectory, names, strict=True)]
        one = samples.where("coil = 0").select(*keys, *trajectory)
        found = stencil.density_weights(one, axes, keys, lambda df: recon.stored(df, "density"), s.density_rounds, acceleration=s.density_acceleration, drop=recon.dropped)
        samples = recon.stored(samples.drop("kw").join(found.select(*keys, F.col("w").alias("kw")), keys), "weighted")
    low = recon.Encoding(samples.where("encode = 0").withColumn("frame", F.lit(0)), sizes, None, options)
    maps = coil_maps(low.images(low.samples).drop("frame"), sizes, many, s)
    maps = recon.stored(maps, "maps") if maps is not None else None
    if s.difference:
        rest = [c for c in samples.columns if c not in {"coil", "encode", "shot", "sample", "re", "im"}]
        where = samples.where("encode > 0").select("coil", (F.col("encode") - 1).alias("encode"), "shot", "sample", *rest)
        samples = shape.complex_difference(samples, ["coil", "shot", "sample"], ["re", "im"]).join(where, ["coil", "encode", "shot", "sample"])
    if shots is not None:
        framed = gated(shots, s, "time", "resp", ["time", "shot"]).select("shot", "frame")
        samples = shape.with_shot_signal(samples, framed, ["shot"], ["frame"])
    else:
        samples = samples.withColumn("frame", F.lit(0))
    # A solver's sample is one of all encodes and shots of a frame.
    place = F.xxhash64("encode", "shot", "sample")
    return recon.Encoding(recon.stored(samples.withColumn("sample", place), "prepared"), sizes, maps, options)
