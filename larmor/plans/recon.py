"""Reconstructions: direct, conjugate gradient, thresholded (IST, FISTA), calibrationless low rank, splitting.

Samples and images stay in long tables.  The encoding operator multiplies by coil maps, transforms each
(frame, coil) volume as a block and interpolates; its adjoint scatters, transforms back and combines.
Solvers are loops on the driver over these two: an iteration is one written table and a few sums.
"""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larmor.functions import cplx, kernels
from larmor.operators import blocks, coils, regularise, stencil

KEY = ["frame", "coil"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder of ``spark.checkpoint.dir`` and read back: lineage ends here."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="larmor-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Delete the tables behind results of ``stored`` that nothing reads any more, and have the shuffle files of ended steps deleted."""
    for df in tables:
        spark = df.sparkSession
        if path := df.__dict__.pop("_stored", None):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    if tables:
        spark._jvm.System.gc()


def windowed(x: np.ndarray, windows: list[np.ndarray]) -> np.ndarray:
    """Every axis times its window."""
    for i, w in enumerate(windows):
        x = x * w.reshape([-1 if i == j else 1 for j in range(x.ndim)])
    return x


@dataclass(frozen=True)
class Options:
    """What to reconstruct and how; the defaults of the method it follows."""

    method: str = "cg"  # sos, pils, cg, ist, fista, clear, admm
    iterations: int = 10
    overgrid: float = 1.5
    kernel: str = "kaiser_bessel"
    l2: float = 0.0
    threshold: float = 0.0  # share of the largest coefficient
    time_transform: str = "none"  # none, dft, diff, wavelet, pca or composite, around the threshold
    phase: bool = False  # remove the smooth phase of the sum of frames around the threshold
    levels: int = 2
    wavelet: str = "db4"
    low_rank: float = 0.0
    block: int = 4
    step: str = "power"  # power or cauchy
    power_rounds: int = 30
    stop: float = 0.0  # standard deviation of the last five residual ratios; 0: never
    seed: int = 0


@dataclass
class Encoding:
    """Sampling of images of ``sizes`` (axis name -> voxels) along the trajectory columns of the same names, ``k`` before."""

    samples: DataFrame  # frame, coil, sample, k<axis> ..., kw, re, im
    sizes: dict[str, int]
    maps: DataFrame | None = None  # coil, axes, re, im
    options: Options = field(default_factory=Options)

    def __post_init__(self) -> None:
        self.names = list(self.sizes)
        self.grid = {a: 16 * math.ceil(self.options.overgrid * n / 16) for a, n in self.sizes.items()}
        self.axes = [stencil.Axis(f"k{a}", self.grid[a], self.grid[a] / n) for a, n in self.sizes.items()]
        self.windows = [self._window(a) for a in self.names]

    def _window(self, axis: str) -> np.ndarray:
        """Inverse transform of the kernel over the crop, divided by its largest value."""
        n, s = self.sizes[axis], self.grid[axis]
        half, kind = kernels.HALF_WIDTH[self.options.kernel], self.options.kernel
        d = np.arange(-math.floor(half), math.floor(half) + 1)
        if kind == "kaiser_bessel":
            beta = kernels.kaiser_bessel_beta(2 * half, 1.5)
            k = np.i0(beta * np.sqrt(np.maximum(0, 1 - (d / half) ** 2))) / np.i0(beta)
        elif kind == "triangle":
            k = 1 - np.abs(d) / half
        else:
            raise ValueError("images are made with the triangle or the Kaiser-Bessel kernel")
        x = np.arange(n) - n // 2
        w = 1 / np.maximum(np.cos(2 * np.pi * np.outer(x, d) / s) @ k, 1e-6)
        return w / w.max()

    def _crop(self) -> tuple[slice, ...]:
        return tuple(slice(self.grid[a] // 2 - n // 2, self.grid[a] // 2 - n // 2 + n) for a, n in self.sizes.items())

    def images(self, samples: DataFrame) -> DataFrame:
        """Gridded image of every frame and coil."""
        spread = stencil.scatter(samples, self.axes, ["re", "im"], "kw", KEY, self.options.kernel)
        cells = {a.cell: a.size for a in self.axes}
        box, windows = self._crop(), self.windows
        made = blocks.on_blocks(spread, KEY, cells, lambda x: windowed(blocks.fft(x, inverse=True)[box], windows))
        return made.select(*KEY, *[F.col(f"ck{a}").alias(a) for a in self.names], "re", "im")

    def adjoint(self, samples: DataFrame) -> DataFrame:
        """Combined over coils with the conjugate maps."""
        found = self.images(samples)
        voxel = ["frame", *self.names]
        if self.maps is None:
            return found.groupBy(*voxel).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
        m = self.maps.select("coil", *self.names, F.col("re").alias("mr"), F.col("im").alias("mi"))
        p = cplx.mul(cplx.pair("re", "im"), cplx.conj(cplx.pair("mr", "mi")))
        return found.join(m, ["coil", *self.names]).groupBy(*voxel).agg(F.sum(p[0]).alias("re"), F.sum(p[1]).alias("im"))

    def per_coil(self, image: DataFrame) -> DataFrame:
        """An image times each coil's map."""
        if self.maps is None:
            return image.crossJoin(F.broadcast(self.samples.select("coil").distinct())).select(*KEY, *self.names, "re", "im")
        m = self.maps.select("coil", *self.names, F.col("re").alias("mr"), F.col("im").alias("mi"))
        p = cplx.mul(cplx.pair("re", "im"), cplx.pair("mr", "mi"))
        return image.join(m, self.names).select(*KEY, *self.names, p[0].alias("re"), p[1].alias("im"))

    def sample_images(self, images: DataFrame) -> DataFrame:
        """Samples ``frame, coil, sample, re, im`` of images of every frame and coil."""
        whole, box, windows = tuple(self.grid.values()), self._crop(), self.windows

        def kernel(x: np.ndarray) -> np.ndarray:
            y = np.zeros(whole, complex)
            y[box] = windowed(x, windows)
            return blocks.fft(y)

        grid = blocks.on_blocks(images, KEY, self.sizes, kernel)
        grid = grid.select(*KEY, *[F.col(a).alias(f"ck{a}") for a in self.names], "re", "im")
        return stencil.gather(self.samples, grid, self.axes, ["re", "im"], [*KEY, "sample"], KEY, "kw", self.options.kernel)

    def forward(self, image: DataFrame) -> DataFrame:
        return self.sample_images(self.per_coil(image))

    def weighted(self, data: DataFrame) -> DataFrame:
        """Samples ``frame, coil, sample, re, im`` with trajectory and weight."""
        return self.samples.drop("re", "im").join(data, [*KEY, "sample"])

    def normal(self, image: DataFrame) -> DataFrame:
        return self.adjoint(self.weighted(self.forward(image)))


def _add(a: DataFrame, b: DataFrame, voxel: list[str], factor: complex) -> DataFrame:
    """``a + factor * b`` over equal voxels."""
    o = b.select(*voxel, F.col("re").alias("br"), F.col("im").alias("bi"))
    p = cplx.mul((F.lit(factor.real), F.lit(factor.imag)), (F.col("br"), F.col("bi")))
    return a.join(o, voxel).select(*voxel, (F.col("re") + p[0]).alias("re"), (F.col("im") + p[1]).alias("im"))


def _dot(a: DataFrame, b: DataFrame, voxel: list[str]) -> complex:
    r = coils.conj_sum(a, b, voxel).first()
    return complex(r["re"] or 0.0, r["im"] or 0.0)


def _energy(a: DataFrame) -> float:
    return coils.energy(a).first()["energy"] or 0.0


def _scaled(a: DataFrame, factor: float) -> DataFrame:
    return a.withColumns({"re": F.col("re") * factor, "im": F.col("im") * factor})


def sum_of_squares(e: Encoding) -> DataFrame:
    """Direct gridding; root sum of squares over coils."""
    found = e.images(e.samples)
    return coils.root_sum_squares(found, ["frame", *e.names]).select("frame", *e.names, F.col("sos").alias("re"), F.lit(0.0).alias("im"))


def conjugate_gradient(e: Encoding) -> tuple[DataFrame, list[float]]:
    """Normal equations with an optional multiple of the image added; image and residual energies."""
    voxel, o = ["frame", *e.names], e.options
    r = stored(e.adjoint(e.samples), "cg-r")
    x, p = stored(_scaled(r, 0.0), "cg-x"), r
    energies = [_energy(r)]
    ridge = o.l2
    for _ in range(o.iterations):
        if energies[-1] <= 1e-24 * energies[0]:
            break
        q = e.normal(p)
        q = stored(_add(q, p, voxel, complex(ridge)) if ridge else q, "cg-q")
        alpha = energies[-1] / max(_dot(q, p, voxel).real, 1e-300)
        x = stored(_add(x, p, voxel, complex(alpha)), "cg-x")
        r = stored(_add(r, q, voxel, complex(-alpha)), "cg-r")
        energies.append(_energy(r))
        p = stored(_add(r, p, voxel, complex(energies[-1] / energies[-2])), "cg-p")
    return x, energies


def power_step(e: Encoding, like: DataFrame) -> float:
    """One over the largest eigenvalue of the normal operator, by power iteration from a seeded start."""
    x = stored(like.withColumns({"re": F.rand(e.options.seed) + 0.1, "im": F.lit(0.0)}), "power")
    value = 1.0
    for _ in range(e.options.power_rounds):
        y = stored(e.normal(_scaled(x, 1 / math.sqrt(max(_energy(x), 1e-300)))), "power")
        new = math.sqrt(_energy(y))
        x = y
        if abs(new - value) < 1e-3 * new:
            value = new
            break
        value = new
    return 1 / max(value, 1e-300)


def denoise(e: Encoding, x: DataFrame, iteration: int) -> DataFrame:
    """Low-rank step over frames; then, inside a phase correction and a transform over frames, wavelet threshold of each."""
    o, frames = e.options, None
    if o.low_rank:
        frames = x.agg(F.max("frame")).first()[0] + 1
        cut = o.low_rank * blocks.block_scale(x, [], "frame", frames, e.sizes, iteration, block=o.block)
        x = stored(blocks.low_rank_slabs(x, [], "frame", frames, e.sizes, cut, o.block, seed=o.seed + iteration), "low-rank")
    basis = phase = None
    if o.phase:
        sizes, total = e.sizes, x.groupBy(*e.names).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
        turned = blocks.on_blocks(total, [], sizes, lambda a: blocks.phase_rotation(a[None]))
        phase = stored(turned.select(*e.names, F.atan2("im", "re").alias("angle")), "phase")
        x = regularise.correct_phase(x, e.names, phase)
    if o.time_transform != "none":
        frames = frames or x.agg(F.max("frame")).first()[0] + 1
        x = stored(x, "untransformed")
        mean = stored(x.groupBy(*e.names).agg(F.avg("re").alias("re"), F.avg("im").alias("im")), "composite") if o.time_transform == "composite" else None
        basis = regularise.principal_frames(x, e.sizes, "frame", frames) if o.time_transform == "pca" else None
        x = regularise.along(x, e.names, "frame", frames, o.time_transform, composite=mean, basis=basis)
    if o.threshold:

        def cut(a: np.ndarray) -> np.ndarray:
            spin = np.random.default_rng(o.seed + iteration).integers(0, 4, a.ndim)
            w = blocks.wavelet3d(a, o.levels, o.wavelet, shift=tuple(spin))
            return blocks.wavelet3d(blocks.soft(w, o.threshold * np.abs(w).max()), o.levels, o.wavelet, inverse=True, shift=tuple(spin))

        x = blocks.on_blocks(x, ["frame"], e.sizes, cut)
    if o.time_transform != "none":
        x = regularise.along(x, e.names, "frame", frames, o.time_transform, True, mean, basis)
    if phase is not None:
        x = regularise.correct_phase(x, e.names, phase, restore=True)
    return x.select("frame", *e.names, "re", "im")


def iterative_threshold(e: Encoding) -> tuple[DataFrame, list[float]]:
    """IST, or FISTA with momentum: gradient step, low rank, threshold; image and residual energies."""
    voxel, o = ["frame", *e.names], e.options
    target = stored(e.adjoint(e.samples), "ist-b")
    x = old = stored(_scaled(target, 0.0), "ist-x")
    step = power_step(e, target) if o.step == "power" else None
    energies: list[float] = []
    for n in range(1, o.iterations + 1):
        b = (n - 1) / (n + 1) if o.method == "fista" else 0.0
        y = stored(_add(_scaled(x, 1 + b), old, voxel, complex(-b)), "ist-y") if b else x
        r = stored(_add(target, e.normal(y), voxel, complex(-1)), "ist-r")
        energies.append(_energy(r))
        if step is None:
            rate = energies[-1] / max(_dot(e.normal(r), r, voxel).real, 1e-300)
        else:
            rate = step
        old, x = x, stored(denoise(e, _add(y, r, voxel, complex(rate)), n), "ist-x")
        last = [b / a for a, b in zip(energies, energies[1:], strict=False)][-5:]
        if o.stop and len(last) == 5 and np.std(last) < o.stop:
            break
    return x, energies


def calibrationless(e: Encoding) -> tuple[DataFrame, list[float]]:
    """Coil images kept apart, made alike by low-rank blocks over coils, then combined by block."""
    o = e.options
    voxel = [*KEY, *e.names]
    coils_n = e.samples.agg(F.max("coil")).first()[0] + 1
    target = stored(e.images(e.samples), "clear-b")
    x = stored(_scaled(target, 0.0), "clear-x")
    energies, step = [], None
    for n in range(1, o.iterations + 1):
        r = stored(_add(target, e.images(e.weighted(e.sample_images(x))), voxel, complex(-1)), "clear-r")
        energies.append(_energy(r))
        if step is None:
            step = energies[0] / max(_dot(e.images(e.weighted(e.sample_images(r))), r, voxel).real, 1e-300)
        y = _add(x, r, voxel, complex(step))

        if o.low_rank:
            y = stored(y, "clear-y")
            cut = o.low_rank * blocks.block_scale(y, ["frame"], "coil", coils_n, e.sizes, n, block=o.block)
            y = blocks.low_rank_slabs(y, ["frame"], "coil", coils_n, e.sizes, cut, o.block, seed=o.seed + n)
        x = stored(y, "clear-x")
    return blocks.combine_blocks(x, ["frame"], "coil", coils_n, e.sizes, o.block), energies


def splitting(e: Encoding, penalty: float = 1.0) -> tuple[DataFrame, list[float]]:
    """Standard alternating directions: a quadratic step, a denoising step, a multiplier step."""
    voxel, o = ["frame", *e.names], e.options
    target = stored(e.adjoint(e.samples), "admm-b")
    rate = 1 / (1 / power_step(e, target) + penalty)
    x = z = u = stored(_scaled(target, 0.0), "admm-0")
    energies = []
    for n in range(1, o.iterations + 1):
        for _ in range(3):
            g = _add(target, e.normal(x), voxel, complex(-1))
            pull = _add(_add(z, u, voxel, complex(-1)), x, voxel, complex(-1))
            x = stored(_add(x, _add(g, pull, voxel, complex(penalty)), voxel, complex(rate)), "admm-x")
        z = stored(denoise(e, _add(x, u, voxel, complex(1)), n), "admm-z")
        gap = stored(_add(x, z, voxel, complex(-1)), "admm-gap")
        u = stored(_add(u, gap, voxel, complex(1)), "admm-u")
        energies.append(_energy(gap))
    return z, energies


def reconstruct(spark: SparkSession, samples: DataFrame, sizes: dict[str, int], maps: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """``frame, axes, re, im`` of all frames by the method of the options."""
    e = Encoding(samples, sizes, maps, options)
    if options.method == "sos":
        return sum_of_squares(e)
    if options.method == "pils":
        return e.adjoint(samples)
    solver = {"cg": conjugate_gradient, "ist": iterative_threshold, "fista": iterative_threshold, "clear": calibrationless, "admm": splitting}.get(options.method)
    if solver is None:
        raise ValueError(f"unknown method {options.method!r}")
    return solver(e)[0]
