"""Block kernels: FFT, wavelets and low-rank steps on whole volumes, lines or patches, by NumPy in Arrow groups.

A block operator groups a long table by its keys, makes one dense array for each group, applies a kernel
and gives the long table back.  A group is one volume, line or patch: its size is that of the image, not
of the data set.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larmor.operators.lines import LOW_PASS, high_pass

Kernel = Callable[[np.ndarray], np.ndarray]


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def on_blocks(df: DataFrame, keys: list[str], axes: dict[str, int], kernel: Kernel) -> DataFrame:
    """``keys, axes, re, im`` -> the same after ``kernel`` on each key's dense complex array; absent places are 0.

    The kernel may change the sizes; rows come for every place of its result.
    """
    names, sizes = list(axes), tuple(axes.values())

    def run(table: pa.Table) -> pa.Table:
        x = np.zeros(sizes, complex)
        at = tuple(table.column(a).to_numpy() for a in names)
        np.add.at(x, at, table.column("re").to_numpy() + 1j * table.column("im").to_numpy())
        y = np.asarray(kernel(x), complex)
        grid = np.indices(y.shape).reshape(len(names), -1).astype(np.int32)
        columns = {k: pa.array([table.column(k)[0].as_py()] * y.size, table.schema.field(k).type) for k in keys}
        columns |= {a: pa.array(g) for a, g in zip(names, grid, strict=True)}
        return pa.table(columns | {"re": pa.array(y.real.ravel()), "im": pa.array(y.imag.ravel())})

    schema = ", ".join(filter(None, [_fields(df, keys), *[f"`{a}` int" for a in names], "re double, im double"]))
    grouped = df.select(*keys, *[F.col(a).cast("int").alias(a) for a in names], F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    return grouped.groupBy(*keys).applyInArrow(run, schema)


def fft(x: np.ndarray, inverse: bool = False, axes: tuple[int, ...] | None = None, chop: bool = True) -> np.ndarray:
    """Orthonormal transform along ``axes``; with ``chop`` the checkerboard is applied before and after."""
    axes = tuple(range(x.ndim)) if axes is None else axes
    sign = np.ones(())
    if chop:
        for a in axes:
            s = 2.0 * (np.arange(x.shape[a]) % 2) - 1
            sign = sign * s.reshape([-1 if i == a else 1 for i in range(x.ndim)])
    return sign * (np.fft.ifftn if inverse else np.fft.fftn)(sign * x, axes=axes, norm="ortho")


def fft_blocks(df: DataFrame, keys: list[str], axes: dict[str, int], inverse: bool = False, along: list[str] | None = None, chop: bool = True) -> DataFrame:
    which = tuple(list(axes).index(a) for a in (along or axes))
    return on_blocks(df, keys, axes, lambda x: fft(x, inverse, which, chop))


def wave_level(x: np.ndarray, axis: int, taps: list[float], inverse: bool = False, shift: int = 0) -> np.ndarray:
    """One periodic wavelet level along an axis."""
    x = np.moveaxis(x, axis, -1)
    n = x.shape[-1]
    low, high = np.array(taps), np.array(high_pass(taps))
    p, f = np.arange(n // 2)[:, None], np.arange(len(low))[None, :]
    place = (2 * p - f + shift) % n
    if not inverse:
        y = np.concatenate([(x[..., place] * low).sum(-1), (x[..., place] * high).sum(-1)], -1)
    else:
        y = np.zeros_like(x)
        part = x[..., : n // 2, None] * low + x[..., n // 2 :, None] * high
        np.add.at(np.moveaxis(y, -1, 0), place, np.moveaxis(part, (-2, -1), (0, 1)))
    return np.moveaxis(y, -1, axis)


def levels_for(size: int, wanted: int) -> int:
    """Levels reduced until the size divides by ``2 ** levels``."""
    while wanted and size % (1 << wanted):
        wanted -= 1
    return wanted


def wavelet3d(x: np.ndarray, levels: int, name: str = "db4", inverse: bool = False, shift: tuple[int, ...] | None = None, axes: tuple[int, ...] | None = None) -> np.ndarray:
    """Separable multilevel transform of the axes whose sizes allow it; a shift gives a cycle spin."""
    axes = tuple(range(x.ndim)) if axes is None else axes
    shift = shift or (0,) * x.ndim
    depth = {a: levels_for(x.shape[a], levels) for a in axes}
    y = x.astype(complex)
    order = range(max(depth.values(), default=0))
    for level in reversed(order) if inverse else order:
        live = [a for a in axes if depth[a] > level]
        box = tuple(slice(0, x.shape[a] >> level) if a in live else slice(None) for a in range(x.ndim))
        part = y[box]
        for a in reversed(live) if inverse else live:
            part = wave_level(part, a, LOW_PASS[name], inverse, shift[a])
        y[box] = part
    return y


def soft(x: np.ndarray, t: float) -> np.ndarray:
    m = np.abs(x)
    return np.where(m <= t, 0, x * (1 - t / np.maximum(m, 1e-300)))


def patches(shape: tuple[int, ...], block: int, shift: tuple[int, ...]) -> list[tuple[np.ndarray, ...]]:
    """Index arrays of the whole blocks of a periodic shift; places beyond the last whole block are left out."""
    per = [[(np.arange(block) + b * block + s) % n for b in range(n // block)] for n, s in zip(shape, shift, strict=True)]
    out = [()]
    for axis in per:
        out = [(*o, a) for o in out for a in axis]
    return [np.ix_(*o) for o in out]


def low_rank(x: np.ndarray, threshold: float, block: int = 4, rounds: int = 4, seed: int = 0) -> np.ndarray:
    """Singular values of every (columns x block) matrix shrunk by ``threshold / rounds`` in shifted rounds.

    The first axis holds the columns (frames, encodes or coils), the others are spatial.
    """
    rng, y = np.random.default_rng(seed), x.astype(complex).copy()
    for _ in range(rounds):
        shift = tuple(int(v) for v in rng.integers(-(block // 2), block - block // 2, x.ndim - 1)) if rounds > 1 else (0,) * (x.ndim - 1)
        for at in patches(x.shape[1:], block, shift):
            m = np.stack([frame[at].ravel() for frame in y])
            u, s, v = np.linalg.svd(m, full_matrices=False)
            m = (u * np.maximum(s - threshold / rounds, 0)) @ v
            for frame, values in zip(y, m, strict=True):
                frame[at] = values.reshape(frame[at].shape)
    return y


def leading_singular(x: np.ndarray, block: int = 4) -> np.ndarray:
    """Leading singular value of every unshifted block."""
    return np.array([np.linalg.svd(np.stack([f[at].ravel() for f in x]), compute_uv=False)[0] for at in patches(x.shape[1:], block, (0,) * (x.ndim - 1))])


def low_rank_scale(x: np.ndarray, iteration: int, amplitude: float = 4.0, decay: float = 6.0, block: int = 4) -> float:
    """Median of the non-zero leading singular values, raised in early iterations."""
    s = leading_singular(x, block)
    s = s[s > 0]
    return float(np.median(s) * (1 + amplitude * np.exp(-iteration / decay))) if len(s) else 0.0


def block_scale(df: DataFrame, keys: list[str], column: str, columns: int, axes: dict[str, int], iteration: int, amplitude: float = 4.0, decay: float = 6.0, block: int = 4) -> float:
    """``low_rank_scale`` of a long table: the leading singular value of every block, a group each, and their median."""
    names = list(axes)
    whole = F.lit(True)
    for a, n in axes.items():
        whole &= F.col(a) < n // block * block

    def lead(table: pa.Table) -> pa.Table:
        _, at = np.unique(np.stack([table.column(a).to_numpy() for a in names]), axis=1, return_inverse=True)
        m = np.zeros((columns, at.max() + 1), complex)
        m[table.column(column).to_numpy(), at] = table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
        return pa.table({"s": pa.array([float(np.linalg.svd(m, compute_uv=False)[0])])})

    cells = [F.floor(F.col(a) / block).cast("int").alias(f"__b{a}") for a in names]
    found = df.where(whole).select(*keys, column, *names, "re", "im", *cells).groupBy(*keys, *[f"__b{a}" for a in names]).applyInArrow(lead, "s double")
    median = found.where("s > 0").agg(F.percentile("s", F.lit(0.5))).first()[0]
    return float(median * (1 + amplitude * np.exp(-iteration / decay))) if median is not None else 0.0


def low_rank_slabs(df: DataFrame, keys: list[str], column: str, columns: int, axes: dict[str, int], threshold: float, block: int = 4, rounds: int = 4, seed: int = 0) -> DataFrame:
    """One shifted round after another, each over blocks as groups: no task holds more than its blocks.

    A place's block in a round is ``pmod(place - shift, size) div block``; the rest of an axis that fills no
    whole block passes through.
    """
    rng, schema = np.random.default_rng(seed), ", ".join(filter(None, [_fields(df, keys), f"`{column}` int", *[f"`{a}` int" for a in axes], "re double, im double"]))
    names = list(axes)
    df = df.select(*keys, F.col(column).cast("int").alias(column), *[F.col(a).cast("int").alias(a) for a in names], "re", "im")
    for _ in range(rounds):
        shift = [int(v) for v in rng.integers(-(block // 2), block - block // 2, len(names))] if rounds > 1 else [0] * len(names)
        moved = {a: F.pmod(F.col(a) - s, F.lit(n)) for (a, n), s in zip(axes.items(), shift, strict=True)}
        whole = F.lit(True)
        for a, n in axes.items():
            whole &= moved[a] < n // block * block
        cells = [F.floor(moved[a] / block).cast("int").alias(f"__b{a}") for a in names]

        def shrink(table: pa.Table) -> pa.Table:
            place = [table.column(a).to_numpy() for a in names]
            _, at = np.unique(np.stack(place), axis=1, return_inverse=True)
            col = table.column(column).to_numpy()
            m = np.zeros((columns, at.max() + 1), complex)
            m[col, at] = table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
            u, s, v = np.linalg.svd(m, full_matrices=False)
            m = ((u * np.maximum(s - threshold / rounds, 0)) @ v)[col, at]
            out = table.select([*keys, column, *names])
            return out.append_column("re", pa.array(m.real)).append_column("im", pa.array(m.imag))

        kept = df.where(whole).select("*", *cells).groupBy(*keys, *[f"__b{a}" for a in names]).applyInArrow(shrink, schema)
        df = kept.unionByName(df.where(~whole))
    return df


def combine_blocks(df: DataFrame, keys: list[str], column: str, columns: int, axes: dict[str, int], block: int = 4) -> DataFrame:
    """``keys, axes, re, im``: the columns (coils) of every block projected on its leading right singular vector.

    Each block is a group of its own; blocks at the far end of an axis are what is left of it.
    """
    names = list(axes)
    schema = ", ".join(filter(None, [_fields(df, keys), *[f"`{a}` int" for a in names], "re double, im double"]))
    df = df.select(*keys, F.col(column).cast("int").alias(column), *[F.col(a).cast("int").alias(a) for a in names], F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))

    def project(table: pa.Table) -> pa.Table:
        place = np.stack([table.column(a).to_numpy() for a in names])
        voxel, at = np.unique(place, axis=1, return_inverse=True)
        m = np.zeros((voxel.shape[1], columns), complex)
        m[at, table.column(column).to_numpy()] = table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
        y = principal_channel(m)
        out = {k: pa.array([table.column(k)[0].as_py()] * len(y), table.schema.field(k).type) for k in keys}
        return pa.table(out | {a: pa.array(v.astype(np.int32)) for a, v in zip(names, voxel, strict=True)} | {"re": pa.array(y.real), "im": pa.array(y.imag)})

    cells = [F.floor(F.col(a) / block).cast("int").alias(f"__b{a}") for a in names]
    return df.select("*", *cells).groupBy(*keys, *[f"__b{a}" for a in names]).applyInArrow(project, schema)


def phase_rotation(frames: np.ndarray, width: float = 0.25, slope: float = 0.05) -> np.ndarray:
    """Unit phase of the low-passed sum of the frames; multiply by its conjugate to remove it, by itself to restore it."""
    total = fft(frames.sum(0))
    for a, n in enumerate(total.shape):
        r = np.abs(np.arange(n) - n // 2) / n
        w = 1 / (1 + np.exp((r - width) / slope))
        total = total * w.reshape([-1 if i == a else 1 for i in range(total.ndim)])
    smooth = fft(total, inverse=True)
    m = np.abs(smooth)
    return np.where(m > 0, smooth / np.where(m > 0, m, 1), 1)


def temporal_basis(frames: np.ndarray, block: int = 8) -> np.ndarray:
    """Principal directions over frames from sums over blocks: rows of a unitary matrix, strongest first."""
    sums = np.array([[f[at].sum() for at in patches(frames.shape[1:], min(block, *frames.shape[1:]), (0,) * (frames.ndim - 1))] for f in frames])
    return np.linalg.svd(sums, full_matrices=True)[0].conj().T


def principal_channel(x: np.ndarray) -> np.ndarray:
    """Channels (rows: samples) combined by the leading right singular vector, whose strongest channel has phase 0."""
    v = np.linalg.svd(x, full_matrices=False)[2][0]
    v = v * np.exp(-1j * np.angle(v[np.argmax(np.abs(v))]))
    return x @ v.conj()


def walsh_maps(images: np.ndarray, block: int = 8) -> np.ndarray:
    """Coil maps (coil, z, y, x) from the leading left singular vector of each voxel's neighbourhood.

    The vector is scaled by the root of its singular value and referenced to the strongest coil's phase;
    neighbourhoods are moved inwards at the edges.
    """
    coils, shape = images.shape[0], images.shape[1:]
    strongest = int(np.argmax((np.abs(images) ** 2).reshape(coils, -1).sum(1)))
    size = [min(block, n) for n in shape]
    out = np.zeros_like(images, dtype=complex)
    lows = [np.clip(np.arange(n) - s // 2, 0, n - s) for n, s in zip(shape, size, strict=True)]
    for index in np.ndindex(*shape):
        box = tuple(slice(lo[i], lo[i] + s) for lo, i, s in zip(lows, index, size, strict=True))
        u, s, _ = np.linalg.svd(images[(slice(None), *box)].reshape(coils, -1), full_matrices=False)
        out[(slice(None), *index)] = np.sqrt(s[0]) * u[:, 0] * np.exp(-1j * np.angle(u[strongest, 0]))
    return out


