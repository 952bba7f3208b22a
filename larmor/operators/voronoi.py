"""Density weights as volumes of Voronoi cells, by clipping half-spaces.

One trajectory is one local problem (its points, not its samples over coils and frames); trajectories of
different encodes are separate groups.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def merged(points: np.ndarray, least: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Centres of near-equal points and each point's centre: points join the first one within ``least`` in every axis."""
    order = np.argsort(points[:, 0], kind="stable")
    of = np.full(len(points), -1)
    centres: list[int] = []
    for k, i in enumerate(order):
        if of[i] >= 0:
            continue
        of[i] = len(centres)
        for j in order[k + 1 :]:
            if points[j, 0] - points[i, 0] > least:
                break
            if of[j] < 0 and (np.abs(points[j] - points[i]) < least).all():
                of[j] = len(centres)
        centres.append(i)
    return points[centres], of


def _polygon(centre: np.ndarray, normals: np.ndarray, offsets: np.ndarray, reach: float) -> tuple[float, np.ndarray]:
    """Area and corners of ``{x : normals x <= offsets}`` within a square of half side ``reach``."""
    corners = centre + reach * np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]], float)
    for n, o in zip(normals, offsets, strict=True):
        side = corners @ n - o
        if (side <= 0).all():
            continue
        kept = []
        for i in range(len(corners)):
            a, b, s, t = corners[i], corners[(i + 1) % len(corners)], side[i], side[(i + 1) % len(corners)]
            if s <= 0:
                kept.append(a)
            if (s < 0 < t) or (t < 0 < s):
                kept.append(a + (b - a) * (s / (s - t)))
        if len(kept) < 3:
            return 0.0, np.zeros((0, 2))
        corners = np.array(kept)
    x, y = corners.T
    return 0.5 * abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))), corners


def _polytope(centre: np.ndarray, normals: np.ndarray, offsets: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Volume of a bounded polytope around ``centre``, its reach and which planes bear a face: each face's area times its distance, over three."""
    volume, reach, bears = 0.0, 0.0, np.zeros(len(normals), bool)
    for i, (n, o) in enumerate(zip(normals, offsets, strict=True)):
        height = o - n @ centre
        if height < 0:
            return 0.0, 0.0, bears
        u = np.cross(n, np.eye(3)[np.argmin(np.abs(n))])
        u /= np.linalg.norm(u)
        v = np.cross(n, u)
        foot = centre + height * n
        rest = np.delete(np.arange(len(normals)), i)
        flat = np.stack([normals[rest] @ u, normals[rest] @ v], 1)
        left = offsets[rest] - normals[rest] @ foot
        size = np.linalg.norm(flat, axis=1)
        if (left[size < 1e-12] < -1e-12).any():
            continue
        real = size > 1e-12
        area, corners = _polygon(np.zeros(2), flat[real] / size[real, None], left[real] / size[real], 1e3)
        volume += height * area / 3
        bears[i] = len(corners) > 0
        reach = max(reach, np.sqrt(height**2 + (corners**2).sum(1).max(initial=0)))
    return volume, reach, bears


def _clipped(cell: Callable[[np.ndarray], tuple[float, float, np.ndarray]], far: np.ndarray, first: int) -> float:
    """Size of the cell that ``cell`` gives as (size, reach, points that bear a face) for walls to some points.

    ``first`` nearest points come first, then as many more at a time, until the next is too far to cut.  A wall
    without a face has none in a smaller cell either and is left out from then on.
    """
    order = np.argsort(far)
    order = order[np.isfinite(far[order])]
    first = max(first, 1)
    k, walls = first, order[:first]
    while True:
        size, reach, bears = cell(walls)
        more = order[k : k + first]
        more = more[far[more] <= 2 * reach]
        if not len(more):
            return size
        k, walls = k + first, np.concatenate([walls[bears], more])


def cell_volumes(points: np.ndarray, radius: float, neighbours: int = 40) -> np.ndarray:
    """Cell of each point within a sphere (or circle) of ``radius`` around the origin; 0 for points outside.

    Walls are the planes halfway to the nearest points, the box, and the sphere's tangent plane outward of
    the point.  ``neighbours`` points are taken first; clipping stops once a further point is more than twice as far as the cell reaches.
    """
    dim = points.shape[1]
    out = np.zeros(len(points))
    axes = np.concatenate([np.eye(dim), -np.eye(dim)])
    for i, p in enumerate(points):
        r = np.linalg.norm(p)
        if r > radius:
            continue
        d = points - p
        far = np.linalg.norm(d, axis=1)
        far[i] = np.inf

        def cell(near: np.ndarray) -> tuple[float, float, np.ndarray]:
            normals = [*axes, *(d[near] / far[near, None])]
            offsets = [*[radius] * (2 * dim), *((d[near] / far[near, None] * (points[near] + p) / 2).sum(1))]
            if r > 1e-9:
                normals.append(p / r)
                offsets.append(radius)
            normals, offsets = np.array(normals), np.array(offsets)
            if dim == 3:
                volume, reach, bears = _polytope(p, normals, offsets)
                return volume, reach, bears[2 * dim : 2 * dim + len(near)]
            area, corners = _polygon(np.zeros(2), normals, offsets, radius)
            return area, np.linalg.norm(corners - p, axis=1).max(initial=0), np.ones(len(near), bool)

        out[i] = _clipped(cell, far, neighbours)
    return out


def sphere_weights(points: np.ndarray, radius: float = 16.0, neighbours: int = 40) -> np.ndarray:
    """Weights of directions: cells on a shell of ``radius`` (one thick to either side) times the original radius."""
    length = np.linalg.norm(points, axis=1)
    on = points / np.maximum(length, 1e-12)[:, None] * radius
    out = np.zeros(len(points))
    for i, p in enumerate(on):
        if length[i] == 0:
            continue
        d = on - p
        far = np.linalg.norm(d, axis=1)
        far[far < 1e-9] = np.inf
        n = p / radius

        def cell(near: np.ndarray) -> tuple[float, float, np.ndarray]:
            normals = np.array([*(d[near] / far[near, None]), n, -n, *np.eye(3), *-np.eye(3)])
            offsets = np.array([*((d[near] / far[near, None] * (on[near] + p) / 2).sum(1)), radius + 1, 1 - radius, *[radius + 1] * 6])
            volume, reach, bears = _polytope(p, normals, offsets)
            return volume, reach, bears[: len(near)]

        out[i] = _clipped(cell, far, neighbours) * length[i]
    return out


def density_weights(samples: DataFrame, keys: list[str], axes: list[str], kmax: float | None = None) -> DataFrame:
    """``keys, sample, kw``: cell volumes shared evenly among near-equal points; 0 beyond ``kmax - 1``."""

    def run(table: pa.Table) -> pa.Table:
        points = np.stack([table.column(a).to_numpy().astype(float) for a in axes], 1)
        centres, of = merged(points)
        top = np.linalg.norm(points, axis=1).max() if kmax is None else kmax
        volume = cell_volumes(centres, max(top - 1, 1e-9))
        share = np.bincount(of, minlength=len(centres))
        return table.select([*keys, "sample"]).append_column("kw", pa.array(volume[of] / share[of]))

    schema = ", ".join([*[f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys], "sample long", "kw double"])
    return samples.select(*keys, "sample", *axes).withColumn("sample", samples["sample"].cast("long")).groupBy(*keys).applyInArrow(run, schema)

