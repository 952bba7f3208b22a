"""Vascular phantom: a branching tree, arrival times, rasterised volumes, and fields of wire-loop coils."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "seg_id int, parent int, child0 int, child1 int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, q double, length double"


def segment_cost(length: float, flow: float) -> float:
    """Cost of a vessel of this length and flow."""
    return length * flow ** (2 / 3)


def grow_tree(terminals: np.ndarray, root: np.ndarray) -> list[dict]:
    """Greedy branching: each terminal joins the segment at whose midpoint the added cost is least.

    A tree is small (its terminals) and serial by nature, so it grows on the driver.
    """
    segments = [{"parent": -1, "kids": [], "a": np.asarray(root, float), "b": np.asarray(terminals[0], float), "q": 1.0}]
    for t in np.asarray(terminals[1:], float):
        best, cost = 0, math.inf
        for i, s in enumerate(segments):
            m = (s["a"] + s["b"]) / 2
            before = segment_cost(np.linalg.norm(s["b"] - s["a"]), s["q"])
            half = np.linalg.norm(s["b"] - s["a"]) / 2
            c = segment_cost(half, s["q"] + 1) + segment_cost(half, s["q"]) + segment_cost(np.linalg.norm(t - m), 1.0) - before
            if c < cost:
                best, cost = i, c
        s = segments[best]
        m = (s["a"] + s["b"]) / 2
        low = {"parent": best, "kids": s["kids"], "a": m, "b": s["b"], "q": s["q"]}
        new = {"parent": best, "kids": [], "a": m, "b": t, "q": 1.0}
        for k in s["kids"]:
            segments[k]["parent"] = len(segments)
        s["b"], s["kids"] = m, [len(segments), len(segments) + 1]
        segments += [low, new]
        up = best
        while up >= 0:
            segments[up]["q"] += 1
            up = segments[up]["parent"]
    return segments


def tree_table(spark: SparkSession, segments: list[dict]) -> DataFrame:
    rows = []
    for i, s in enumerate(segments):
        kids = [*s["kids"], -1, -1][:2]
        rows.append((i, s["parent"], kids[0], kids[1], *map(float, s["a"]), *map(float, s["b"]), float(s["q"]), float(np.linalg.norm(s["b"] - s["a"]))))
    return spark.createDataFrame(rows, SEGMENT)


def arrival_times(tree: DataFrame, speed: float = 1.0, max_depth: int = 64) -> DataFrame:
    """``seg_id, time``: transit from the root to each segment's start, level by level through parents."""
    base = tree.select("seg_id", "parent", (F.col("length") / speed).alias("own"))
    level = base.where("parent < 0").select("seg_id", F.lit(0.0).alias("time"), "own")
    found = level
    for _ in range(max_depth):
        level = base.join(level.select(F.col("seg_id").alias("parent"), (F.col("time") + F.col("own")).alias("time")), "parent").select("seg_id", "time", "own")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found.select("seg_id", "time")


def rasterise(tree: DataFrame, times: DataFrame, size: int, steps: int = 16) -> DataFrame:
    """``z, y, x, density, time``: points along segments in ``[-1, 1)``, densities summed, time of the densest vessel."""
    s = tree.join(times, "seg_id").withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    f = (F.col("f") + 0.5) / steps
    cell = lambda a: F.floor((F.col(f"{a}0") + f * (F.col(f"{a}1") - F.col(f"{a}0")) + 1) / 2 * size).cast("int")
    points = s.select(cell("z").alias("z"), cell("y").alias("y"), cell("x").alias("x"), (F.col("q") * F.col("length") / steps).alias("d"), "time")
    kept = points.where(" and ".join(f"{a} between 0 and {size - 1}" for a in "zyx"))
    return kept.groupBy("z", "y", "x").agg(F.sum("d").alias("density"), F.max_by("time", "d").alias("time"))


def wire_loop(coil: int, coils: int, pieces: int = 32, radius: float = 0.5, distance: float = 1.2) -> np.ndarray:
    """Start and end points of a loop that faces the centre from its place on a circle around the z axis."""
    turn = 2 * math.pi * coil / coils
    a = 2 * math.pi * np.arange(pieces + 1) / pieces
    flat = np.stack([np.full(pieces + 1, distance), radius * np.cos(a), radius * np.sin(a)], 1)
    rotation = np.array([[math.cos(turn), -math.sin(turn), 0], [math.sin(turn), math.cos(turn), 0], [0, 0, 1]])
    p = flat @ rotation.T
    return np.concatenate([p[:-1], p[1:]], 1)


def biot_savart(spark: SparkSession, voxels: DataFrame, size: int, coils: int) -> DataFrame:
    """``coil, z, y, x, re, im``: transverse field of each loop at each voxel, one broadcast of wire pieces."""
    rows = [(c, *map(float, w)) for c in range(coils) for w in wire_loop(c, coils)]
    wires = spark.createDataFrame(rows, "coil int, ax double, ay double, az double, bx double, by double, bz double")
    p = voxels.select("z", "y", "x", *[((F.col(a) + 0.5) * (2.0 / size) - 1.0).alias(f"p{a}") for a in "xyz"])
    met = p.crossJoin(F.broadcast(wires))  # a few dozen pieces for each coil
    r = {a: F.col(f"p{a}") - (F.col(f"a{a}") + F.col(f"b{a}")) / 2 for a in "xyz"}
    d = {a: F.col(f"b{a}") - F.col(f"a{a}") for a in "xyz"}
    cube = F.pow(r["x"] * r["x"] + r["y"] * r["y"] + r["z"] * r["z"], F.lit(1.5))
    bx, by = (d["y"] * r["z"] - d["z"] * r["y"]) / cube, (d["z"] * r["x"] - d["x"] * r["z"]) / cube
    return met.groupBy("coil", "z", "y", "x").agg(F.sum(bx).alias("re"), F.sum(by).alias("im"))
