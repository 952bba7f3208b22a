"""Density steps go by places: stencil rows are made once for equal coordinates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larmor.functions import kernels
from larmor.operators import stencil

AXES = [stencil.Axis("kx", 12), stencil.Axis("ky", 8)]
ROWS = [(0, 0.25, 1.0), (1, 0.25, 1.0), (2, -3.5, 0.5), (2, 1.75, -2.0), (3, 40.0, 0.0), (None, 0.25, 1.0), (4, None, 1.0), (5, -0.0, 1.0), (6, 0.0, 1.0)]


def weight(x, wide):
    x = abs(x) / wide / 2.0
    return sum(c * x**i for i, c in enumerate(kernels.POLYNOMIAL)) if x <= 1 else 0.0


def plain(rounds, acceleration):
    """Weights row by row over dense grids; rows of equal keys share the sum of their denominators."""
    w = np.ones(len(ROWS))
    wide = [1 + np.hypot(x, y) / 128 * (acceleration - 1) if x is not None else 1 for _, x, y in ROWS]
    near = lambda x, y, f: np.zeros((12, 8)) if x is None else np.array([[weight(i - x - 6, f) * weight(j - y - 4, f) for j in range(8)] for i in range(12)])
    for _ in range(rounds):
        grid = sum(v * near(x, y, 1.0) for v, (_, x, y) in zip(w, ROWS, strict=True))
        d = [(near(x, y, f) * grid).sum() for f, (_, x, y) in zip(wide, ROWS, strict=True)]
        shared = [0.0 if k is None else sum(e for e, (other, _, _) in zip(d, ROWS, strict=True) if other == k) for k, _, _ in ROWS]
        w = np.array([0.0 if abs(s) < 1e-3 else v / s for v, s in zip(w, shared, strict=True)])
    return [abs(v) * f**3 for v, f in zip(w, wide, strict=True)]


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_places_give_the_weights_of_rows(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(stencil, "BROADCAST_ROWS", bound)
    s = spark.createDataFrame([(n, *r) for n, r in enumerate(ROWS)], "n int, k int, kx double, ky double")
    made, gone = [], []

    def store(df):
        made.append(df)
        df.write.parquet(f"{tmp_path}/{len(made)}")
        return spark.read.parquet(f"{tmp_path}/{len(made)}")

    found = stencil.density_weights(s, AXES, ["k"], store, 3, acceleration=3.0, drop=lambda *t: gone.extend(t))
    got = {r["n"]: r["w"] for r in found.collect()}
    want = plain(3, 3.0)
    for n, (_, x, _) in enumerate(ROWS):
        if x is not None:
            assert got[n] == pytest.approx(want[n], rel=1e-9), n
    assert not got[6]
    assert len(gone) == 8  # two tables of places a round and the weights of the first two


def test_stencil_rows_are_those_of_places(spark, tmp_path, monkeypatch):
    s = spark.range(3000).select("id", (F.col("id") % 3).cast("double").alias("kx"), F.lit(0.5).alias("ky"), F.lit(1.0).alias("w"))
    sizes, make = [], stencil.stencil
    monkeypatch.setattr(stencil, "stencil", lambda df, *a, **k: sizes.append(df.count()) or make(df, *a, **k))
    got = stencil.density_step(s, AXES, ["id"])
    assert got.count() == 3000 and sizes == [3, 3]
