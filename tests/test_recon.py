import numpy as np
import pytest
from pyspark.sql import functions as F

from larmor.operators import blocks
from larmor.operators.lines import LOW_PASS
from larmor.plans import recon

SIZES = {"y": 8, "x": 8}


@pytest.fixture(scope="module")
def encoding(spark):
    rng = np.random.default_rng(0)
    rows = [(f, c, i, float(ky), float(kx), 1.0, 0.0, 0.0) for f in range(2) for c in range(2) for i, (ky, kx) in enumerate(rng.uniform(-3.5, 3.5, (90, 2)))]
    samples = recon.stored(spark.createDataFrame(rows, "frame int, coil int, sample int, ky double, kx double, kw double, re double, im double"), "samples")
    maps = spark.createDataFrame([(c, y, x, 0.5 + 0.1 * c * x / 8, 0.2 * c) for c in range(2) for y in range(8) for x in range(8)], "coil int, y int, x int, re double, im double")
    return recon.Encoding(samples, SIZES, recon.stored(maps, "maps"))


def image(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(f, y, x, float(rng.normal()), float(rng.normal())) for f in range(2) for y in range(8) for x in range(8)]
    return recon.stored(spark.createDataFrame(rows, "frame int, y int, x int, re double, im double"), "image")


def test_adjoint(spark, encoding):
    x = image(spark, 1)
    ex = recon.stored(encoding.forward(x), "ex")
    y = recon.stored(ex.withColumns({"re": F.randn(3), "im": F.randn(4)}), "y")
    left = recon._dot(ex, y, ["frame", "coil", "sample"])
    right = recon._dot(x, encoding.adjoint(encoding.weighted(y)), ["frame", "y", "x"])
    assert left == pytest.approx(right, rel=1e-6)


def test_conjugate_gradient_recovers_the_image(spark, encoding):
    from dataclasses import replace

    x = image(spark, 2)
    data = encoding.weighted(encoding.forward(x))
    e = recon.Encoding(recon.stored(data, "data"), SIZES, encoding.maps, replace(recon.Options(), iterations=6))
    found, energies = recon.conjugate_gradient(e)
    assert energies[-1] < 0.05 * energies[0]
    error = recon._energy(recon._add(found, x, ["frame", "y", "x"], -1 + 0j)) / recon._energy(x)
    assert error < 0.3


def test_low_rank_slabs_match_the_local_kernel(spark):
    x = np.random.default_rng(3).normal(size=(3, 8, 9)) + 0j
    rows = [(int(c), int(i), int(j), float(x[c, i, j].real), 0.0) for c, i, j in np.ndindex(x.shape)]
    df = spark.createDataFrame(rows, "frame int, y int, x int, re double, im double")
    got = np.zeros_like(x)
    for r in blocks.low_rank_slabs(df, [], "frame", 3, {"y": 8, "x": 9}, 1.0, rounds=2, seed=5).collect():
        got[r["frame"], r["y"], r["x"]] = complex(r["re"], r["im"])
    assert np.allclose(got, blocks.low_rank(x, 1.0, rounds=2, seed=5))


@pytest.mark.parametrize("name", sorted(LOW_PASS))
def test_wavelets_invert(name):
    x = np.random.default_rng(4).normal(size=(8, 16, 12)) + 1j
    w = blocks.wavelet3d(x, 3, name, shift=(1, 2, 0))
    assert np.allclose(blocks.wavelet3d(w, 3, name, inverse=True, shift=(1, 2, 0)), x)
    assert np.allclose((np.abs(w) ** 2).sum(), (np.abs(x) ** 2).sum())


def test_fft_is_centred_and_orthonormal(spark):
    x = np.random.default_rng(5).normal(size=(6, 8)) + 0j
    want = np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(x), norm="ortho")) * (-1) ** (6 // 2 + 8 // 2)
    assert np.allclose(blocks.fft(x), want)
    assert np.allclose(blocks.fft(blocks.fft(x), inverse=True), x)


def test_walsh_maps_are_leading_vectors_of_neighbourhoods():
    rng = np.random.default_rng(6)
    images = rng.normal(size=(3, 4, 5, 6)) + 1j * rng.normal(size=(3, 4, 5, 6))
    maps = blocks.walsh_maps(images, 3)
    strongest = np.argmax((np.abs(images) ** 2).sum((1, 2, 3)))
    for index in np.ndindex(4, 5, 6):
        box = tuple(slice(lo, lo + 3) for lo in (min(max(i - 1, 0), n - 3) for i, n in zip(index, (4, 5, 6), strict=True)))
        u, s, _ = np.linalg.svd(images[(slice(None), *box)].reshape(3, -1), full_matrices=False)
        assert np.allclose(maps[(slice(None), *index)], np.sqrt(s[0]) * u[:, 0] * np.conj(u[strongest, 0]) / abs(u[strongest, 0]))


def phantom(spark, encoding):
    x = image(spark, 7)
    disc = F.when((F.col("x") - 4) ** 2 + (F.col("y") - 4) ** 2 < 9, 2.0 + F.col("frame")).otherwise(0.0)
    x = recon.stored(x.withColumns({"re": disc, "im": disc * 0.5}), "phantom")
    return x, recon.stored(encoding.weighted(encoding.forward(x)), "data")


def error(found, x):
    f = recon.coils.conj_sum(found, x, ["frame", "y", "x"]).first()
    # The best multiple is compared: direct methods do not keep the scale.
    return 1 - (f["re"] ** 2 + f["im"] ** 2) / (recon._energy(found) * recon._energy(x))


@pytest.mark.parametrize("changes", [
    {"method": "fista", "threshold": 0.01, "time_transform": "pca"}, {"method": "ist", "step": "cauchy", "low_rank": 0.01, "phase": True},
    {"method": "admm", "threshold": 0.01, "time_transform": "composite", "iterations": 1}, {"method": "pils"},
])
def test_solvers_find_a_disc(spark, encoding, changes):
    x, data = phantom(spark, encoding)
    options = recon.Options(**{"iterations": 2, "power_rounds": 2} | changes)
    found = recon.stored(recon.reconstruct(spark, data, SIZES, encoding.maps, options), "found")
    assert found.columns == ["frame", "y", "x", "re", "im"] and found.count() == 128
    assert error(found, x) < 0.4


def test_residuals_of_thresholded_iterations_fall(spark, encoding):
    _, data = phantom(spark, encoding)
    e = recon.Encoding(data, SIZES, encoding.maps, recon.Options(method="fista", iterations=3, power_rounds=2))
    energies = recon.iterative_threshold(e)[1]
    assert all(b < a for a, b in zip(energies, energies[1:], strict=False))


def test_calibrationless_combines_by_block(spark, encoding):
    _, data = phantom(spark, encoding)
    found = recon.reconstruct(spark, data, SIZES, None, recon.Options(method="clear", iterations=2, low_rank=0.05))
    assert found.agg(F.sum(F.abs("im"))).first()[0] > 0  # the phase is kept
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3, 4, 4)) + 1j * rng.normal(size=(3, 4, 4))
    rows = [(c, i, j, float(x[c, i, j].real), float(x[c, i, j].imag)) for c, i, j in np.ndindex(x.shape)]
    got = np.zeros((4, 4), complex)
    for r in blocks.combine_blocks(spark.createDataFrame(rows, "coil int, y int, x int, re double, im double"), [], "coil", 3, {"y": 4, "x": 4}, 2).collect():
        got[r["y"], r["x"]] = complex(r["re"], r["im"])
    for i, j in ((0, 0), (0, 2), (2, 0), (2, 2)):
        m = x[:, i : i + 2, j : j + 2].reshape(3, -1)
        assert np.isclose((np.abs(got[i : i + 2, j : j + 2]) ** 2).sum(), np.linalg.svd(m, compute_uv=False)[0] ** 2)


def test_block_scale_matches_the_local_kernel(spark):
    x = np.random.default_rng(9).normal(size=(3, 8, 9)) + 0j
    rows = [(int(c), int(i), int(j), float(x[c, i, j].real), 0.0) for c, i, j in np.ndindex(x.shape)]
    df = spark.createDataFrame(rows, "frame int, y int, x int, re double, im double")
    assert blocks.block_scale(df, [], "frame", 3, {"y": 8, "x": 9}, 2) == pytest.approx(blocks.low_rank_scale(x, 2))
