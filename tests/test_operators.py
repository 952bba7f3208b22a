import numpy as np
import pytest
from pyspark.sql import functions as F

from larmor.operators import coilmaps, coils, fitting, lines, voronoi
from larmor.sources import arrays, phantom, simulate


def channels(n):
    return [(f"re{c}", f"im{c}") for c in range(n)]


def test_whitening_and_compression(spark):
    rng = np.random.default_rng(0)
    mix = rng.normal(size=(4, 4)) + 1j * rng.normal(size=(4, 4))
    x = (rng.normal(size=(300, 4)) + 1j * rng.normal(size=(300, 4))) @ mix
    wide = spark.createDataFrame([tuple(map(float, (*r.real, *r.imag))) for r in x], ", ".join([f"re{c} double" for c in range(4)] + [f"im{c} double" for c in range(4)]))
    d = coils.whitening_matrix(wide, channels(4))
    y = x @ d.T
    assert np.allclose(y.T @ y.conj(), np.eye(4), atol=1e-8)
    v = coils.compression_matrix(wide, channels(4), 2)
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(np.linalg.svd(x @ v.T, compute_uv=False)[:2], s[:2])


def test_polynomial_fit(spark):
    rows = [(float(i), float(j), 2.0 + 3 * i - j + 0.5 * i * j) for i in range(6) for j in range(6)]
    df = spark.createDataFrame(rows, "kx double, ky double, v double")
    c = fitting.fit(df, ["kx", "ky"], "v", 2)
    left = fitting.subtract(df, ["kx", "ky"], "v", 2, c).agg(F.max(F.abs("v"))).first()[0]
    assert left < 1e-6


def test_line_transforms_invert(spark):
    x = np.random.default_rng(1).normal(size=(3, 16))
    df = spark.createDataFrame([(k, n, float(x[k, n])) for k in range(3) for n in range(16)], "k int, n int, x double")
    w = lines.wavelet(df, ["k"], 16, lines.LOW_PASS["db4"], shift=1)
    back = {(r["k"], r["n"]): r["x"] for r in lines.inverse_wavelet(w, ["k"], 16, lines.LOW_PASS["db4"], shift=1).collect()}
    assert all(back[k, n] == pytest.approx(x[k, n]) for k in range(3) for n in range(16))
    assert np.allclose(lines.haar_matrix(8) @ lines.haar_matrix(8).T, np.eye(8))


def test_voronoi_areas_fill_the_disc():
    rng = np.random.default_rng(2)
    grid = np.array([(x, y) for x in range(-6, 7) for y in range(-6, 7)], float)
    inner = np.linalg.norm(grid, axis=1) < 4
    assert np.allclose(voronoi.cell_volumes(grid, 8.0)[inner], 1.0)
    cube = np.array([(x, y, z) for x in range(-2, 3) for y in range(-2, 3) for z in range(-2, 3)], float)
    assert voronoi.cell_volumes(cube, 5.0)[62] == pytest.approx(1.0)
    centres, of = voronoi.merged(np.array([[0, 0], [0.005, 0.001], [1, 1], [0.02, 0]]))
    assert len(centres) == 3 and of[0] == of[1] != of[3]
    assert (voronoi.cell_volumes(rng.normal(size=(30, 2)) * 20, 1.0) >= 0).all()


def test_sphere_weights_cover_the_shell():
    k = np.arange(400) + 0.5
    z, turn = 1 - 2 * k / 400, np.pi * (1 + 5**0.5) * k
    points = np.stack([np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z], 1) * 3
    total = voronoi.sphere_weights(points).sum() / 3
    assert total == pytest.approx(4 / 3 * np.pi * (17**3 - 15**3), rel=0.1)


def test_phase_rotation_and_temporal_basis():
    from larmor.operators import blocks

    y, x = np.meshgrid(*[np.linspace(-1, 1, 16)] * 2, indexing="ij")
    phase = np.exp(1j * (0.5 * x + 0.3 * y))
    frames = np.stack([(1 + 0.1 * i) * np.ones((16, 16)) * phase for i in range(4)])
    flat = frames * blocks.phase_rotation(frames).conj()
    assert np.abs(np.angle(flat[:, 4:12, 4:12])).max() < 0.2
    basis = blocks.temporal_basis(frames)
    assert np.allclose(basis @ basis.conj().T, np.eye(4))
    turned = np.tensordot(basis, frames, 1)
    assert (np.abs(turned[0]) ** 2).sum() > 0.99 * (np.abs(frames) ** 2).sum()


def test_density_weights_by_group(spark):
    rows = [(e, i, float(x), float(y)) for e in range(2) for i, (x, y) in enumerate([(a, b) for a in range(-3, 4) for b in range(-3, 4)])]
    got = voronoi.density_weights(spark.createDataFrame(rows, "encode int, sample long, kx double, ky double"), ["encode"], ["kx", "ky"], kmax=6.0)
    middle = got.where("sample = 24").collect()
    assert len(middle) == 2 and all(r["kw"] == pytest.approx(1.0) for r in middle)


def test_eigen_maps_from_calibration():
    rng = np.random.default_rng(3)
    shape = (12, 12)
    y, x = np.meshgrid(*[np.linspace(-1, 1, 12)] * 2, indexing="ij")
    true = np.stack([np.ones(shape) + 0.2 * x, (0.6 + 0.2 * y) * np.exp(0.3j * x)])
    image = rng.normal(size=shape)
    k = np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(true * image, (1, 2))), (1, 2))
    cal = coilmaps.calibration_matrix(k, (5, 5), (3, 3))
    maps = coilmaps.eigen_maps(coilmaps.row_space(cal, 2, (3, 3), 1e-3), shape)
    assert np.allclose((np.abs(maps) ** 2).sum(0), 1)
    assert np.allclose(maps[0].imag, 0, atol=1e-9)


def test_raw_files(spark, tmp_path):
    rows = [(i, float(i) - 2, float(-i)) for i in range(24)]
    df = spark.createDataFrame(rows, "i int, re double, im double")
    path = f"file://{tmp_path}/x.dat"
    assert arrays.write_raw(df, path, ["i"], ["re", "im"], rows=5) == 24 * 8
    got = arrays.read_raw(spark, path, (24,), "<c8").orderBy("i").collect()
    assert [(r["re"], r["im"]) for r in got] == [(b, c) for _, b, c in rows]
    with pytest.raises(Exception, match="bytes"):
        arrays.read_raw(spark, path, (23,), "<c8").collect()
    assert arrays.write_magnitude(df, f"file://{tmp_path}/m.dat", ["i"]) == 24 * 4
    arrays.write_header_pair(df.withColumn("a", F.col("i") % 4).withColumn("b", F.floor(F.col("i") / 4)), f"file://{tmp_path}/pair", {"a": 4, "b": 7})
    assert (tmp_path / "pair.hdr").read_text() == "# Dimensions\n4 7 1 1 1\n"
    flat = np.fromfile(tmp_path / "pair.cfl", "<c8")
    assert len(flat) == 28 and flat[5] == 3 - 5j and flat[27] == 0
    swapped = spark.range(1).select(arrays.endian_swap(F.lit(0x01020304)).alias("x")).first()["x"]
    assert swapped == 0x04030201


def test_acquisition_round_trip(spark, tmp_path):
    k = simulate.golden_radial(spark, 4, 8).withColumn("encode", (F.col("shot") % 2).cast("int"))
    arrays.write_acquisition({"kspace": k}, f"{tmp_path}/acq")
    assert arrays.read_acquisition(spark, f"{tmp_path}/acq", ("kspace",))["kspace"].count() == 32
    with pytest.raises(ValueError, match="unknown table"):
        arrays.write_acquisition({"other": k}, f"{tmp_path}/acq")


def test_phantom(spark):
    rng = np.random.default_rng(4)
    segments = phantom.grow_tree(rng.uniform(-0.8, 0.8, (12, 3)), np.array([0.0, 0.0, -1.0]))
    assert len(segments) == 23 and segments[0]["q"] == 12
    tree = phantom.tree_table(spark, segments)
    times = phantom.arrival_times(tree)
    assert times.count() == 23 and times.agg(F.min("time")).first()[0] == 0
    assert phantom.rasterise(tree, times, 8).count() > 10
    field = phantom.biot_savart(spark, simulate.voxels(spark, 4), 4, 2)
    assert field.count() == 128 and field.where("isnan(re) or isnan(im)").count() == 0


def test_trajectories_and_noise(spark):
    k = simulate.radial_trajectory(spark, 20, 9)
    assert k.count() == 180 and k.where("abs(sqrt(kx*kx+ky*ky+kz*kz) - 0.5*pos) > 1e-9").count() == 0
    assert simulate.shells(spark, 8).agg(F.max("value")).first()[0] == 1.0
    n = simulate.add_noise(spark.range(4000).withColumns({"re": F.lit(0.0), "im": F.lit(0.0)}), 2.0)
    assert n.agg(F.var_samp("re") + F.var_samp("im")).first()[0] == pytest.approx(4.0, rel=0.1)


def test_streaming_frames(spark, tmp_path, sf_dir):
    from larmor.streaming import frames

    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    out = frames.tumbling(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "ts", "1 day", "value")
    query = out.writeStream.format("memory").queryName("frames").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination(120)
    assert spark.table("frames").agg(F.sum("n")).first()[0] == 1000
