import numpy as np
import pytest
from pyspark.sql import functions as F

from larmor.operators import regularise
from larmor.plans import recon, setup
from larmor.sources import arrays, exports, simulate

AXES = {"y": 8, "x": 8}


def coil_images(spark, many=3):
    rng = np.random.default_rng(0)
    disc = lambda y, x: float((y - 4) ** 2 + (x - 4) ** 2 < 12)
    rows = [(c, y, x, disc(y, x) * (1 + 0.1 * c * x) + 0.001 * rng.normal(), disc(y, x) * 0.2 * c) for c in range(many) for y in range(8) for x in range(8)]
    return recon.stored(spark.createDataFrame(rows, "coil int, y int, x int, re double, im double"), "coils")


@pytest.mark.parametrize("changes", [{"maps": "lowres", "blur": 1.0, "mask": 0.2}, {"maps": "walsh", "correct": True}, {"maps": "kernel", "calibration": setup.Calibration(3, 3)}, {"maps": "lowres", "reject_radius": 0.4, "reject_below": 0.1}])
def test_maps_have_unit_norm_where_there_is_signal(spark, changes):
    maps = setup.coil_maps(coil_images(spark), AXES, 3, setup.Setup(**changes))
    norm = {(r["y"], r["x"]): r["n"] for r in maps.groupBy("y", "x").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("n")).collect()}
    assert norm[4, 4] == pytest.approx(1) and len(norm) == 64
    if "mask" in changes:
        assert norm[0, 0] == 0


def test_map_dispatch(spark):
    images = coil_images(spark)
    assert setup.coil_maps(images, AXES, 3, setup.Setup(maps="none")) is None
    assert setup.coil_maps(images, AXES, 3, setup.Setup(maps="ones")).agg(F.sum("re")).first()[0] == 3 * 64
    with pytest.raises(ValueError):
        setup.coil_maps(images, AXES, 3, setup.Setup(maps="other"))


def test_chain_from_acquisition_to_image(spark):
    rng = np.random.default_rng(1)
    points = rng.uniform(-3.5, 3.5, (40, 2))
    rows = [(c, 0, i % 4, i, float(ky), float(kx), 1.0, 1.0 + 0.2 * c, 0.1 * c) for c in range(3) for i, (ky, kx) in enumerate(points)]
    samples = spark.createDataFrame(rows, "coil int, encode int, shot int, sample int, ky double, kx double, kw double, re double, im double")
    noise = spark.createDataFrame([tuple(float(v) for v in rng.normal(size=6)) for _ in range(50)], "re0 double, im0 double, re1 double, im1 double, re2 double, im2 double")
    shots = spark.createDataFrame([(s, float(s), float(s % 2)) for s in range(4)], "shot int, time double, resp double")
    s = setup.Setup(whiten=True, virtual_coils=2, density="iterate", density_rounds=2, maps="lowres", gate="time", frames=2)
    e = setup.prepare(spark, samples, AXES, s, recon.Options(method="pils"), noise, shots)
    assert {tuple(r) for r in e.samples.select("frame", "coil").distinct().collect()} == {(f, c) for f in range(2) for c in range(2)}
    image = e.adjoint(e.samples)
    assert image.count() == 128 and image.agg(F.max(F.hypot("re", "im"))).first()[0] > 0
    assert e.samples.where("kw < 0").count() == 0


@pytest.mark.parametrize("kind", ["dft", "diff", "wavelet", "pca", "composite"])
def test_frame_transforms_invert(spark, kind):
    rng = np.random.default_rng(2)
    rows = [(f, y, x, float(rng.normal()), float(rng.normal())) for f in range(4) for y in range(2) for x in range(2)]
    df = spark.createDataFrame(rows, "frame int, y int, x int, re double, im double")
    composite = df.groupBy("y", "x").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    basis = regularise.principal_frames(df, {"y": 2, "x": 2}, "frame", 4) if kind == "pca" else None
    there = regularise.along(df, ["y", "x"], "frame", 4, kind, composite=composite, basis=basis)
    back = regularise.along(there, ["y", "x"], "frame", 4, kind, True, composite, basis)
    got = {(r["frame"], r["y"], r["x"]): (r["re"], r["im"]) for r in back.collect()}
    assert all(got[r[:3]] == pytest.approx(r[3:]) for r in rows)


def test_high_part_leaves_a_constant_alone(spark):
    df = spark.range(64).select(F.lit(0).alias("frame"), F.floor(F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    r = regularise.regularise(df, df, ["frame"], AXES, "lowres", 0.5).where("y = 4 and x = 4").first()
    assert 0.9 < r["re"] < 1.1


def test_dense_sink_and_three_pairs(spark, tmp_path):
    rows = [(z, y, x, float(100 * z + 10 * y + x), 1.0) for z in range(2) for y in range(3) for x in range(5) if (z, y, x) != (1, 1, 1)]
    df = spark.createDataFrame(rows, "z int, y int, x int, re double, im double")
    exports.write_dense(df, str(tmp_path), "Images", "SOS", {"z": 2, "y": 3, "x": 5}, rows=7)
    got = {(r["z"], r["y"], r["x"]): (r["re"], r["im"]) for r in exports.read_field_of_view(spark, str(tmp_path)).collect()}
    assert len(got) == 30 and got[1, 1, 1] == (0.0, 0.0) and all(got[r[:3]] == r[3:] for r in rows)
    shot = [(0, 0, s, p, float(p), 0.5, 0.0, 1.0, float(s), -1.0) for s in range(2) for p in range(3) if (s, p) != (1, 2)]
    samples = spark.createDataFrame(shot, "frame int, coil int, shot int, pos int, kx double, ky double, kz double, kw double, re double, im double")
    exports.write_three_pairs(samples, f"{tmp_path}/a", {"pos": 3, "shot": 2, "coil": 1, "frame": 1})
    traj = np.fromfile(f"{tmp_path}/a_traj.cfl", "<c8").reshape(2, 3, 3)
    assert traj[0, 2, 0] == 2 and traj[0, 1, 1] == 0.5 and (traj[1, 2] == 0).all()
    assert open(f"{tmp_path}/a_traj.hdr").read().split("\n")[1].split()[:4] == ["3", "3", "2", "1"]
    assert np.fromfile(f"{tmp_path}/a_data.cfl", "<c8").size == 6 == np.fromfile(f"{tmp_path}/a_dcf.cfl", "<c8").size


def test_image_sinks_and_per_frame_files(spark, tmp_path):
    df = spark.createDataFrame([(f, 0, z, 0, 0, 3.0, 4.0 + f) for f in range(2) for z in range(3)], "frame int, coil int, z int, y int, x int, re double, im double")
    exports.write_images(df, f"{tmp_path}/i")
    assert spark.read.parquet(f"{tmp_path}/i/Images").where("frame = 0").first()["magnitude"] == 5.0
    for i in range(2):
        exports.append_debug_slice(df, f"{tmp_path}/d", 3, i)
    assert spark.read.parquet(f"{tmp_path}/d").count() == 4
    exports.write_coil_maps(df, f"{tmp_path}/m", ["frame", "z", "y", "x"], debug=True)
    assert spark.read.parquet(f"{tmp_path}/m/DebugSenseMaps").count() == 6
    exports.write_gating_traces(df, f"{tmp_path}/t", ["re", "im"], ["frame", "z"])
    assert spark.read.parquet(f"{tmp_path}/t/im").count() == 6
    for f in range(2):
        arrays.write_raw(df.where(F.col("frame") == f), f"{tmp_path}/f{f}.dat", ["z"], ["re", "im"])
    back = exports.read_frames(spark, [f"{tmp_path}/f{f}.dat" for f in range(2)], {"x": 1, "y": 1, "z": 3})
    assert sorted(map(tuple, back.select("frame", "z", "re", "im").collect())) == sorted(map(tuple, df.select("frame", "z", "re", "im").collect()))


def test_truth_course_and_relative_noise(spark):
    segments = spark.createDataFrame([(1, 0.5, 2.0)], "seg long, arrival double, density double")
    got = {r["frame"]: r["signal"] for r in simulate.truth_course(segments, 6, ["seg"]).collect()}
    bolus = lambda t, b: t**2 * np.exp(-t / b) / (2 * b**2)
    assert got[0] == got[1] == 0
    assert got[4] == pytest.approx(2 * (bolus(1.5, 0.5) + 0.25 * bolus(1.5, 2.0)))
    flat = spark.range(20000).select(F.lit(3.0).alias("re"), F.lit(4.0).alias("im"))
    assert simulate.relative_noise(flat, 0.1).agg(F.stddev("re")).first()[0] == pytest.approx(0.5 / np.sqrt(2), rel=0.05)
