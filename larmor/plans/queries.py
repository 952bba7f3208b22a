"""Registered queries: each applies operators to the driver tables."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larmor.functions import cplx, kernels
from larmor.functions.cplx import settled
from larmor.operators import blocks, coils, fitting, gating, lines, regularise, shape, stencil, thresholds
from larmor.plans import recon
from larmor.sources import standins as src

Query = Callable[[SparkSession, str], DataFrame]
ORDER = ["t", "event_id"]
EXTRA: dict[str, Query] = {}
_Q: dict[str, Query] = {}


def query(f: Query) -> Query:
    _Q[f.__name__] = f
    return f


def _r(name: str, digits: int):
    return settled(F.col(name), digits).alias(name)


# Gating ------------------------------------------------------------------------------------------


def _framed(spark, sf, frames=10):
    return gating.frame_none(gating.scaled_frame(src.signals(spark, sf), "t", frames), frames)


@query
def gate_time_frames(spark, sf):
    return _framed(spark, sf).groupBy("frame").agg(F.count(F.lit(1)).alias("n"), settled(F.sum(F.col("v") * F.col("v")), 4).alias("energy"))


@query
def gate_hist_frames(spark, sf):
    return gating.frame_hist(src.signals(spark, sf), 10, ["v", "event_id"]).select("event_id", "frame")


@query
def gate_resp_quantile(spark, sf):
    s = src.signals(spark, sf)
    low, high = gating.respiratory_range(s, "v", 8)
    return gating.frame_none(gating.scaled_frame(s, "v", 8, low, high), 8).select("event_id", "frame")


@query
def gate_retro_rr(spark, sf):
    return gating.retrospective_period(src.beats(spark, sf), "gap").select(_r("rr", 4), _r("rr_clipped", 4))


@query
def resp_thresh(spark, sf):
    return gating.resp_threshold(src.signals(spark, sf), "v", ORDER, 7, 0.5).select("event_id", "weight")


def _phase(direction):
    return lambda spark, sf: gating.resp_phase(src.signals(spark, sf), "v", ORDER, 7, 0.25, 0.75, direction, 2).select("event_id", "weight")


_Q |= {"resp_phase_both": _phase(0), "resp_phase_rise": _phase(1), "resp_phase_fall": _phase(2)}


@query
def resp_hard(spark, sf):
    return gating.resp_hard(src.signals(spark, sf), "v", ["v", "event_id"], 0.4).select("event_id", "weight")


@query
def resp_soft(spark, sf):
    return gating.resp_soft(src.signals(spark, sf), "v", ["v", "event_id"], 0.4).select("event_id", _r("weight", 6))


@query
def resp_drift(spark, sf):
    return gating.resp_drift(src.signals(spark, sf), "v", ORDER, 7).select("event_id", _r("corrected", 6))


@query
def dc_moving_average(spark, sf):
    return gating.moving_average(src.signals(spark, sf), "v", ORDER, 7).select("event_id", _r("average", 6))


@query
def tornado_view_share(spark, sf):
    s = gating.scaled_frame(src.signals(spark, sf).withColumn("kr", F.col("user_id").cast("double")), "t", 10)
    return gating.tornado(s, 10, "kr", iterative=False).groupBy("frame").agg(F.count(F.lit(1)).alias("n"), settled(F.sum("share"), 4).alias("share"))


@query
def slice_reset_time(spark, sf):
    return gating.slice_reset(src.signals(spark, sf), "t", ORDER, 50).select("event_id", F.col("block").cast("long").alias("block"), "since")


@query
def pregate(spark, sf):
    s = gating.resp_threshold(_framed(spark, sf), "v", ORDER, 7, 0.5).withColumn("kw", F.lit(1.0) + F.col("user_id") / 100.0)
    return gating.pregate(s, "weight").groupBy("frame").agg(F.count(F.lit(1)).alias("points"), settled(F.sum("kw"), 3).alias("kw"))


@query
def weight_combined(spark, sf):
    s = gating.resp_threshold(_framed(spark, sf), "v", ORDER, 7, 0.5).withColumn("own", F.when(F.col("frame") % 2 == 0, 1.0).otherwise(0.5))
    return s.groupBy("frame").agg(settled(F.sum(gating.combine_weights(s, ["weight"], "own") * F.col("v")), 4).alias("signal"))


@query
def temporal_resolution(spark, sf):
    return gating.temporal_resolution(src.signals(spark, sf), "t", 10).select(_r("resolution", 3))


@query
def projection_range(spark, sf):
    s = gating.frame_hist(src.signals(spark, sf), 1, ORDER)
    return s.where((F.col("i") >= 100) & (F.col("i") < 400)).select("event_id", "i")


@query
def frame_counts_by_signal(spark, sf):
    s = gating.frame_hist(src.signals(spark, sf), 6, ["t", "event_id"], by=["event_type"])
    return s.groupBy("event_type", "frame").agg(F.count(F.lit(1)).alias("n"))


# Shape -------------------------------------------------------------------------------------------


@query
def range_stats(spark, sf):
    return shape.range_stats(src.signals(spark, sf), ["v", "t"], ["event_type"])


def _encodes(spark, sf):
    types = src.load(spark, sf, "events").select("event_type").distinct()
    named = types.withColumn("encode", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("int"))
    return src.signals(spark, sf).join(F.broadcast(named), "event_type")  # five event types


@query
def encode_subframe(spark, sf):
    return shape.subframe(_encodes(spark, sf), 0, 4, 2).groupBy("encode", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def skip_encodes(spark, sf):
    return shape.skip_encodes(_encodes(spark, sf), [1, 3]).groupBy("encode").agg(F.count(F.lit(1)).alias("n"))


@query
def encodes_to_coils(spark, sf):
    e = _encodes(spark, sf).withColumn("coil", (F.col("user_id") % 4).cast("int"))
    return shape.encodes_to_coils(e, 4).groupBy("encode", "coil").agg(F.count(F.lit(1)).alias("n"))


@query
def complex_difference(spark, sf):
    e = _encodes(spark, sf).withColumn("day", F.floor(F.col("t") / 86400e6).cast("long"))
    daily = e.groupBy("day", "encode").agg(F.sum("v").alias("re"), F.sum(F.col("v") * F.col("v")).alias("im"))
    return shape.complex_difference(daily, ["day"], ["re", "im"]).select("day", "encode", _r("re", 4), _r("im", 4))


@query
def demodulate(spark, sf):
    s = src.samples(spark, sf).withColumn("re", F.col("re").cast("double")).withColumn("im", F.lit(0.0))
    return shape.demodulate(s, 0.013).groupBy("l_returnflag").agg(settled(F.sum("re"), 1).alias("re"), settled(F.sum("im"), 1).alias("im"))


@query
def mod_time(spark, sf):
    return shape.mod_time(src.signals(spark, sf).withColumn("time", F.col("t") / 1e6), 3600.0).select("event_id", _r("time", 4))


@query
def scale_fov(spark, sf):
    s = src.samples(spark, sf).withColumns({"fovx": F.lit(1.0), "fovy": F.lit(1.0)})
    s = shape.scale_fov(s, {"kx": -2.0, "ky": 0.5}, {"kx": "fovx", "ky": "fovy"})
    return s.groupBy("l_returnflag").agg(settled(F.sum("kx"), 2).alias("kx"), settled(F.sum("ky"), 2).alias("ky"), F.max("fovx").alias("fovx"), F.max("fovy").alias("fovy"))


@query
def complex_parts(spark, sf):
    c = src.coil_samples(spark, sf)
    p = cplx.pair("re", "im")
    return c.select("vec_id", "coil", settled(cplx.magnitude(p), 6).alias("magnitude"), settled(cplx.phase(p), 6).alias("phase"), settled(cplx.norm2(p), 6).alias("norm"))


@query
def psf_source(spark, sf):
    return src.coil_samples(spark, sf).withColumns({"re": F.lit(1.0), "im": F.lit(0.0)}).groupBy("coil").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


@query
def add_phase(spark, sf):
    p = cplx.rotate((F.col("x"), F.lit(0.0)), F.lit(math.pi / 64) * F.col("n"))
    return src.lines(spark, sf).withColumns({"re": p[0], "im": p[1]}).groupBy("n").agg(settled(F.sum("re"), 5).alias("re"), settled(F.sum("im"), 5).alias("im"))


@query
def checkerboard(spark, sf):
    return src.lines(spark, sf).select("vec_id", "n", settled(F.col("x") * shape.checkerboard("n", "vec_id"), 6).alias("x"))


@query
def flip(spark, sf):
    return shape.flip(src.lines(spark, sf), "n", 64).select("vec_id", "n", _r("x", 6))


@query
def unravel(spark, sf):
    a, b, c = shape.unravel(F.col("event_id"), [7, 11, 1 << 20])
    return src.signals(spark, sf).select("event_id", a.alias("a"), b.alias("b"), c.alias("c"))


@query
def circle_mask(spark, sf):
    x, y = (F.col("n") % 8 - 3.5) / 4.0, (F.floor(F.col("n") / 8) - 3.5) / 4.0
    masked = src.lines(spark, sf).withColumn("kept", shape.circle_mask([x, y], F.lit(1.0)))
    return masked.groupBy("vec_id").agg(F.sum("kept").cast("long").alias("inside"))


@query
def hole_fill_mask(spark, sf):
    return shape.hole_fill(src.lines(spark, sf), ["vec_id"], "n", F.col("x") > 0.15).groupBy("vec_id").agg(F.sum("mask").cast("long").alias("filled"))


@query
def coil_rejection(spark, sf):
    inside = (F.col("n") >= 16) & (F.col("n") < 48)
    return shape.coil_rejection(src.lines(spark, sf), "label", inside, F.col("x"), 0.5).select("label", _r("fraction", 6), "keep")


@query
def fov_box(spark, sf):
    l = src.lines(spark, sf).withColumn("y", (F.col("vec_id") % 64).cast("int"))  # noqa: E741
    return shape.fov_box(l, {"n": 64, "y": 64}, F.abs("x"), 0.9)


@query
def fov_sphere(spark, sf):
    l = src.lines(spark, sf).withColumn("y", (F.col("vec_id") % 64).cast("int"))  # noqa: E741
    return shape.fov_box(l, {"n": 64, "y": 64}, F.abs("x"), 0.5, within="sphere")


@query
def coil_rejection_disc(spark, sf):
    l = src.lines(spark, sf).withColumns({"y": F.floor(F.col("n") / 8).cast("int"), "z": (F.col("n") % 8).cast("int")})  # noqa: E741
    inside = shape.rejection_shape({"y": 8, "z": 8}, 0.3)
    return shape.coil_rejection(l, "label", inside, F.col("x"), 0.3).select("label", _r("fraction", 6), "keep")


@query
def shot_signal(spark, sf):
    orders = src.load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", "o_orderpriority")
    met = shape.with_shot_signal(src.samples(spark, sf), orders, ["l_orderkey"], ["o_totalprice", "o_orderpriority"])
    return met.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), settled(F.sum(F.col("kw") * F.col("o_totalprice")), 0).alias("signal"))

@query
def crop_pad(spark, sf):
    cut = shape.crop(src.lines(spark, sf), {"n": (16, 48)})
    padded = shape.zero_pad(cut.select("vec_id", "n", "x"), ["vec_id"], "n", 8, 48, ["x"])
    return padded.select("vec_id", "n", _r("x", 6))


@query
def k_radius(spark, sf):
    return shape.k_radius_filter(src.samples(spark, sf), 12.0, ("kx", "ky")).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), settled(F.sum("re"), 1).alias("re"))


@query
def zero_weight_skip(spark, sf):
    return src.samples(spark, sf).where("kw <> 0").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), settled(F.sum(F.col("re") * F.col("kw")), 1).alias("weighted"))


@query
def intensity_bias(spark, sf):
    l = src.lines(spark, sf).select("vec_id", "n", "x")  # noqa: E741
    bias = l.groupBy("n").agg(F.avg(F.abs("x")).alias("bias"))
    return shape.intensity_bias(l, bias, ["n"], ["x"], correct=False).select("vec_id", "n", _r("x", 5))


@query
def composite_difference(spark, sf):
    l = src.lines(spark, sf).select("vec_id", "n", "x")  # noqa: E741
    return shape.subtract_composite(l, l.groupBy("n").agg(F.avg("x").alias("x")), ["n"], ["x"]).select("vec_id", "n", _r("x", 6))


@query
def normalise_to_max(spark, sf):
    return shape.normalise_to_max(src.coil_samples(spark, sf)).select("vec_id", "coil", _r("re", 6), _r("im", 6))


@query
def reset_density(spark, sf):
    s = shape.reset_density(src.samples(spark, sf).withColumn("kw", F.col("kw") * 3), "fista")
    return s.groupBy("l_returnflag").agg(settled(F.sum("kw"), 3).alias("kw"))


# Gridding ----------------------------------------------------------------------------------------

AXES = [stencil.Axis("kx", 64), stencil.Axis("ky", 16)]


def _scatter(kind):
    def run(spark, sf):
        grid = stencil.scatter(src.samples(spark, sf).withColumn("kx", F.col("kx") + 0.25), AXES, ["re"], "kw", kind=kind)
        return grid.select("ckx", "cky", _r("re", 1))

    return run


_Q |= {"grid_scatter_tri": _scatter("triangle"), "grid_scatter_poly": _scatter("polynomial"), "grid_scatter_poly_2": _scatter("polynomial_2"), "grid_scatter_kb": _scatter("kaiser_bessel")}
KEYS = ["l_orderkey", "l_linenumber"]


@query
def degrid_gather(spark, sf):
    s = src.samples(spark, sf).withColumn("kx", F.col("kx") + 0.25)
    grid = stencil.scatter(s, AXES, ["re"], "kw")
    return stencil.gather(s, grid, AXES, ["re"], KEYS).select(*KEYS, _r("re", 1))


@query
def dcf_step(spark, sf):
    s = src.samples(spark, sf).withColumn("kx", F.col("kx") + 0.25).withColumn("w", F.lit(1.0))
    return stencil.density_step(s.select(*KEYS, "kx", "ky", "w"), AXES, KEYS, store=lambda df: recon.stored(df, "density")).select(*KEYS, settled(F.col("w"), 8).alias("w"))


@query
def dcf_loop(spark, sf):
    s = src.samples(spark, sf).select(*KEYS, (F.col("kx") + 0.25).alias("kx"), "ky")
    store = lambda df: recon.stored(df, "density")
    return stencil.density_weights(s, AXES, KEYS, store, 2, acceleration=3.0, drop=recon.dropped).select(*KEYS, settled(F.col("w") * 1e6, 3).alias("w"))


@query
def kspace_residual(spark, sf):
    s = src.samples(spark, sf).withColumns({"kx": F.col("kx") + 0.25, "im": F.col("re") * 0.5})
    found = stencil.residual(s, AXES, ("re", "im"), "kw", KEYS, ["l_returnflag"])
    return found.select("l_returnflag", settled(F.col("residual") / 1e9, 2).alias("residual"))


@query
def low_pass_grid(spark, sf):
    axes = [stencil.Axis("kx", 64, transformed=True), stencil.Axis("ky", 16, cartesian=True, transformed=True)]
    return stencil.scatter(src.samples(spark, sf), axes, ["re"], "kw", low_pass=10.0).select("ckx", "cky", _r("re", 1))


@query
def bessel_i0(spark, sf):
    return src.signals(spark, sf).select("event_id", settled(kernels.bessel_i0(F.col("v") / 100.0), 6).alias("i0"))


# Coils -------------------------------------------------------------------------------------------

CHANNELS = [(f"re{c}", f"im{c}") for c in range(src.COILS)]
MATRIX = np.array([[math.cos(0.3 * i * j) + 1j * math.sin(0.2 * (i + j)) for j in range(8)] for i in range(8)])


@query
def coil_gramian(spark, sf):
    return coils.gramian(src.coil_rows(spark, sf), CHANNELS).select("i", "j", _r("re", 5), _r("im", 5))


@query
def coil_covariance(spark, sf):
    return coils.gramian(src.coil_rows(spark, sf), CHANNELS, centred=True).select("i", "j", _r("re", 7), _r("im", 7))


@query
def coil_sos(spark, sf):
    return coils.root_sum_squares(src.coil_samples(spark, sf), ["vec_id"]).select("vec_id", _r("sos", 6))


@query
def coil_normalise(spark, sf):
    return coils.sos_normalise(src.coil_samples(spark, sf), ["vec_id"]).select("vec_id", "coil", _r("re", 6), _r("im", 6))


@query
def coil_argmax(spark, sf):
    return coils.strongest(src.coil_samples(spark, sf)).select("coil", _r("energy", 4))


@query
def coil_combine(spark, sf):
    c = src.coil_samples(spark, sf).select("vec_id", "coil", "re", "im")
    return coils.combine(c, coils.sos_normalise(c, ["vec_id"]), ["vec_id"]).select("vec_id", _r("re", 6), _r("im", 6))


@query
def coil_phase_reference(spark, sf):
    return coils.phase_reference(src.coil_samples(spark, sf), ["vec_id"]).select("vec_id", "coil", _r("re", 6), _r("im", 6))


@query
def array_energy(spark, sf):
    return coils.energy(src.coil_samples(spark, sf), ["label"]).select("label", _r("energy", 4))


@query
def conj_sum(spark, sf):
    c = src.coil_samples(spark, sf).select("vec_id", "coil", "re", "im")
    other = c.withColumn("coil", (F.col("coil") + 1) % 8)
    return coils.conj_sum(c, other, ["vec_id", "coil"]).select(_r("re", 5), _r("im", 5))


@query
def apply_matrix(spark, sf):
    c = src.coil_samples(spark, sf).select("vec_id", "coil", "re", "im")
    return coils.apply_matrix(c, coils.matrix_table(spark, MATRIX), ["vec_id"], "coil").select("vec_id", "coil", _r("re", 6), _r("im", 6))


# Lines -------------------------------------------------------------------------------------------


def _complex_lines(spark, sf):
    return src.lines(spark, sf).select("vec_id", "n", F.col("x").alias("re"), F.lit(0.0).alias("im"))


@query
def dft_line(spark, sf):
    return lines.dft(_complex_lines(spark, sf), ["vec_id"], 64).select("vec_id", "k", _r("re", 5), _r("im", 5))


@query
def idft_line(spark, sf):
    return lines.dft(_complex_lines(spark, sf), ["vec_id"], 64, inverse=True).select("vec_id", "k", _r("re", 5), _r("im", 5))


def _real_lines(spark, sf):
    return src.lines(spark, sf).select("vec_id", "n", "x")


def _wave(name, inverse=False):
    f = lines.inverse_wavelet if inverse else lines.wavelet
    return lambda spark, sf: f(_real_lines(spark, sf), ["vec_id"], 64, lines.LOW_PASS[name]).select("vec_id", "n", _r("x", 6))


_Q |= {"haar_forward": _wave("db2"), "haar_inverse": _wave("db2", True), "db4_forward": _wave("db4"), "db4_inverse": _wave("db4", True)}


@query
def subband_energy(spark, sf):
    l = _real_lines(spark, sf).withColumn("band", lines.subband("n", 64, 3))  # noqa: E741
    return l.groupBy("band").agg(settled(F.sum(F.col("x") * F.col("x")), 4).alias("energy"), F.count(F.lit(1)).alias("n"))


@query
def diff_transform(spark, sf):
    return lines.difference(_real_lines(spark, sf), ["vec_id"]).select("vec_id", "n", _r("x", 6))


def _frames_matrix(matrix):
    def run(spark, sf):
        l = src.lines(spark, sf).select("vec_id", F.col("n").alias("frame"), F.col("x").alias("re"), F.lit(0.0).alias("im"))  # noqa: E741
        return coils.apply_matrix(l, coils.matrix_table(spark, matrix), ["vec_id"], "frame").select("vec_id", "frame", _r("re", 6))

    return run


_Q |= {"time_difference_matrix": _frames_matrix(lines.difference_matrix(64)), "time_wavelet_matrix": _frames_matrix(lines.haar_matrix(64))}
_Q |= {"inverse_time_difference": _frames_matrix(np.linalg.inv(lines.difference_matrix(64))), "inverse_time_wavelet": _frames_matrix(lines.haar_matrix(64).T)}


@query
def gaussian_line(spark, sf):
    return lines.gaussian(_real_lines(spark, sf), ["vec_id"], 64, 1.0, 5).select("vec_id", "n", _r("x", 6))


@query
def gaussian_unnorm(spark, sf):
    return lines.gaussian(_real_lines(spark, sf), ["vec_id"], 64, 2.0, 6, normalised=False).select("vec_id", "n", _r("x", 6))


@query
def laplacian_periodic(spark, sf):
    return lines.laplacian(_real_lines(spark, sf), ["vec_id"], 64).select("vec_id", "n", _r("x", 6))


@query
def block_sums(spark, sf):
    l = src.lines(spark, sf).withColumn("block", F.floor(F.col("n") / 8).cast("int"))  # noqa: E741
    return l.groupBy("label", "block").agg(settled(F.sum("x"), 4).alias("x"))


# Thresholds --------------------------------------------------------------------------------------


@query
def soft_threshold(spark, sf):
    return _real_lines(spark, sf).select("vec_id", "n", settled(thresholds.soft(F.col("x"), 0.1), 6).alias("x"))


@query
def hard_threshold(spark, sf):
    return _real_lines(spark, sf).select("vec_id", "n", settled(thresholds.hard(F.col("x"), 0.1), 6).alias("x"))


@query
def soft_threshold_grouped(spark, sf):
    re, im = thresholds.soft_complex(F.col("re"), F.col("im"), 0.1)
    return src.coil_samples(spark, sf).select("vec_id", "coil", settled(re, 6).alias("re"), settled(im, 6).alias("im"))


@query
def soft_threshold_split(spark, sf):
    re, im = thresholds.soft_split(F.col("re"), F.col("im"), 0.1, 2.0)
    return src.coil_samples(spark, sf).select("vec_id", "coil", settled(re, 6).alias("re"), settled(im, 6).alias("im"))


@query
def threshold_fraction(spark, sf):
    return thresholds.fraction(_real_lines(spark, sf), F.abs("x"), 0.3).select(_r("threshold", 6))


def _banded(spark, sf):
    return _real_lines(spark, sf).withColumn("band", lines.subband("n", 64, 3))


@query
def noise_mad(spark, sf):
    return thresholds.robust_noise(_banded(spark, sf), F.abs("x"), ["band"]).select("band", _r("noise", 6))


@query
def visu_threshold(spark, sf):
    per = _banded(spark, sf).groupBy("band").agg((F.percentile(F.abs("x"), F.lit(0.5)) / 0.6745).alias("noise"), F.count(F.lit(1)).alias("n"))
    return per.select("band", settled(thresholds.visu(F.col("noise"), F.col("n")), 6).alias("threshold"))


@query
def bayes_threshold(spark, sf):
    return thresholds.bayes(_banded(spark, sf), "x", 0.02, ["band"]).select("band", _r("threshold", 6))


@query
def sure_threshold(spark, sf):
    return thresholds.sure(_banded(spark, sf), "x", 0.08, ["band"]).select("band", _r("threshold", 6))


def _multiband(method, **more):
    return lambda spark, sf: thresholds.multiband(_banded(spark, sf), "x", ["band"], method, **more).select("vec_id", "n", _r("x", 6))


_Q |= {"multiband_bayes": _multiband("bayes", noise=0.02), "multiband_fraction": _multiband("fraction", value=0.3, cycle_spins=2), "multiband_sure": _multiband("sure", noise=0.08)}


# Regularisation ----------------------------------------------------------------------------------

VOLUME = {"z": 8, "y": 8, "x": 8}


def _volumes(spark, sf):
    """Embeddings as volumes of eight lines folded in eight rows."""
    n = F.col("n")
    return src.lines(spark, sf).select(F.floor(F.col("vec_id") / 8).cast("long").alias("volume"), (F.col("vec_id") % 8).cast("int").alias("z"), F.floor(n / 8).cast("int").alias("y"), (n % 8).cast("int").alias("x"), F.col("x").alias("re"), (F.col("x") * n / 64.0).alias("im"))


def _gradient(kind):
    return lambda spark, sf: regularise.gradient(_volumes(spark, sf), ["volume"], VOLUME, kind).select("volume", *VOLUME, _r("re", 6), _r("im", 6))


_Q |= {"l2_gradient_tv": _gradient("tv"), "l2_gradient_phase": _gradient("phase")}


@query
def l2_scale(spark, sf):
    v = _volumes(spark, sf)
    rows = [(kind, per, regularise.scale(v, ["volume"], VOLUME, kind, 0.1, 2.0, per)) for kind in ("none", "tv", "phase") for per in (False, True)]
    return spark.createDataFrame(rows, "kind string, per_volume boolean, scale double").select("kind", "per_volume", settled(F.col("scale") * 1e6, 4).alias("scale"))


@query
def normalised_blur(spark, sf):
    return regularise.normalised_blur(_real_lines(spark, sf), ["vec_id"], {"n": 64}, {"n": 2.0}).select("vec_id", "n", _r("x", 5))


# Fitting, iterations, simulation -----------------------------------------------------------------


@query
def poly_moments(spark, sf):
    s = src.samples(spark, sf).withColumn("kw", F.col("kw") * 100)
    m = fitting.moments(s.select("kx", "ky", F.col("kw").alias("kz"), "re"), ["kx", "ky", "kz"], "re", 1)
    return m.select("i", "j", settled(F.col("value"), 0).alias("value"))


@query
def fista_momentum(spark, sf):
    l = src.lines(spark, sf).withColumn("old", F.col("x") * 0.5)  # noqa: E741
    return l.select("vec_id", "n", settled(fitting.momentum(F.col("x"), F.col("old"), 5), 6).alias("x"))


@query
def ellipsoid_phantom(spark, sf):
    from larmor.sources import simulate

    return simulate.ellipsoid(spark, 32).groupBy("density").agg(F.count(F.lit(1)).alias("n"))


@query
def bolus_curve(spark, sf):
    from larmor.sources import simulate

    segments = src.signals(spark, sf).select((F.col("event_id") % 7 / 10.0).alias("arrival"), F.col("v").alias("density"))
    return simulate.bolus_frames(segments, 6).select("frame", _r("signal", 4))


def _frames(spark, sf):
    """Embeddings as stacks of eight frames: ``stack, frame, n, re, im``."""
    l = src.lines(spark, sf)  # noqa: E741
    return l.select(F.floor(F.col("vec_id") / 8).cast("long").alias("stack"), (F.col("vec_id") % 8).cast("int").alias("frame"), "n", F.col("x").alias("re"), F.lit(0.0).alias("im"))


def svd_block_threshold(spark, sf):
    found = blocks.low_rank_slabs(_frames(spark, sf), ["stack"], "frame", 8, {"n": 64}, 0.4, block=8, rounds=2)
    return found.select("stack", "frame", "n", _r("re", 5))


def fft_blocks(spark, sf):
    found = blocks.fft_blocks(_frames(spark, sf), ["stack"], {"frame": 8, "n": 64})
    return found.select("stack", "frame", "n", _r("re", 5), _r("im", 5))


def wavelet_blocks(spark, sf):
    found = blocks.on_blocks(_frames(spark, sf), ["stack"], {"frame": 8, "n": 64}, lambda x: blocks.wavelet3d(x, 3, "db4"))
    return found.select("stack", "frame", "n", _r("re", 5))


def coil_whitening(spark, sf):
    matrix = coils.matrix_table(spark, coils.whitening_matrix(src.coil_rows(spark, sf), CHANNELS))
    c = src.coil_samples(spark, sf).select("vec_id", "coil", "re", "im")
    return coils.apply_matrix(c, matrix, ["vec_id"], "coil").select("vec_id", "coil", _r("re", 6), _r("im", 6))


def coil_compression(spark, sf):
    matrix = coils.matrix_table(spark, coils.compression_matrix(src.coil_rows(spark, sf), CHANNELS, 4))
    c = src.coil_samples(spark, sf).select("vec_id", "coil", "re", "im")
    # The sign of a principal direction is free: magnitudes are reported.
    return coils.apply_matrix(c, matrix, ["vec_id"], "coil").select("vec_id", "coil", settled(cplx.magnitude(cplx.pair("re", "im")), 5).alias("magnitude"))


def voronoi_weights(spark, sf):
    from larmor.operators import voronoi

    s = src.samples(spark, sf).select("l_returnflag", "kx", "ky").distinct().withColumn("sample", F.floor((F.col("kx") + 25) * 100 + F.col("ky") + 5).cast("long"))
    return voronoi.density_weights(s, ["l_returnflag"], ["kx", "ky"]).select("l_returnflag", "sample", _r("kw", 4))


def reconstruct_sos(spark, sf):
    s = src.samples(spark, sf).groupBy("l_returnflag", "kx", "ky").agg(F.avg("re").alias("re"))
    flags = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    k = s.select(F.lit(0).alias("frame"), flags.alias("coil"), F.floor((F.col("kx") + 25) * 100 + F.col("ky") + 5).cast("long").alias("sample"), F.col("ky").alias("ky"), F.col("kx").alias("kx"), F.lit(1.0).alias("kw"), F.col("re").cast("double").alias("re"), F.lit(0.0).alias("im"))
    found = recon.reconstruct(spark, k, {"y": 16, "x": 64}, options=recon.Options(method="sos"))
    return found.select("frame", "y", "x", _r("re", 1))


#: Iterative or dense: no SQL.
EXTRA |= {f.__name__: f for f in (svd_block_threshold, fft_blocks, wavelet_blocks, coil_whitening, coil_compression, voronoi_weights, reconstruct_sos)}


def queries() -> dict[str, Query]:
    return dict(_Q) | EXTRA
