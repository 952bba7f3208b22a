"""Respiratory weights, time frames and view sharing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larmor.functions.ranks import clamped_neighbours, order_statistic, ranked

_BELOW = 1.0 - 1e-9


def scaled_frame(df: DataFrame, value: str, frames: int, low: Column | None = None, high: Column | None = None, name: str = "t_frame") -> DataFrame:
    """Adds ``(value - low) * frames / (high - low)`` just under ``frames``; the range is the data's unless given.

    The range is one aggregated row, joined to all.
    """
    span = df.agg((F.min(value) if low is None else low).cast("double").alias("__lo"), (F.max(value) if high is None else high).cast("double").alias("__hi"))
    scaled = (F.col(value) - F.col("__lo")) * F.lit(frames) / (F.col("__hi") - F.col("__lo")) * F.lit(_BELOW)
    return df.crossJoin(F.broadcast(span)).withColumn(name, scaled).drop("__lo", "__hi")


def frame_none(df: DataFrame, frames: int, t: str = "t_frame") -> DataFrame:
    """Adds ``frame``: the whole part of the scaled time."""
    return df.withColumn("frame", F.floor(t).cast("int")).where((F.col("frame") >= 0) & (F.col("frame") < frames))


def frame_hist(df: DataFrame, frames: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds ``frame``: equal-count frames of the ranks in ``order``."""
    return ranked(df, order, by).withColumn("frame", F.expr(f"i * {frames} div n_all").cast("int"))


def respiratory_range(df: DataFrame, value: str, frames: int, low: float = 0.0, high: float = 1.0) -> tuple[Column, Column]:
    """Range from quantiles, widened by half a frame at both ends (one frame: by half the range)."""
    q0, q1 = F.percentile(value, F.lit(low)), F.percentile(value, F.lit(high))
    half = (q1 - q0) / F.lit(max(frames - 1, 1)) / 2
    return q0 - half, q1 + half


def retrospective_period(df: DataFrame, gap: str) -> DataFrame:
    """One row: ``rr`` = twice the median of the gaps, ``rr_clipped`` = twice the median of those under 1.3 times it."""
    first = df.agg((F.percentile(gap, F.lit(0.5)) * 2).alias("rr"))
    near = df.crossJoin(F.broadcast(first)).where(F.col(gap) < F.col("rr") * 1.3)
    return first.crossJoin(near.agg((F.percentile(gap, F.lit(0.5)) * 2).alias("rr_clipped")))


def resp_threshold(df: DataFrame, value: str, order: list[str], half: int, efficiency: float, by: list[str] | None = None) -> DataFrame:
    """Adds ``weight``: 1 where the value reaches the order statistic of its clamped window, else 0."""
    if not 0 < efficiency <= 1:
        raise ValueError("efficiency must be above 0 and at most 1")
    near = clamped_neighbours(ranked(df, order, by), half, value, by)
    return near.withColumn("weight", (F.col(value) >= order_statistic(F.col("near"), 1 - efficiency)).cast("int")).drop("near")


def resp_phase(df: DataFrame, value: str, order: list[str], half: int, lower: float, upper: float, direction: int = 0, slope_half: int = 1, by: list[str] | None = None) -> DataFrame:
    """Adds ``weight``: value between two order statistics of its window, and optionally rising (1) or falling (2).

    The slope is that between the ends of a clamped window of half width ``slope_half``, at least 1; a zero
    slope counts as rising.
    """
    base = ranked(df, order, by)
    near = clamped_neighbours(base, half, value, by)
    inside = (F.col(value) >= order_statistic(F.col("near"), 1 - upper)) & (F.col(value) < order_statistic(F.col("near"), 1 - lower))
    if direction:
        keys, g = list(by or []), max(slope_half, 1)
        f = F.least(F.lit(g).cast("long"), F.expr("(n_all - 1) div 2"))
        low = F.greatest(F.lit(0).cast("long"), F.least(F.col("i") - f, F.col("n_all") - 1 - 2 * f))
        ends = base.select(*keys, "i", low.alias("a"), (low + 2 * f).alias("b"))
        at = lambda name, out: base.select(*keys, F.col("i").alias(name), F.col(value).alias(out))
        slope = ends.join(at("a", "__x"), [*keys, "a"]).join(at("b", "__y"), [*keys, "b"]).select(*keys, "i", (F.col("__y") - F.col("__x") >= 0).alias("rising"))
        near = near.join(slope, [*keys, "i"])
        inside &= F.col("rising") if direction == 1 else ~F.col("rising")
    return near.withColumn("weight", inside.cast("int")).drop("near", "rising")


def resp_hard(df: DataFrame, value: str, order: list[str], efficiency: float) -> DataFrame:
    """Adds ``weight``: strictly above the global order statistic."""
    cut = _global_statistic(df, value, order, 1 - efficiency)
    return df.crossJoin(F.broadcast(cut)).withColumn("weight", (F.col(value) > F.col("cut")).cast("int")).drop("cut")


def resp_soft(df: DataFrame, value: str, order: list[str], efficiency: float, decay: float = 3.0) -> DataFrame:
    """Adds ``weight``: 1 from the global order statistic on, below it ``exp(-(decay / max) * (cut - value))``."""
    cut = _global_statistic(df, value, order, 1 - efficiency).crossJoin(df.agg(F.max(value).alias("top")))
    soft = F.exp(-(F.lit(decay) / F.col("top")) * (F.col("cut") - F.col(value)))
    return df.crossJoin(F.broadcast(cut)).withColumn("weight", F.when(F.col(value) >= F.col("cut"), 1.0).otherwise(soft)).drop("cut", "top")


def _global_statistic(df: DataFrame, value: str, order: list[str], fraction: float) -> DataFrame:
    r = ranked(df.select(value, *[c for c in order if c != value]), [value, *[c for c in order if c != value]])
    return r.where(F.col("i") == F.least(F.floor(F.col("n_all") * F.lit(fraction)), F.col("n_all") - 1)).select(F.col(value).alias("cut"))


def resp_drift(df: DataFrame, value: str, order: list[str], half: int, by: list[str] | None = None) -> DataFrame:
    """Adds ``corrected``: the value minus the median of its clamped window."""
    near = clamped_neighbours(ranked(df, order, by), half, value, by)
    middle = F.element_at("near", (F.size("near") / 2).cast("int") + 1)
    return near.withColumn("corrected", F.col(value) - middle).drop("near")


def moving_average(df: DataFrame, value: str, order: list[str], half: int, by: list[str] | None = None) -> DataFrame:
    """Adds ``average`` over the rows within ``half``; this window is cut at the edges."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(-half, half)
    return df.withColumn("average", F.avg(value).over(w))


def tornado(df: DataFrame, frames: int, radius: str, t: str = "t_frame", low: float = 1.0, high: float = 4.0, power: int = 2, iterative: bool = True) -> DataFrame:
    """View sharing: a row for each frame in reach; the reach grows with the k-space radius.

    Only the frames that can reach are generated, so the rows grow with the reach and not with ``frames``.
    """
    top = df.agg(F.max(F.abs(radius)).cast("double").alias("__kmax"))
    width = F.lit(0.5) * (F.lit(high - low) * F.pow(F.abs(F.col(radius)) / F.col("__kmax"), F.lit(float(power))) + F.lit(low))
    wide = df.crossJoin(F.broadcast(top)).withColumn("width", width)
    first = F.greatest(F.lit(0), F.ceil(F.col(t) - F.col("width") - 0.5).cast("int") - 1)
    last = F.least(F.lit(frames - 1), F.floor(F.col(t) + F.col("width") - 0.5).cast("int") + 1)
    near = wide.where(first <= last).withColumn("frame", F.explode(F.sequence(first, last)))
    kept = near.where(F.abs(F.col(t) - (F.col("frame") + 0.5)) < F.col("width"))
    return kept.withColumn("share", F.lit(1.0) if iterative else 1.0 / F.col("width")).drop("__kmax")


def slice_reset(df: DataFrame, time: str, order: list[str], block: int) -> DataFrame:
    """Adds ``since``: time since the first shot of each block of ``block`` shots."""
    r = ranked(df, order).withColumn("block", F.expr(f"i div {block}"))
    return r.withColumn("since", F.col(time) - F.first(time).over(Window.partitionBy("block").orderBy("i")))


def pregate(df: DataFrame, weight: str, frame: str = "frame", kw: str = "kw") -> DataFrame:
    """Rows of non-zero weight with ``kw`` scaled by a million over their frame's number of points."""
    kept = df.where(F.col(weight) > 0)
    points = kept.groupBy(frame).agg(F.count(F.lit(1)).alias("points"))
    return kept.join(points, frame).withColumn("kw", F.col(kw) * F.lit(1e6) / F.col("points"))


def combine_weights(df: DataFrame, weights: list[str], frame_weight: str | None, composite: bool = False) -> Column:
    """Product of the gate weights, and of the frame weight unless a composite image is made."""
    product = F.lit(1.0)
    for w in weights:
        product = product * F.col(w)
    return product if composite or frame_weight is None else product * F.col(frame_weight)


def temporal_resolution(df: DataFrame, time: str, frames: int) -> DataFrame:
    return df.agg(((F.max(time) - F.min(time)) / F.lit(frames)).alias("resolution"))
