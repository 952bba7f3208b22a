"""Sinks and external images: dense blocks with axes, three-pair acquisitions, images, maps, traces, per-frame sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larmor.operators import coils
from larmor.sources import arrays


def write_dense(df: DataFrame, path: str, group: str, name: str, axes: dict[str, int], parts: tuple[str, ...] = ("re", "im"), rows: int = 1 << 16) -> None:
    """Array ``group/name`` as Parquet blocks: ``block, values`` with the last axis fastest, beside a row of shape and axis names.

    Blocks hold ``rows`` values, so that no row grows with the array; places without data are zero.
    """
    place = F.lit(0).cast("long")
    for a, n in axes.items():
        place = place * n + F.col(a)
    total = 1
    for n in axes.values():
        total *= n
    at = df.select(place.alias("p"), *parts).withColumn("block", F.floor(F.col("p") / rows)).withColumn("i", (F.col("p") % rows).cast("int"))
    # A block is filled from its rows alone: at most ``rows`` of them.
    held = at.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct(*parts)))).alias("m"))
    blocks = df.sparkSession.range(-(-total // rows)).select(F.col("id").alias("block")).join(held, "block", "left")
    size = F.least(F.lit(rows), F.lit(total) - F.col("block") * rows)
    zero = F.struct(*[F.lit(0.0).alias(p) for p in parts])
    entries = F.array_sort(F.map_entries(F.coalesce("m", F.create_map().cast("map<int,struct<" + ",".join(f"{p}:double" for p in parts) + ">>"))))
    dense = F.when(F.size(entries) == size, F.transform(entries, lambda e: e["value"])).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), size - 1), lambda i: F.coalesce(F.element_at("m", i.cast("int")), zero)))
    blocks.select("block", dense.alias("values")).write.mode("overwrite").parquet(f"{path}/{group}/{name}/data")
    about = [(list(axes), list(axes.values()), list(parts), rows)]
    df.sparkSession.createDataFrame(about, "axes array<string>, shape array<int>, parts array<string>, rows int").write.mode("overwrite").parquet(f"{path}/{group}/{name}/about")


def read_dense(spark: SparkSession, path: str, group: str, name: str) -> DataFrame:
    """The array back in long form: its axes and parts."""
    about = spark.read.parquet(f"{path}/{group}/{name}/about").first()
    at = spark.read.parquet(f"{path}/{group}/{name}/data").select("block", F.posexplode("values").alias("i", "v"))
    place, out = F.col("block") * about["rows"] + F.col("i"), []
    for a, n in list(zip(about["axes"], about["shape"], strict=True))[::-1]:
        out.append((place % n).cast("int").alias(a))
        place = F.floor(place / n)
    return at.select(*out[::-1], "v.*")


def write_three_pairs(samples: DataFrame, base: str, sizes: dict[str, int]) -> None:
    """Data, trajectory and density as header pairs ``base_data``, ``base_traj``, ``base_dcf``.

    ``samples`` has ``frame, coil, shot, pos, kx, ky, kz, kw, re, im``; ``sizes`` holds pos, shot, coil and frame.
    Frames are the eleventh dimension; places that a ragged encode lacks are zero.
    """
    def dims(first: int, coil: int) -> dict[str, int]:
        ones = {f"__d{i}": 1 for i in range(6)}
        return {"__part": first, "pos": sizes["pos"], "shot": sizes["shot"], "coil": coil, **ones, "frame": sizes["frame"]}

    def write(df: DataFrame, name: str, axes: dict[str, int]) -> None:
        flat = df.withColumns({a: F.lit(0) for a in axes if a not in df.columns})
        arrays.write_header_pair(flat, f"{base}_{name}", axes)

    write(samples, "data", dims(1, sizes["coil"]))
    one = samples.where("coil = 0")
    part = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(k).alias("v")) for i, k in enumerate(("kx", "ky", "kz"))]))
    turned = one.select("frame", "shot", "pos", part.alias("p")).select("frame", "shot", "pos", F.col("p.i").alias("__part"), F.col("p.v").alias("re"), F.lit(0.0).alias("im"))
    write(turned, "traj", dims(3, 1))
    write(one.select("frame", "shot", "pos", F.col("kw").alias("re"), F.lit(0.0).alias("im")), "dcf", dims(1, 1))


def write_images(images: DataFrame, path: str) -> None:
    """Magnitudes and complex values as two tables, partitioned by frame (and encode, where there is one)."""
    by = [c for c in ("frame", "encode") if c in images.columns]
    images.withColumn("magnitude", F.hypot("re", "im")).drop("re", "im").write.mode("overwrite").partitionBy(*by).parquet(f"{path}/Images")
    images.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/ComplexImages")


def append_debug_slice(images: DataFrame, path: str, size_z: int, iteration: int) -> None:
    """The centre slice's magnitude of one iteration, appended."""
    centre = images.where(F.col("z") == size_z // 2).withColumn("magnitude", F.hypot("re", "im")).withColumn("iteration", F.lit(iteration))
    centre.drop("re", "im", "z").write.mode("append").parquet(path)


def write_coil_images(images: DataFrame, path: str) -> None:
    """Images of every frame and coil, partitioned by coil."""
    images.write.mode("overwrite").partitionBy("coil").parquet(path)


def write_coil_maps(maps: DataFrame, path: str, voxel: list[str], debug: bool = False) -> None:
    """Maps partitioned by coil; with ``debug`` their root sum of squares beside them."""
    write_coil_images(maps, f"{path}/SenseMaps")
    if debug:
        coils.root_sum_squares(maps, voxel).write.mode("overwrite").parquet(f"{path}/DebugSenseMaps")


def write_gating_traces(shots: DataFrame, path: str, names: list[str], order: list[str]) -> None:
    """One table a trace: ``order`` and the trace, sorted over all files."""
    for name in names:
        shots.select(*order, name).orderBy(*order).write.mode("overwrite").parquet(f"{path}/{name}")


def read_frames(spark: SparkSession, paths: list[str], axes: dict[str, int], dtype: str = "<c8") -> DataFrame:
    """One raw image file for each frame, first axis fastest -> ``frame, axes, re, im``; a file of another size raises."""
    names, shape = list(axes), tuple(axes.values())
    out = None
    for frame, path in enumerate(paths):
        one = arrays.read_raw(spark, path, shape, dtype)
        one = one if "re" in one.columns else one.select("path", "i", F.col("value").alias("re"), F.lit(0.0).alias("im"))
        place, columns = F.col("i"), []
        for a in names:
            columns.append((place % axes[a]).cast("int").alias(a))
            place = F.floor(place / axes[a])
        one = one.select(F.lit(frame).alias("frame"), *columns, "re", "im")
        out = one if out is None else out.unionByName(one)
    return out


def read_field_of_view(spark: SparkSession, path: str) -> DataFrame:
    """The external image ``Images/SOS`` that a field of view is cut from, in long form."""
    return read_dense(spark, path, "Images", "SOS")
