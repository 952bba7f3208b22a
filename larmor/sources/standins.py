"""Driver tables in the roles of acquisition data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = 64
COILS = 8


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as shots: ``t`` in microseconds, ``v`` the signal."""
    e = load(spark, sf_dir, "events")
    return e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"), F.col("value").alias("v"), "user_id", "event_type")


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since the user's event before."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    s = signals(spark, sf_dir)
    return s.withColumn("gap", (F.col("t") - F.lag("t").over(w)) / 1e6).where("gap is not null")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as lines of 64 points: ``vec_id, n, x``."""
    e = load(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.posexplode("embedding").alias("n", "x")).withColumn("x", F.col("x").cast("double"))


def coil_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as samples of eight complex coils: ``vec_id, coil, re, im``."""
    e = load(spark, sf_dir, "embeddings")
    parts = [F.struct(F.lit(c).alias("coil"), F.col("embedding")[c].cast("double").alias("re"), F.col("embedding")[c + COILS].cast("double").alias("im")) for c in range(COILS)]
    return e.select("vec_id", "label", F.explode(F.array(*parts)).alias("c")).select("vec_id", "label", "c.*")


def coil_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, one row per sample: ``re0 .. re7, im0 .. im7``."""
    e = load(spark, sf_dir, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[c].cast("double").alias(f"re{c}") for c in range(COILS)], *[F.col("embedding")[c + COILS].cast("double").alias(f"im{c}") for c in range(COILS)])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as k-space samples: ``kx, ky, kw`` and value ``re``."""
    i = load(spark, sf_dir, "lineitem")
    return i.select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("kx"), (F.round(F.col("l_discount") * 100) - 5).alias("ky"), F.col("l_tax").alias("kw"), F.col("l_extendedprice").alias("re"),
        F.date_diff(F.col("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("double").alias("kt"), "l_returnflag", "l_linestatus",
    )
