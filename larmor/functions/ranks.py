"""Total orders, and windows that keep their width at the edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "i") -> DataFrame:
    """Adds the 0-based rank in ``order`` within ``by``, and ``n_all``, the number of rows ranked together.

    Shots are ranked, not samples: without ``by`` the narrow projection of one row per shot is ordered as a whole.
    """
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn(name, (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("n_all", F.count(F.lit(1)).over(w))


def clamped_neighbours(df: DataFrame, half: int, value: str, by: list[str] | None = None, rank: str = "i") -> DataFrame:
    """Adds ``near``: the ascending values of the ``2f + 1`` rows around each, ``f`` at most ``(n - 1) div 2``.

    At an edge the window is shifted, not cut.  Ranks are expanded to the places they look at and met by an
    equi-join, so no window frame grows with the data and nothing but the key is sorted.
    """
    keys = list(by or [])
    f = F.least(F.lit(half).cast("long"), F.expr("(n_all - 1) div 2"))
    low = F.greatest(F.lit(0).cast("long"), F.least(F.col(rank) - f, F.col("n_all") - 1 - 2 * f))
    looks = df.select(*keys, F.col(rank).alias("__own"), F.explode(F.sequence(low, low + 2 * f)).alias("__at"))
    seen = df.select(*keys, F.col(rank).alias("__at"), F.col(value).alias("__value"))
    near = looks.join(seen, [*keys, "__at"]).groupBy(*keys, "__own").agg(F.array_sort(F.collect_list("__value")).alias("near"))
    return df.join(near.withColumnRenamed("__own", rank), [*keys, rank])


def order_statistic(near: Column, fraction: float) -> Column:
    """``sorted[int(n * fraction)]``, the last element where that is out of range."""
    n = F.size(near)
    return F.element_at(near, F.least(n, F.floor(n * F.lit(fraction)).cast("int") + 1))
