"""Distributed union-find: connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: A round over so many edges or fewer sends its minima to every executor (two rows an edge at most).
BROADCAST_EDGES = 250_000


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _larger_first(edges: DataFrame) -> DataFrame:
    """Distinct edges with ``u > v``; loops go."""
    return (
        edges.where("u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of any orderable type -> ``(node, root)``, root the smallest node of its component.

    Each round links every larger neighbour of a node to its smallest neighbour, then every smaller one,
    until the edges form stars.  The two steps are grouped minima and equi-joins, so a hub with very many
    neighbours is pre-aggregated before the shuffle and its join side can be split.  The edges of a round
    are a table in the shared folder.  Rows with a null end are ignored; no edges give no rows.
    """
    edges = materialize(_larger_first(edges.select("u", "v").where("u is not null and v is not null")), "edges")
    seen = _signature(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        held: list[DataFrame] = []

        def minima(found: DataFrame, rows: int = seen[0], held: list = held) -> DataFrame:
            """As a table of its own, so that the join can split a hub's rows."""
            if rows <= BROADCAST_EDGES:
                return F.broadcast(found)
            held.append(materialize(found, "minima"))
            return held[-1]

        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = minima(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(_larger_first(large), "edges")
        low = minima(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = materialize(_larger_first(small), "edges")
        discard(edges, large, *held)
        edges = after
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select("v").distinct()
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )
    found._scratch = edges._scratch
    return found
