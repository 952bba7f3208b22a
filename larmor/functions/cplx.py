"""Complex numbers as pairs of double columns (re, im)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def pair(re: str | Column, im: str | Column) -> Pair:
    """Both parts as doubles."""
    col = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    return col(re), col(im)


def mul(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conj(a: Pair) -> Pair:
    return a[0], -a[1]


def norm2(a: Pair) -> Column:
    """Squared magnitude."""
    return a[0] * a[0] + a[1] * a[1]


def magnitude(a: Pair) -> Column:
    return F.sqrt(norm2(a))


def phase(a: Pair) -> Column:
    return F.atan2(a[1], a[0])


def rotate(a: Pair, angle: Column) -> Pair:
    """Multiplied by ``exp(i * angle)``."""
    return mul(a, (F.cos(angle), F.sin(angle)))


def total(a: Pair) -> Pair:
    return F.sum(a[0]), F.sum(a[1])


def settled(x: Column, digits: int) -> Column:
    """Rounded, with one zero: results compare equal across engines."""
    r = F.round(x, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)
