"""Mixing sources to target weights by entropy balancing.

Among all rates that bring each source's tokens to its target, the mix has those closest to one in
relative entropy, measured on token mass: minimise ``sum size * (r log r - r)`` subject to
``sum_s size * r = target_s``.  The convex dual has one multiplier per source; its gradient and its
Hessian need only moments ``sum size * exp(lambda)``, which are aggregated over all documents with
map-side combination before anything is shuffled.  The Newton steps run for all sources in parallel on
that table of moments.  The rates are ``exp(lambda)`` (exponential tilts), bounded by the copy limit.

Rates become whole copies by systematic selection: each document takes ``floor(rate)`` copies, and one
more where its hash is below a cut of its source.  The cut is the point at which the words taken come
closest to the target, found in two levels: hash buckets are summed and accumulated, then only the
documents of the one bucket that the cut splits are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (5, 2, 1)
COPY_LIMIT = 3
BUCKETS = 1 << 12
NEWTON_STEPS = 60
#: Up to so many sources their table is sent to every executor; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of runs without white space (0x20, 0x09 to 0x0D); null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def balance(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = COPY_LIMIT) -> DataFrame:
    """``(source, source_size)`` per source -> with ``target``.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes.  A target
    stops at ``limit`` times its source's size; the excess is shared again by weight until none is above.
    The fixed point is reached in one pass: in order of ``size / weight``, the sources that stop are a
    prefix, and the level of the others follows from what the prefix leaves.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    rated = totals.withColumn("weight", share.cast("double"))
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    tried = (
        rated.withColumn("below", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * limit)
        .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(whole) - F.col("below")) / F.col("left_weight"))
        .withColumn("stops", F.col("level") * F.col("weight") > F.col("source_size") * limit)
    )
    first_free = F.max(F.when(~F.col("stops"), F.struct("left_weight", "level"))).over(whole)
    target = F.when(F.col("stops") | first_free.isNull(), (F.col("source_size") * limit).cast("double")).otherwise(first_free["level"] * F.col("weight"))
    return tried.select("source", "source_size", target.alias("target"))


def newton_dual(moments: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """Adds ``rate = exp(lambda)``: Newton's method on the dual of each source from ``lambda = 0``.

    The dual of a source is ``source_size * exp(l) - target * l``; a step adds
    ``target / (source_size * exp(l)) - 1``, at most 1, and the iteration is convergent from the second
    step on (the dual is convex and self-concordant in ``exp(l)``).  A source without words keeps rate 1.
    """
    ratio = F.col("target") / F.col("source_size")
    step = lambda l, _: l + F.least(F.lit(1.0), ratio * F.exp(-l) - 1)  # noqa: E731, E741
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)
    return moments.withColumn("rate", F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.exp(solved)).when(F.col("source_size") > 0, 0.0).otherwise(1.0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, limit: int = COPY_LIMIT, seed: int = 17) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source_size, target, copies, taken`` with ``taken = copies * size``.

    ``copies`` is 0 to ``limit``.  The words taken of a source differ from its target by less than its
    largest document.  Null texts have size 0 and are taken zero words; a null source is a source of its
    own.  Repeated rows are decided one by one, in an order that reruns repeat: rows alike in every
    column read here are interchangeable.  Other columns are not read; no rows give no rows.
    """
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(source_col), F.length(text_col))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")
    )
    sized = materialize(sized.withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 20), F.lit(BUCKETS))), "sizes")
    cells = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    totals = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    rated = newton_dual(balance(totals, weights, limit), NEWTON_STEPS)
    # A rate within 1e-9 of a whole number is that number; the rest of the target is what extra copies give.
    base = F.floor(F.least(F.col("rate"), F.lit(float(limit))) + 1e-9)
    rated = rated.withColumn("base", base).withColumn("extra", F.greatest(F.lit(0.0), F.col("target") - F.col("base") * F.col("source_size")))
    rated = materialize(rated.select("source", "source_size", "target", "rate", "base", "extra"), "rates")

    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = cells.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    filled = filled.select(F.col("source").alias("of"), F.col("bucket").alias("cut"), "words", "before")
    at_cut = (F.col("before") <= F.col("extra")) & (F.col("extra") < F.col("before") + F.col("words"))
    level = rated.join(filled, F.col("source").eqNullSafe(F.col("of")) & at_cut, "left")
    level = materialize(level.select(F.col("source").alias("of"), "source_size", "target", "rate", "base", "extra", "cut", "before"), "levels")
    level = F.broadcast(level) if level.count() <= BROADCAST_SOURCES else level

    joined = sized.join(level, F.col("source").eqNullSafe(F.col("of")))
    clear = joined.where("cut is null or bucket <> cut").withColumn("more", F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)).cast("int"))
    by_key = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(by_key), F.lit(0))
    split = joined.where("bucket = cut").withColumn("more", (start + F.col("size") / 2 <= F.col("extra")).cast("int"))
    copies = F.least(F.col("base") + F.col("more"), F.lit(limit)).cast("int")
    return clear.unionByName(split).select("doc_id", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
