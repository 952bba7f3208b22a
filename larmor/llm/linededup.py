"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Lines are grouped by their folded text first, so a line that stands in very many documents is one row
from then on.  Each distinct line has a signature over its character shingles (``GRAM`` code points from
every position): ``HASHES`` independent hashes, and under each the minima of ``MASKS`` permutations that
look at different parts of the hash's range.  A band takes one minimum from each hash; equal bands make
candidates.  A line is compared with the first line of each of its buckets; after that, whatever the size
of a bucket, all its lines that are not in one component yet are compared with each other.  A candidate pair
is passed over where four bits of each minimum agree in fewer than ``AGREE`` places, or where ``MAP`` bits, one
of them set by each gram, differ in more places than sets of this size can that are alike enough (no pair is
lost by that: each such place is a gram of one set alone).  Every other one is decided by the exact Jaccard similarity of
the whole sets.  Among all the lines of a bucket the tests are part of the joins, so that pairs that fail are never rows: a
semi-join leaves the lines that have a possible partner, another those that a larger map of ``WIDE`` longs allows one, and
these are compared by 32 bits of each gram before the exact test.  Lines that are alike enough meet in distributed union-find, and of each
component the first occurrence, by document id and line number, stays.

What is missed, by the binomial formulas: of pairs at similarity 0.8 some 0.7 % share no band and 0.03 % fall
short of ``AGREE``; both shares fall quickly above 0.8.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_shuffles, materialize
from .components import connected_components

HASHES, MASKS, BANDS = 4, 8, 12
GRAM = 5
#: Grams that one row of the signature's aggregation holds.
STEP = 6
#: Least places of ``HASHES * MASKS`` in which four bits of the minima agree.  Minima that differ have equal bits once in 16 times.
AGREE = 18
#: Longs of 64 bits of which each gram of a line sets one bit.
MAP = 4
#: Longs of the larger map of grams that lines have which stand in a bucket with others' components.
WIDE = 16
#: Components of a bucket that one task compares with each other.  A line is sent to as many tasks as its bucket has blocks.
BLOCK = 2048
THRESHOLD = 0.8
#: So many line numbers or keys are sent to every executor; a larger table is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Masks under one hash start with different bits, so that their minima come from different eighths of its range.
_MASKS = [(((m << 61) | random.Random(m).getrandbits(61)) ^ (1 << 63)) - (1 << 63) for m in range(MASKS)]
#: For each band the mask whose minimum it takes from each hash: every mask is used about equally often.
_BANDS = list(zip(*[(random.Random(97 * r).sample(range(MASKS), MASKS) + random.Random(97 * r + 1).sample(range(MASKS), MASKS))[:BANDS] for r in range(HASHES)], strict=True))
#: One bit of every four.
_FOURTH = int("0001" * 16, 2)


#: White space inside lines, as it is folded.
_WHITE = " \t\r\x0b\x0c"


def folded(line: Column) -> Column:
    """A line as it is compared: lower case, runs of white space as one space, none at the ends."""
    uneven = line.contains("  ")
    for white in _WHITE[1:]:
        uneven = uneven | line.contains(white)
    return F.lower(F.trim(F.when(uneven, F.regexp_replace(line, f"[{_WHITE}]+", " ")).otherwise(line)))


def blank(line: Column) -> Column:
    """True where the folded line is empty; found without folding it."""
    return ~line.rlike(f"[^{_WHITE}]")


def _code(line: Column) -> Column:
    """Four bytes for each code point, so that a gram is found at once wherever it stands."""
    return F.encode(line, "UTF-32")


def _last(code: Column) -> Column:
    """Place of the last gram, counted from 0."""
    return F.greatest((F.octet_length(code) / 4).cast("int") - GRAM, F.lit(0))


def _gram(code: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(code, at * 4 + 1, F.lit(4 * GRAM)))


def gram_set(line: Column) -> Column:
    """Hashes of the ``GRAM`` code points from every position, without repeats; a shorter line is its own gram."""
    # The array of one binds the code to a variable; as a plain expression it would be made anew for every gram.
    of = lambda code: F.array_distinct(F.transform(F.sequence(F.lit(0), _last(code)), lambda i: _gram(code, i)))
    return F.element_at(F.transform(F.array(_code(line)), of), 1)


def grams(lines: DataFrame, *keep: str) -> DataFrame:
    """``keep, x``: ``gram_set`` of ``line``, a row for each gram."""
    return lines.select(*keep, F.explode(gram_set(F.col("line"))).alias("x"))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``d, h``: a document's id (null as the largest long) and the hash of its text; and the text."""
    d = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    return docs.select(d.alias("d"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))


def distinct_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct folded lines that are not blank: ``h1, h2`` (128-bit key), ``d, h, n`` (first occurrence), ``line``."""
    lines = _keyed(docs, id_col, text_col).select("d", "h", F.posexplode(F.split("text", "\n")).alias("n", "raw")).where(~blank(F.col("raw"))).withColumn("line", folded(F.col("raw")))
    hashed = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "d", "h", "n", "line")
    grouped = hashed.groupBy("h1", "h2").agg(F.min(F.struct("d", "h", "n")).alias("at"), F.first("line").alias("line"))
    return grouped.select("h1", "h2", "at.d", "at.h", "at.n", "line")


def band_keys(lines: DataFrame) -> DataFrame:
    """``h1, h2, d, h, n, keys, bits``: one 64-bit key for each band of a line's signature; four bits of each minimum, the map of grams and their number.

    A row of the aggregation holds ``STEP`` grams; the last row of a line repeats the last gram, which changes no minimum.
    The rows of a line lie in one partition already: the aggregation needs no exchange.
    """
    place = ("h1", "h2", "d", "h", "n")
    coded = lines.select(*place, _code(F.col("line")).alias("code")).withColumn("last", _last(F.col("code")))
    rows = coded.select(*place, "code", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STEP))).alias("i"))
    rows = rows.select(*place, "last", *[_gram(F.col("code"), F.least(F.col("i") + j, F.col("last"))).alias(f"x0_{j}") for j in range(STEP)])
    rows = rows.select(*rows.columns, *[F.xxhash64(F.lit(r), f"x0_{j}").alias(f"x{r}_{j}") for r in range(1, HASHES) for j in range(STEP)])
    minimum = lambda r, m: F.min(F.least(*[F.col(f"x{r}_{j}").bitwiseXOR(F.lit(_MASKS[m])) for j in range(STEP)]))
    at = lambda j: F.shiftrightunsigned(f"x0_{j}", 32).bitwiseAND(F.lit(63)).cast("int")
    one = lambda j, w: F.call_function("shiftleft", (F.col(f"x0_{j}").bitwiseAND(F.lit(MAP - 1)) == w).cast("long"), at(j))
    maps = [F.bit_or(reduce(Column.bitwiseOR, [one(j, w) for j in range(STEP)])).alias(f"g{w}") for w in range(MAP)]
    minima = [minimum(r, m).alias(f"m{r}_{m}") for r in range(HASHES) for m in range(MASKS)]
    signed = rows.groupBy(*place).agg(*minima, *maps, (F.max("last") + 1).alias("grams"))
    keys = [F.xxhash64(F.lit(b), *[f"m{r}_{m}" for r, m in enumerate(band)]) for b, band in enumerate(_BANDS)]
    # The low bits of a minimum are hashed again: for a line of one gram they would be those of the gram.
    four = [F.xxhash64(f"m{r}_{m}").bitwiseAND(F.lit(15)) for r in range(HASHES) for m in range(MASKS)]
    words = []
    for at in range(0, len(four), 16):
        word = four[at]
        for k, column in enumerate(four[at + 1 : at + 16], 1):
            word = word.bitwiseOR(F.shiftleft(column, 4 * k))
        words.append(word)
    return signed.select(*place, F.array(*keys).alias("keys"), F.struct(*[w.alias(f"b{i}") for i, w in enumerate(words)], *[f"g{w}" for w in range(MAP)], "grams").alias("bits"))


def _possible(x: str, y: str, threshold: float = THRESHOLD) -> Column:
    """True if four bits of each minimum agree in ``AGREE`` places or more, and the maps of grams allow the similarity.

    Sets A and B of similarity t or more differ in at most (1 - t) / (1 + t) * (|A| + |B|) grams.  Their maps differ in no more
    places than the sets do in grams, and a line's grams with repeats are no fewer than its set.
    """
    differ = F.lit(0)
    for i in range(HASHES * MASKS // 16):
        apart = F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}"))
        two = apart.bitwiseOR(F.shiftrightunsigned(apart, 1))
        differ = differ + F.bit_count(two.bitwiseOR(F.shiftrightunsigned(two, 2)).bitwiseAND(F.lit(_FOURTH)))
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"{x}.g{w}").bitwiseXOR(F.col(f"{y}.g{w}"))) for w in range(MAP)])
    fit = apart * F.lit(1 + threshold) <= F.lit(1 - threshold) * (F.col(f"{x}.grams") + F.col(f"{y}.grams")) + F.lit(1e-6)
    return fit & (F.lit(HASHES * MASKS) - differ >= AGREE)


def bucket_rows(signed: DataFrame) -> DataFrame:
    """``key, hub, a``: the lines of each bucket of two or more, beside the bucket's first line."""
    rows = signed.select(F.explode("keys").alias("key"), F.col("h1").alias("a"))
    bucket = Window.partitionBy("key").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    # A hot bucket is not gathered: its rows pass in order, each beside the first and the one before it.
    found = rows.select("key", "a", F.first("a").over(bucket).alias("hub"))
    shared = found.where("a <> hub")
    return shared.select("key", "hub", "a")


def with_bits(pairs: DataFrame, signed: DataFrame, *names: str) -> DataFrame:
    """Each named column of 64-bit line keys gets the line's bits beside it, as ``<name>_bits``."""
    for name in names:
        pairs = pairs.join(signed.select(F.col("h1").alias(name), F.col("bits").alias(f"{name}_bits")), name)
    return pairs


def hub_pairs(rows: DataFrame, signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b`` (64-bit line keys, a < b): each line of a bucket with the bucket's first."""
    pairs = rows.select(F.col("hub").alias("a"), F.col("a").alias("b")).distinct()
    return with_bits(pairs, signed, "a", "b").where(_possible("a_bits", "b_bits", threshold)).select("a", "b")


def bucket_components(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``key, a, r``: each bucket's lines, but its first, with the roots of their components in ``known``."""
    roots = known.select(F.col("node.h1").alias("a"), F.col("root.h1").alias("r"))
    return rows.join(roots, "a", "left").select("key", "a", F.coalesce("r", "a").alias("r"))


def line_sets(texts: DataFrame) -> DataFrame:
    """``h1, size, cut``: the number of a line's grams without repeats, and 32 bits of each, without repeats."""
    sets = texts.select("h1", gram_set(F.col("line")).alias("grams"))
    return sets.select("h1", F.size("grams").alias("size"), F.array_distinct(F.transform("grams", lambda x: F.shiftright(x, 32).cast("int"))).alias("cut"))


def wide_maps(texts: DataFrame) -> DataFrame:
    """``h1, wide``: ``WIDE`` longs, of whose bits each gram of the line sets one."""
    coded = texts.select("h1", "line").repartition("h1").select("h1", _code(F.col("line")).alias("code"))
    grams = coded.select("h1", "code", F.explode(F.sequence(F.lit(0), _last(F.col("code")))).alias("i")).select("h1", _gram(F.col("code"), F.col("i")).alias("x"))
    word, bit = F.pmod(F.shiftrightunsigned("x", 12), F.lit(WIDE)).cast("int"), F.shiftrightunsigned("x", 40).bitwiseAND(F.lit(63)).cast("int")
    words = grams.select("h1", word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("h1", "w").agg(F.bit_or("bit").alias("bits"))
    of = lambda w: F.coalesce(F.max(F.when(F.col("w") == w, F.col("bits"))), F.lit(0).cast("long"))
    return words.groupBy("h1").agg(*[of(w).alias(f"w{w}") for w in range(WIDE)]).select("h1", F.struct(*[f"w{w}" for w in range(WIDE)]).alias("wide"))


def rival_lines(members: DataFrame) -> DataFrame:
    """``key, a, r, blocks``: the rows of ``members(key, a, r)`` in buckets of several components, and the blocks of their bucket."""
    many = members.select("key", "r").distinct().groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    return members.join(many, "key")


def _apart() -> Column:
    """Rows of one group whose lines lie in different components; of a pair of blocks, one of each."""
    same = reduce(Column.__and__, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "lo", "hi")])
    return same & (F.col("x.r") != F.col("y.r")) & ((F.col("x.lo") == F.col("x.hi")) | (F.col("x.own") != F.col("y.own")))


def possible_rows(rivals: DataFrame, signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``key, lo, hi, own, r, a``: the lines of buckets that may be alike with one of another component there.

    The components of a bucket are dealt into blocks and each pair of blocks is one group, so that no task holds a large bucket.
    """
    held = rivals.join(signed.select(F.col("h1").alias("a"), "bits"), "a").withColumn("own", F.pmod(F.xxhash64("r"), F.col("blocks")).cast("int"))
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "r", "a", "bits")
    x, y = dealt.alias("x"), dealt.alias("y")
    return x.join(y, _apart() & _possible("x.bits", "y.bits", threshold), "left_semi").drop("bits")


def mapped_rows(rows: DataFrame, signed: DataFrame, maps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``possible_rows`` that may be alike with one of another component by the larger maps too."""
    dealt = rows.join(maps.join(signed.select("h1", "bits"), "h1").withColumnRenamed("h1", "a"), "a").select(*rows.columns, "bits", "wide")
    x, y = dealt.alias("x"), dealt.alias("y")
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"x.wide.w{w}").bitwiseXOR(F.col(f"y.wide.w{w}"))) for w in range(WIDE)])
    near = differ * F.lit(1 + threshold) <= F.lit(1 - threshold) * (F.col("x.bits.grams") + F.col("y.bits.grams")) + F.lit(1e-6)
    return x.join(y, _apart() & _possible("x.bits", "y.bits", threshold) & near, "left_semi").select(*rows.columns)


def cross_pairs(rows: DataFrame, signed: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b`` (64-bit line keys), each pair once: the lines of ``mapped_rows`` that are alike enough by ``sets``.

    All tests are part of the join, so that pairs that fail are never rows.  A pair is tested in the first bucket that it
    shares; where one line is the first of that bucket, the pair has been tested before.  Equal grams have equal 32 bits, so
    no alike pair fails; the few that pass by grams which share their 32 bits are left to the exact test.
    """
    dealt = rows.join(sets.join(signed.select("h1", "keys", "bits"), "h1").withColumnRenamed("h1", "a"), "a")
    dealt = dealt.select("key", "lo", "hi", "own", "r", "a", "keys", "bits", "size", "cut")
    x, y = dealt.alias("x"), dealt.alias("y")
    sized = F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * F.lit(threshold)
    first = F.get(F.array_intersect("x.keys", "y.keys"), F.lit(0)) == F.col("x.key")
    # Of a line's grams that share 32 bits all but one may be common ones that were not counted.
    most = F.size(F.array_intersect("x.cut", "y.cut")) + F.greatest(F.col("x.size") - F.size("x.cut"), F.col("y.size") - F.size("y.cut"))
    near = most * F.lit(1 + threshold) >= F.lit(threshold) * (F.col("x.size") + F.col("y.size")) - F.lit(1e-6)
    pairs = x.join(y, _apart() & (F.col("x.r") < F.col("y.r")) & sized & _possible("x.bits", "y.bits", threshold) & first & near)
    return pairs.select(F.col("x.a").alias("a"), F.col("y.a").alias("b"))


def _maybe_broadcast(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``wanted(h1, h2, d, h, n)`` -> ``h1, h2, line``, read from the documents of the first occurrences."""
    by_doc = wanted.groupBy("d", "h").agg(F.collect_list(F.struct("n", "h1", "h2")).alias("places"))
    joined = _keyed(docs, id_col, text_col).join(_maybe_broadcast(by_doc, wanted.count()), ["d", "h"]).withColumn("raw", F.split("text", "\n"))
    taken = F.transform("places", lambda p: F.struct(p["h1"].alias("h1"), p["h2"].alias("h2"), F.element_at("raw", p["n"] + 1).alias("raw")))
    lines = joined.select(F.explode(taken).alias("p")).select("p.h1", "p.h2", folded(F.col("p.raw")).alias("line"))
    return lines.dropDuplicates(["h1", "h2"])  # rows of documents may repeat


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs of keys -> edges ``u, v`` of full keys of lines that are alike enough."""
    key = F.struct("h1", "h2")
    one = texts.select(F.col("h1").alias("a"), key.alias("u"), F.col("line").alias("x"))
    two = texts.select(F.col("h1").alias("b"), key.alias("v"), F.col("line").alias("y"))
    near = pairs.join(one, "a").join(two, "b")
    sets = near.select("u", "v", gram_set(F.col("x")).alias("x"), gram_set(F.col("y")).alias("y"))
    sized = sets.where(F.least(F.size("x"), F.size("y")) >= F.greatest(F.size("x"), F.size("y")) * threshold)
    return sized.where(similarity(F.col("x"), F.col("y")) >= threshold).select("u", "v")


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(lines, components): every distinct line with its first occurrence, and ``(node, root)`` of fuzzy components."""
    spark = docs.sparkSession
    signed = materialize(band_keys(distinct_lines(docs, id_col, text_col)), "line-bands")
    free_shuffles(spark)

    def read(ids: DataFrame) -> DataFrame:
        """``h1, h2, line`` of the lines of ``ids(h1)``."""
        wanted = signed.select("h1", "h2", "d", "h", "n").join(_maybe_broadcast(ids, ids.count()), "h1")
        texts = materialize(_texts(docs, wanted, id_col, text_col), "line-texts")
        free_shuffles(spark)
        return texts

    rows = materialize(bucket_rows(signed), "line-buckets")
    free_shuffles(spark)
    pairs = materialize(hub_pairs(rows, signed, threshold), "line-pairs")
    free_shuffles(spark)
    texts = read(pairs.select(F.col("a").alias("h1")).unionByName(pairs.select(F.col("b").alias("h1"))).distinct())
    edges = materialize(_verify(pairs, texts, threshold), "line-edges")
    discard(pairs, texts)
    free_shuffles(spark)
    known = connected_components(edges)
    members = materialize(bucket_components(rows, known), "line-members")
    discard(rows, known)
    free_shuffles(spark)
    rivals = materialize(rival_lines(members), "line-rivals")
    discard(members)
    free_shuffles(spark)
    possible = materialize(possible_rows(rivals, signed, threshold), "line-rows")
    discard(rivals)
    free_shuffles(spark)
    texts = read(possible.select(F.col("a").alias("h1")).distinct())
    maps = materialize(wide_maps(texts), "line-maps")
    free_shuffles(spark)
    left = materialize(mapped_rows(possible, signed, maps, threshold), "line-rows")
    discard(possible, maps)
    free_shuffles(spark)
    sets = materialize(line_sets(texts.join(left.select(F.col("a").alias("h1")).distinct(), "h1")), "line-sets")
    free_shuffles(spark)
    pairs = materialize(cross_pairs(left, signed, sets, threshold), "line-pairs")
    discard(left, sets)
    free_shuffles(spark)
    more = materialize(_verify(pairs, texts, threshold), "line-edges")
    discard(pairs, texts)
    free_shuffles(spark)
    found = connected_components(edges.unionByName(more))
    discard(edges, more)
    free_shuffles(spark)
    return signed, found


def kept_places(signed: DataFrame, components: DataFrame) -> DataFrame:
    """``d, h, kept``: per document the numbers of the lines that stay."""
    place = F.struct("d", "h", "n")
    linked = signed.select(F.struct("h1", "h2").alias("node"), place.alias("at")).join(components, "node", "left").select(F.coalesce("root", "node").alias("root"), "at")
    firsts = linked.groupBy("root").agg(F.min("at").alias("at")).select("at.*")
    return firsts.groupBy("d", "h").agg(F.collect_list("n").alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each text reduced to its kept lines, and ``n_lines``, ``n_kept`` beside them.

    Blank lines stay where they are and count as kept.  A null text stays null with 0 lines, an empty
    text has one blank line.  Rows with equal id and text are one document: they keep the same lines.
    Null ids are kept, and come last when the first occurrence is chosen.  Columns named ``n_lines`` or
    ``n_kept`` are replaced, all others pass through.  No rows give no rows.
    """
    signed, components = duplicate_lines(docs, id_col, text_col, threshold)
    kept = materialize(kept_places(signed, components), "kept-lines")
    discard(signed, components)
    free_shuffles(docs.sparkSession)
    numbers = kept.agg(F.sum(F.size("kept"))).first()[0] or 0
    kept = kept.select(F.col("d").alias("__d"), F.col("h").alias("__h"), F.col("kept").alias("__kept"))
    d = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    joined = docs.join(_maybe_broadcast(kept, numbers), (d == F.col("__d")) & (F.xxhash64(text_col) == F.col("__h")), "left")
    lines = F.split(F.col(text_col), "\n")
    blanks = F.filter(F.transform("__lines", lambda line, i: F.when(blank(line), i)), lambda i: i.isNotNull())
    places = F.array_sort(F.array_union(F.coalesce("__kept", F.array().cast("array<int>")), blanks))
    left = F.transform(places, lambda i: F.get(F.col("__lines"), i))
    return (
        joined.withColumn("__lines", lines)
        .withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__lines")).cast("long"))
        .withColumn("__left", left)
        .withColumn("n_kept", F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__left")).cast("long"))
        .withColumn(text_col, F.when(F.col("n_kept") == F.col("n_lines"), F.col(text_col)).otherwise(F.array_join("__left", "\n")))
        .drop("__d", "__h", "__kept", "__lines", "__left")
    )
