"""Lines compared over their whole length, by all 5-grams of characters, whatever the size of a bucket."""

import random
from math import comb

from pyspark.sql import functions as F

from larmor.llm import linededup as L

DOC = "doc_id long, text string"


def fold(line):
    return " ".join(line.lower().split())


def grams(line):
    return {line[i : i + 5] for i in range(len(line) - 4)}


def brute(docs, threshold=0.8):
    """Document ids left by comparing all pairs of one-line documents; the smallest id of a component stays."""
    first = {}
    for doc, text in sorted(docs):
        first.setdefault(fold(text), doc)
    lines, sets, root = list(first), {x: grams(x) for x in first}, {x: x for x in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= threshold * len(x | y):
                root[find(b)] = find(a)
    best = {}
    for x in lines:
        best[find(x)] = min(best.get(find(x), first[x]), first[x])
    return set(best.values())


def left(spark, docs):
    return {r["doc_id"] for r in L.dedup(spark.createDataFrame(docs, DOC)).where("n_kept > 0").collect()}


def test_whole_line_counts(spark):
    docs = [
        (1, "https://www.example.org/a/page1"), (2, "https://www.example.net/zzz"), (3, "order 1234567890123456 shipped"), (4, "order 1234567899999999 shipped"),
        (5, "the committee shall meet once in each quarter of the year to hear reports of work"), (6, "the committee shall meet once in each quarter of the year to hear reportz of work"),
    ]
    assert brute(docs) == {1, 2, 3, 4, 5}
    assert left(spark, docs) == {1, 2, 3, 4, 5}


def test_inner_white_space_is_folded(spark):
    assert left(spark, [(1, "Hello   World"), (2, "hello world"), (3, "hello \t world\r"), (4, "ab"), (5, "AB"), (6, "abc")]) == {1, 4, 6}


def test_grams_of_long_lines(spark):
    rng = random.Random(2)
    lines = ["".join(rng.choice("abc ä中\U0001f600") for _ in range(n)).strip() or "x" for n in (1, 4, 5, 31, 32, 33, 36, 37, 64, 68, 69, 1000)]
    lines = [" ".join(x.split()) for x in lines]
    want = [len(grams(x)) or 1 for x in lines]
    got = L.grams(spark.createDataFrame(list(enumerate(lines)), "id long, line string"), "id").groupBy("id").agg(F.count_distinct("x").alias("k")).orderBy("id").collect()
    assert [r["k"] for r in got] == want


def test_every_pair_of_a_large_bucket(spark, monkeypatch):
    # One long common part puts all lines in the same buckets; only the pairs of equal tails are alike.
    monkeypatch.setattr(L, "BLOCK", 4)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common, docs = word(300), []
    for i in range(60):
        tail = word(110)
        docs += [(2 * i, f"{common}{tail}"), (2 * i + 1, f"{common}{tail[:50]}{word(1)}#{tail[52:]}")]
    want = brute(docs)
    assert 50 <= len(want) <= 60
    assert left(spark, docs) == want


def test_what_bands_and_the_filter_miss():
    """At similarity 0.8: pairs short of AGREE by the binomial formula, pairs without a band by counting."""
    places, equal = L.HASHES * L.MASKS, 0.8 + 0.2 / 16
    assert sum(comb(places, k) * equal**k * (1 - equal) ** (places - k) for k in range(L.AGREE)) < 0.0005
    draw, missed, tries = random.Random(5), 0, 50_000
    for _ in range(tries):
        agree = [[draw.random() < 0.8 for _ in range(L.MASKS)] for _ in range(L.HASHES)]
        missed += not any(all(agree[r][m] for r, m in enumerate(band)) for band in L._BANDS)
    assert missed / tries < 0.01


def test_map_of_grams_passes_no_alike_pair(spark, monkeypatch):
    # All pairs at the threshold or above pass; most below 0.6 do not, which the minima alone let through.
    monkeypatch.setattr(L, "AGREE", 0)
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz "
    rows = []
    for i in range(400):
        base = [rng.choice(letters[: rng.choice([2, 27])]) for _ in range(rng.choice([3, 5, 40, 100, 100, 100, 400]))]
        other = [rng.choice(letters) if rng.random() < rng.choice([0.01, 0.02, 0.05, 0.1]) else c for c in base]
        rows += [(2 * i, "x" + "".join(base) + "x"), (2 * i + 1, "x" + "".join(other) + "x")]
    lines = spark.createDataFrame(rows, "i long, line string").select(F.col("i").alias("h1"), F.col("i").alias("h2"), F.col("i").alias("d"), F.col("i").alias("h"), F.lit(0).alias("n"), "line")
    bits = L.band_keys(lines).select("h1", "bits")
    pairs = bits.where("h1 % 2 = 0").select((F.col("h1") + 1).alias("o"), F.col("bits").alias("x")).join(bits.select(F.col("h1").alias("o"), F.col("bits").alias("y")), "o")
    passed = {r["o"]: r["ok"] for r in pairs.select("o", L._possible("x", "y").alias("ok")).collect()}
    alike = {rows[2 * i + 1][0]: len(grams(rows[2 * i][1]) & grams(rows[2 * i + 1][1])) / len(grams(rows[2 * i][1]) | grams(rows[2 * i + 1][1])) for i in range(400)}
    assert len(passed) == 400 and all(passed[o] for o, j in alike.items() if j >= 0.8)
    far = [o for o, j in alike.items() if j < 0.6 and len(rows[o][1]) <= 102]
    assert len(far) > 20 and sum(passed[o] for o in far) < 0.2 * len(far)


def test_shuffle_files_go_between_steps(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(L, "free_shuffles", lambda s: calls.append(s))
    L.dedup(spark.createDataFrame([(1, "one line of text\nanother line"), (2, "one line of text!")], DOC)).collect()
    assert len(calls) >= 6


def test_only_alike_pairs_of_a_bucket_are_rows(spark):
    # One bucket of 60 distinct lines with a common part, similar to each other but not enough, and one true pair.
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common = word(300)
    lines = [common + word(110) for _ in range(60)]
    lines.append(lines[40][:330] + "#" + lines[40][331:])
    alike = sum(len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)) for i, a in enumerate(lines) for b in lines[:i])
    assert alike == 1
    rows = spark.createDataFrame(list(enumerate(lines)), "i long, line string").select(F.col("i").alias("h1"), F.col("i").alias("h2"), F.col("i").alias("d"), F.col("i").alias("h"), F.lit(0).alias("n"), "line")
    signed = L.band_keys(rows).cache()
    texts = rows.select("h1", "h2", "line")
    # All lines but the first share every bucket here, each a component of its own.
    rivals = L.rival_lines(spark.range(1, 61).select(F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("key"), F.col("id").alias("a"), F.col("id").alias("r")))
    signed = signed.withColumn("keys", F.array(*[F.lit(k).cast("long") for k in range(3)]))
    left = L.mapped_rows(L.possible_rows(rivals, signed), signed, L.wide_maps(texts))
    assert {(r["key"], r["a"]) for r in left.collect()} >= {(k, a) for k in range(3) for a in (40, 60)}
    got = L.cross_pairs(left, signed, L.line_sets(texts)).collect()
    assert [(r["a"], r["b"]) for r in got] == [(40, 60)]
