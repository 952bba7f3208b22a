import re

import pytest
from pyspark.sql import functions as F

from larmor.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def targets(sizes, limit=3):
    """Water filling, round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(limit * sizes[s] for s in stopped)
        rest = sum(weight[s] for s in names if s not in stopped)
        out = {s: limit * sizes[s] if s in stopped else left * weight[s] / rest for s in names}
        over = {s for s in names if s not in stopped and out[s] > limit * sizes[s]}
        if not over:
            return out
        stopped |= over


def check(docs):
    rows = [r.asDict() for r in mixing.mix(docs).collect()]
    given = docs.select("doc_id", "text", "source").collect()
    assert len(rows) == len(given)
    sizes, source = {}, {}
    for r in given:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
        source[r["doc_id"]] = r["source"]
    want = targets(sizes)
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["size"] == 0 or r["rate"] == pytest.approx(want[s] / sizes[s], rel=1e-9)
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 * want[s], (s, taken[s], want[s], largest[s])
    return sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rows)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert check(docs) == check(docs.repartition(3))


def test_stops_nulls_and_empty_texts(spark):
    rows = [(i, "w " * (i % 7), s) for i, s in enumerate(["a"] * 3 + ["b"] * 500 + ["c"] * 20 + [None] * 40 + ["B"] * 9)]
    rows += [(1000, None, "e"), (1001, "", "e")]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("x")))


def test_repeated_rows_and_one_hot_source(spark):
    rows = [(7, "a b c", "hot")] * 300 + [(i, "x y", f"s{i % 3}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs)
    assert got.count() == 330
    assert {r["doc_id"] for r in got.where("copies > 3 or copies < 0").collect()} == set()


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    only = mixing.mix(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["taken"]) for r in only] == [(0, 0)]
