import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larmor.llm import toxicity as T
from larmor.llm.queries import op3_toxicity


def brute_probability(counts, shared, context, char, order=T.ORDER, d=T.DISCOUNT):
    """Kneser-Ney by dictionaries: counts of one class, continuation counts of the pooled grams."""

    def smooth(table, ctx, lower):
        row = {c: n for (x, c), n in table.items() if x == ctx}
        total = sum(row.values())
        return (max(row.get(char, 0) - d, 0) + d * len(row) * lower) / total if total else lower

    p = 1 / 256
    for k in range(1, order):
        p = smooth(shared[k], context[len(context) - k + 1 :], p)
    return smooth(counts, context, p)


def test_ratio_is_the_textbook_one():
    words = [{b"loss": 3, b"losing": 1, b"bad": 2}, {b"lost": 4, b"good": 5, b"bad": 1}]
    tables = [{}, {}]
    for table, own in zip(tables, words, strict=True):
        for w, n in own.items():
            s = b"\0" * (T.ORDER - 2) + b"\x02" + w + b"\x03"
            for i in range(T.ORDER - 1, len(s)):
                key = (s[i - T.ORDER + 1 : i], s[i])
                table[key] = table.get(key, 0) + n
    grams = {ctx + bytes([c]) for table in tables for ctx, c in table}
    shared = {}
    for k in range(T.ORDER - 1, 0, -1):
        low = {}
        for g in grams:
            low.setdefault(g[1:], set()).add(g)
        shared[k] = {(g[:-1], g[-1]): len(s) for g, s in low.items()}
        grams = set(low)
    code, of = T.spell([w for own in words for w in own])
    number = np.array([n for own in words for n in own.values()])[of]
    toxic = of < 3
    keys, inverse = np.unique(code, return_inverse=True)
    kn = T.KneserNey(keys, np.bincount(inverse, number * toxic), np.bincount(inverse, number * ~toxic))
    for word in (b"lossy", b"bad", b"zebra"):
        s = b"\0" * (T.ORDER - 2) + b"\x02" + word + b"\x03"
        want = 0.0
        for i in range(T.ORDER - 1, len(s)):
            a, b = (brute_probability(t, shared, s[i - T.ORDER + 1 : i], s[i]) for t in tables)
            want += math.log(a / b)
        assert kn.ratio([word])[0] == pytest.approx(want)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op3_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert (toxic.predicted == 1).mean() >= 0.8  # some labels are noise
    assert (clean.predicted == 0).mean() >= 0.98


def test_edges(spark):
    rows = [(i, "you vile brute" if i % 2 else "a nice day", i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "vile"), (900, None), (901, ""), (902, "..."), (903, "day " * 50000), (903, "vile")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (900, None), (5, 0)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    got = [(r["doc_id"], r["predicted"]) for r in T.score(docs, model).where("doc_id is null or doc_id >= 900").collect()]
    assert sorted(got, key=str) == sorted([(None, 1), (900, 0), (901, 0), (902, 0), (903, 0), (903, 1)], key=str)
    assert T.reject(docs, model).columns == docs.columns
    assert T.reject(docs, model).where("doc_id is null").count() == 0
    none = T.fit(docs, labels.where(F.lit(False)))
    assert {r["predicted"] for r in T.score(docs, none).collect()} == {0}
    assert T.score(docs.where(F.lit(False)), model).collect() == []
