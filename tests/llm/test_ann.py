import numpy as np
import pytest
from pyspark.sql import functions as F

from larmor.llm import ann

ROW = "vec_id long, embedding array<float>"


def brute(ids, x, q_ids, q, k, metric="ip"):
    out = {}
    x = x.astype(np.float64)
    for one, v in zip(q_ids, q.astype(np.float64), strict=True):
        s = (x * v).sum(1) if metric == "ip" else -((x - v) ** 2).sum(1)
        keep = ids != one
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[one] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist(), strict=True))
    return out


def rows_of(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)], ROW)


def answers(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = ann.build(table, shard_rows=1500)
    got = answers(ann.search(index, table.where("vec_id % 20 = 0"), query_rows=40))
    data = table.toPandas()
    ids, x = data.vec_id.to_numpy(), np.stack(data.embedding).astype(np.float32)
    asked = ids % 20 == 0
    want = brute(ids, x, ids[asked], x[asked], 20)
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.95
    exact = dict(zip(ids.tolist(), x.astype(np.float64), strict=True))
    for q, found in got.items():
        assert all(s == pytest.approx(float((exact[q] * exact[i]).sum()), abs=1e-12) for i, s in found)


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_ties_copies_and_few_rows(spark, metric):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.tile([1.0, 2.0, 3.0], (300, 1)), rng.normal(size=(60, 3))]).astype(np.float32)
    ids = rng.permutation(len(x))
    index = ann.build(rows_of(spark, x, ids), shard_rows=100)
    asked = np.flatnonzero(ids % 20 == 0)
    got = answers(ann.search(index, rows_of(spark, x[asked], ids[asked]), metric=metric, k=7))
    assert got == brute(ids, x, ids[asked], x[asked], 7, metric)
    few = ann.build(rows_of(spark, x[-5:]))
    assert {q: len(a) for q, a in answers(ann.search(few, rows_of(spark, x[-5:]))).items()} == dict.fromkeys(range(5), 4)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (8, [])]
    table = spark.createDataFrame(rows, ROW).withColumn("score", F.lit("x")).withColumn("rank", F.lit("x"))
    assert answers(ann.search(ann.build(table), table)) == {0: [(7, 0.5)], 7: [(0, 0.5)]}
    assert ann.build(table.where(F.lit(False))) is None
    assert ann.search(ann.build(table), table.where(F.lit(False))).collect() == []


def test_repeated_query_ids(spark):
    rows = rows_of(spark, np.array([[1.0, 0.0], [0.0, 1.0], [0.6, 0.5]], np.float32))
    asked = spark.createDataFrame([(9, [0.0, 1.0]), (9, [1.0, 0.0]), (9, [0.0, 1.0])], ROW)
    index = ann.build(rows)
    want = [(1, 1.0), (2, 0.5), (0, 0.0)]
    for order in (asked, asked.orderBy(F.desc("embedding")), asked.repartition(3)):
        assert answers(ann.search(index, order)) == {9: want}


def test_beam_and_norms():
    x = np.random.default_rng(2).normal(size=(500, 8)).astype(np.float32)
    quantizer = ann.Quantizer.train(x, stages=4, words=16)
    errors = []
    for beam in (1, 4):
        codes, norms = quantizer.encode(x, beam)
        sums = sum(quantizer.books[s][codes[:, s]] for s in range(4))
        errors.append(((x - sums) ** 2).sum(1).mean())
        assert np.allclose(norms, (sums**2).sum(1), atol=1e-4)
    assert errors[1] < errors[0]
