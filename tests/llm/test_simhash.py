import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larmor.llm import simhash as S
from larmor.llm.components import connected_components

DOC = "doc_id long, text string"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance=3):
    """Root position of each fingerprint by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= distance) + i + 1
        for j in near.tolist():
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    fps = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    root = brute_components(fps)
    got = {r["doc_id"]: r for r in S.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    for i, (doc, _) in enumerate(rows):
        assert got[doc]["fp"] % (1 << 64) == int(fps[i])
        assert got[doc]["component_id"] == rows[root[i]][0]


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_dense_and_sparse_fingerprints(spark, blocks):
    rng = np.random.default_rng(blocks)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for c in centres for k in range(9) for _ in range(25)]
    fps = np.unique(np.concatenate([np.array(fps, np.uint64), rng.integers(0, 1 << 63, 800, dtype=np.uint64), np.array([0, 7, 15, (1 << 64) - 1], np.uint64)]))
    table = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    root = brute_components(fps)
    got = {}
    for r in S.link_fingerprints(table, blocks=blocks).collect():
        got.setdefault(r["root"], set()).add(r["node"] % (1 << 64))
    want = {}
    for i, r in enumerate(root):
        want.setdefault(r, set()).add(int(fps[i]))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_gray_rank_keeps_prefixes_together():
    codes = np.array([i ^ (i >> 1) for i in range(256)], np.uint64)
    assert (S.gray_rank(codes) == np.arange(256)).all()


def test_edges(spark):
    long = "w1 w2 w3 " * 30000
    rows = [(5, None), (4, ""), (9, " \t\n"), (1, "Hello"), (2, "hello"), (None, "hello"), (7, "a b"), (7, "a b"), (8, long), (None, None)]
    docs = spark.createDataFrame(rows, DOC).withColumn("fp", F.lit("x")).withColumn("component_id", F.lit("y"))
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in S.near_duplicates(docs).collect())
    assert got == sorted([(5, 4), (4, 4), (9, 4), (1, 1), (2, 1), (0, 1), (7, 7), (7, 7), (8, 8), (0, 4)])
    assert S.near_duplicates(docs.where(F.lit(False))).collect() == []
    nameless = S.near_duplicates(spark.createDataFrame([(None, "q")], DOC)).collect()
    assert [(r["doc_id"], r["component_id"]) for r in nameless] == [(None, None)]


def test_connected_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(1, 200)] + [(None, 3), (9, 9)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
