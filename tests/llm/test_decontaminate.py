import re

from pyspark.sql import functions as F

from larmor.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = {}
    grams = []
    for item, text in items:
        w = words(text)
        if w:
            size = min(window, len(w))
            grams += [(tuple(w[i : i + size]), item) for i in range(len(w) - size + 1)]
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        places = {}
        for size in {len(g) for g, _ in grams}:
            for i in range(len(w) - size + 1):
                places.setdefault(tuple(w[i : i + size]), []).append(i)
        for g, item in grams:
            for i in places.get(g, []):
                found.add(str(item))
                hit |= set(range(i, i + len(g)))
        out[doc] = (len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w))
    return out


def check(spark, docs, items, **more):
    import hashlib

    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    index = D.materialize(D.build_index(d, shard_words=more.pop("shard_words", D.SHARD_WORDS)), "test")
    got = {r["doc_id"]: r for r in D.summarize(D.search(index, i, **more)).collect()}
    want = brute(docs, items)
    assert got.keys() == want.keys()
    for doc, (n, hit, found, bad) in want.items():
        r = got[doc]
        assert (r["n_words"], r["n_hit"], r["contaminated"]) == (n, hit, bad)
        assert r["items_sha256"] == hashlib.sha256(found.encode()).hexdigest()
        assert r["n_items"] == len(found.split(",")) * bool(found)


def test_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    check(spark, docs, items)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = [(1, None), (2, ""), (3, "!!! ..."), (4, "A b"), (5, "a B a b x"), (6, long + " end " + long), (7, "w39"), (8, "w0 w1"), (9, "a " * 3000)]
    items = [(1, "a b"), (2, None), (3, "..."), (10, long), (11, long.upper()), (12, "w39 w0"), (13, "A"), (14, "a a")]
    check(spark, docs, items)
    check(spark, docs, items, shard_words=5)
    check(spark, docs, items, query_bytes=1)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x green blue"), (2, "blue green red"), (3, "red x x x green blue"), (4, "red")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    hits = D.search(D.build_index(docs), items, slop=1)
    assert {r["doc_id"]: len(r["matches"]) > 0 for r in hits.collect()} == {1: True, 2: True, 3: False, 4: False}


def test_empty_tables_and_repeats(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 6), (None, "a b", 7)], "doc_id long, text string, n_words int")
    items = spark.createDataFrame([(1, "a b", 1)], "item_id long, text string, doc_id int")
    assert [r["n_hit"] for r in D.contamination(docs, items).collect()] == [2, 2, 2]
    assert [r["n_hit"] for r in D.contamination(docs, items.where(F.lit(False))).collect()] == [0, 0, 0]
    assert D.contamination(docs.where(F.lit(False)), items).collect() == []
