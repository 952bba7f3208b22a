import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larmor.llm import ctw
from larmor.llm.queries import op7_ctw

DOC = "doc_id long, text string"


class Plain:
    """The recursive definition over dictionaries of contexts, node by node, in plain floats."""

    def __init__(self, texts):
        self.n = Counter()
        for text in texts:
            for context, symbol in self.events(text):
                for d in range(ctw.DEPTH + 1):
                    for bit in range(9):
                        self.n[context[:d], bit, symbol >> (8 - bit)] += 1
        self.kids = {}
        for context, _, _ in self.n:
            if context:
                self.kids.setdefault(context[:-1], set()).add(context)
        self.memo = {}

    @staticmethod
    def events(text):
        """(context with the last byte first, symbol): byte by byte, stop after each piece, and the end as an empty piece."""
        pieces, before = [], b"\xfe"
        rest = text
        while rest:
            white = b" \t\n\x0b\x0c\r"
            size = 0
            if rest[0] in white:
                while size < min(32, len(rest)) and rest[size] in white:
                    size += 1
            else:
                while size < min(32, len(rest)) and rest[size] not in white:
                    size += 1
                tail = 0
                while tail < 4 and size + tail < len(rest) and rest[size + tail] in white:
                    tail += 1
                size += tail
            pieces.append(rest[:size])
            rest = rest[size:]
        for piece in [*pieces, b""]:
            seen = before
            for symbol in [*piece, 0xFF]:
                yield (seen[::-1] + b"\xfd" * ctw.DEPTH)[: ctw.DEPTH], symbol
                seen += bytes([symbol])
            before = piece[-1:]

    def split(self, context, bit, prefix):
        return self.n[context, bit + 1, prefix * 2], self.n[context, bit + 1, prefix * 2 + 1]

    def weighted(self, context, bit, prefix):
        """(log weight, share of the own estimate)"""
        key = context, bit, prefix
        if key not in self.memo:
            a, b = self.split(*key)
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(context) == ctw.DEPTH:
                self.memo[key] = own, 1.0
            else:
                below = sum(self.weighted(c, bit, prefix)[0] for c in self.kids.get(context, ()))
                both = np.logaddexp(own, below) - math.log(2)
                self.memo[key] = both, math.exp(own - math.log(2) - both)
        return self.memo[key]

    def log10(self, context, symbol):
        total = 0.0
        for bit in range(8):
            prefix, p = symbol >> (8 - bit), 0.5
            for d in range(ctw.DEPTH, -1, -1):
                zero, one = self.split(context[:d], bit, prefix)
                share = self.weighted(context[:d], bit, prefix)[1]
                p = share * (one + 0.5) / (zero + one + 1) + (1 - share) * p
            total += math.log10(p if symbol >> (7 - bit) & 1 else 1 - p)
        return total

    def score(self, text):
        return sum(self.log10(c, s) for c, s in self.events(text))


def test_scores_are_those_of_the_recursive_tree(spark):
    train = [b"abracadabra  abra\n\n\n\n\ncad", b"abrab cab abracadabra", b"", b" x" * 5 + b"y" * 70, "ä中 ab\tab".encode()]
    held = [b"abra abracab new", b"zz", b"", b"\t\t", b"cab " + b"q" * 33]
    model = Plain(train)
    rows = [(i, t.decode(), i < len(train)) for i, t in enumerate(train + held)]
    for head in (1000, 3, 0):
        got = {r["doc_id"]: r["score"] for r in ctw.score(spark.createDataFrame(rows, DOC + ", learn boolean"), F.col("learn"), head_items=head).collect()}
        for i, text in enumerate(train + held):
            assert got[i] == pytest.approx(model.score(text), rel=1e-9)


def test_query_against_the_recursive_tree(spark, sf_dir, tmp_path):
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = whole.orderBy(F.length("text"), "doc_id").limit(40).select("doc_id", "text").collect()  # the plain tree is slow
    spark.createDataFrame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    model = Plain([(r["text"] or "").encode().lower() for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 10])
    got = {r["doc_id"]: r["score"] for r in op7_ctw(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["doc_id"]] == pytest.approx(model.score((r["text"] or "").encode().lower()), rel=1e-9)


def test_probabilities_sum_to_one():
    items = ctw.units(b"abra cadabra ab")
    key, _ = ctw.cells(items * 3)
    context = key[5] >> np.uint64(8) << np.uint64(8)
    asked = np.array([context | np.uint64(s) for s in range(256)])
    keys, at = np.unique(np.concatenate([key, asked]), return_inverse=True)
    tree = ctw.Subtree(keys, np.bincount(at, np.append(np.ones(len(key)), np.zeros(256))))
    found = [tree.decision(bit) for bit in range(8)]
    top = ctw.Top(*(np.concatenate(x) for x in zip(*[t for _, t in found], strict=True)))
    p = 10 ** top.log10(keys, np.stack([d for d, _ in found], 1))
    assert p[np.isin(keys, asked)].sum() == pytest.approx(1)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.0, 1e3, 1e9])
    assert np.allclose(ctw._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def test_base_score_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    split = lambda t: (t or "").encode().lower().split()
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 10]
    count = Counter(w for r in train for w in split(r["text"]))
    count[None] = len(train)
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in op7_ctw(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        tokens = [*split(r["text"]), None]
        want = sum(math.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        g = got[r["doc_id"]]
        assert g["base_score"] == pytest.approx(want, rel=1e-9)
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(tokens), sum(w in count for w in tokens), n)
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert g["score"] < 0


def test_rare_items_meet_their_scores_in_a_join(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 7} only{i}") for i in range(60)], DOC)
    full, small = ({r["doc_id"]: r for r in ctw.score(docs, F.col("doc_id") % 3 > 0, head_items=h).collect()} for h in (1000, 1))
    for i in full:
        assert full[i]["base_score"] == pytest.approx(small[i]["base_score"])
        assert full[i]["score"] == pytest.approx(small[i]["score"])
        assert full[i]["n_known"] == small[i]["n_known"] == 3 + (i % 3 > 0)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "A\tB"), (4, "xy " * 400000)], DOC).withColumn("score", F.lit("x")).withColumn("word", F.lit("y")).withColumn("learn", F.lit("z"))
    got = sorted(((r["doc_id"] or 0, r["n_tokens"], r["score"]) for r in ctw.score(docs, F.lit(True)).collect()), key=str)
    assert [r[1] for r in got] == [3, 1, 1, 3, 3, 400001]
    assert got[1][2] == pytest.approx(got[2][2]) and got[3][2] == pytest.approx(got[4][2])
    untrained = ctw.score(docs.where("doc_id = 3"), F.lit(None).cast("boolean")).collect()
    assert [(r["n_known"], r["train_tokens"]) for r in untrained] == [(0, 0)] * 2
    # Three bytes, a stop after each of two pieces, and the end: six symbols of eight decisions.
    assert untrained[0]["score"] == pytest.approx(6 * 8 * math.log10(0.5), rel=1e-5)
    assert ctw.score(docs.where(F.lit(False)), F.lit(True)).collect() == []
