import math

import pytest
from pyspark.sql import functions as F

from larmor.llm import ctw
from larmor.llm.queries import op7_ctw

from .test_ctw import DOC, Plain


class Whole(Plain):
    """The recursive tree whose contexts are the last bytes of the text, not of a piece."""

    @staticmethod
    def events(text):
        seen = b"\xfe" * ctw.DEPTH + text
        for i, symbol in enumerate([*text, 0xFF]):
            yield seen[i : i + ctw.DEPTH][::-1], symbol


def test_contexts_reach_over_pieces(spark):
    train = [b"he and she and he and she", b"abracadabra  abra\n\n\n\n\ncad", b"", b" x" * 5 + b"y" * 70, "ä中 ab\tab".encode()]
    held = [b"he and she", b"she he and", b"", b"\t\t", b"cab " + b"q" * 33]
    model = Whole(train)
    rows = [(i, t.decode(), i < len(train)) for i, t in enumerate(train + held)]
    for head in (1000, 3, 0):
        got = {r["doc_id"]: r["score"] for r in ctw.score(spark.createDataFrame(rows, DOC + ", learn boolean"), F.col("learn"), head_items=head).collect()}
        for i, text in enumerate(train + held):
            assert got[i] == pytest.approx(model.score(text), rel=1e-9)


def test_query_against_the_tree_of_whole_contexts(spark, tmp_path):
    texts = ["One two\nthree", None, "", "two three  two three", "a" * 40 + " b"] * 4
    spark.createDataFrame(list(enumerate(texts)), DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op7_ctw(spark, str(tmp_path)).collect()}
    model = Whole([(t or "").lower().encode() for i, t in enumerate(texts) if not got[i]["held_out"]])
    for i, text in enumerate(texts):
        assert got[i]["score"] == pytest.approx(model.score((text or "").lower().encode()), rel=1e-9)


def test_symbols_are_the_bytes_and_the_end(spark):
    text = "a b  " + "c" * 70
    got = ctw.score(spark.createDataFrame([(1, text)], DOC), F.lit(False)).first()
    assert got["score"] == pytest.approx((len(text) + 1) * 8 * math.log10(0.5))
    assert len(ctw.cells(ctw.units(text.encode()))[0]) == len(text) + 1


def test_chunks_parts_and_rounds_change_no_score(spark, monkeypatch):
    texts = ["he and she and he", "", "abracadabra  abra\n\n", "x" * 90, "she and abra ä中", None] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).coalesce(2)
    whole = {r["doc_id"]: r for r in ctw.score(docs, F.col("doc_id") % 5 > 0).collect()}
    monkeypatch.setattr(ctw, "CHUNK", 40)
    monkeypatch.setattr(ctw, "PART", 3)
    monkeypatch.setattr(ctw, "ROUND", 100)
    small = {r["doc_id"]: r for r in ctw.score(docs, F.col("doc_id") % 5 > 0).collect()}
    assert len(whole) == len(small) == len(texts)
    for i, r in whole.items():
        assert small[i]["score"] == pytest.approx(r["score"], rel=1e-9)
        assert small[i]["base_score"] == pytest.approx(r["base_score"], rel=1e-9)
        assert (small[i]["n_tokens"], small[i]["n_known"]) == (r["n_tokens"], r["n_known"])


def test_a_chunk_sends_each_cell_once(spark):
    # A thousand copies of a text are a few rows of distinct cells, not a row for each symbol or unit.
    rows = [(i, "the same words over and over again", True) for i in range(1000)]
    docs = spark.createDataFrame(rows, DOC + ", learn boolean").coalesce(1).select("doc_id", F.col("text").cast("binary").alias("t"), "learn")
    asked = ctw.chunk_cells(ctw.pack(docs), 4, True).collect()
    assert len(asked) <= 4 and sum(r["k"] for r in asked) == 35
    assert sum(ctw._loose(r["n"], r["k"], int).sum() for r in asked) == 35_000
    assert ctw.score(docs.where(F.lit(False)).withColumnRenamed("t", "text"), F.lit(True)).collect() == []
