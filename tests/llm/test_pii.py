import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larmor.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: [c for c in s if c in "0123456789"]
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(d := digits(m[0])) <= 19 and pii.luhn("".join(d))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15],
    }


FINDER = pii.Finder()


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.@+-%_ 0123456789()\né", max_size=60))
def test_random_texts_match_the_grammars(text):
    found = FINDER.spans(text)
    assert {k: found[k] for k in pii.BASE} == brute(text)


@pytest.mark.parametrize(
    "text",
    [
        "a@b.c@d.e x@y..z a.b+c@d-e.f. q@w", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 5",
        "+1 (212) 555-0100. +12 +1234567890123456 ++1 2 3 4 5 6 7 8 9", "é" * 50 + "x@y.zz" + "İ" + "k@l.mn", "",
    ],
)
def test_edges_match_the_grammars(text):
    found = FINDER.spans(text)
    assert {k: found[k] for k in pii.BASE} == brute(text)


def test_cued_kinds():
    text = "IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678; ftp://joe:pw@host.net/x mailto:ann https://plain.example/ tel:+4912345"
    got = {k: [text[a:b] for a, b in v] for k, v in FINDER.spans(text).items()}
    assert got["account"] == ["DE89 3704 0044 0532 0130 00", "12345678"]
    assert got["address"] == ["ftp://joe:pw@host.net/x", "mailto:ann", "tel:+4912345"]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    for row in pii.digests(docs).collect():
        want = brute(texts[row["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k in pii.BASE for a, b in want[k])
        assert row["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.BASE] == [len(want[k]) for k in pii.BASE]
        assert set(filter(None, text.split(","))) <= set(row["spans"].split(","))


def test_nulls_repeats_long_and_extra_columns(spark):
    rows = [(1, None, "x"), (None, "a@b.cc", "y"), (1, "", "z"), (2, "a@b.cc " * 20000, "w"), (2, "a@b.cc", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find(docs)
    assert sorted((r["doc_id"] is None, len(r["spans"])) for r in got.collect()) == [(False, 0), (False, 0), (False, 1), (False, 20000), (True, 1)]
    assert pii.find(docs.where(F.lit(False))).collect() == []


def test_addresses_in_linear_time():
    import time

    from larmor.llm.pii import Finder

    finder, began = Finder(), time.perf_counter()
    for text in ("http://" * 150_000, "see http://" + "." * 1_000_000, "tel: " * 200_000, "mailto:)" * 130_000, "http://a@" * 120_000):
        finder.spans(text)
    assert time.perf_counter() - began < 30
    assert finder.spans("x http://me@host.org/p, tel:+123. (mailto:a@b.cd) http://host/@ http://http://u@h!")["address"] == [(2, 22), (24, 32), (35, 48), (71, 81)]
