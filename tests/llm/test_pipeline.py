from pyspark.sql import functions as F

import corpus_pipeline as P
from larmor.llm import toxicity
from larmor.llm.common import crc32_of, materialize

from .test_decontaminate import brute as brute_contamination
from .test_linededup import brute as brute_lines
from .test_mixing import targets


def test_each_stage_against_its_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    given = {r["doc_id"]: r for r in docs.collect()}
    seen = {}
    for name, stage in P.STAGES:
        seen[name] = materialize(stage(spark, docs, sf_dir), "test-stage")
        if name != "mixing":
            assert seen[name].columns == columns
            docs = seen[name]
    rows = {name: {r["doc_id"]: r for r in df.collect()} for name, df in seen.items()}

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc32_of("doc_id") % 5 != 0)
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    predicted = {r["doc_id"] for r in toxicity.score(whole, toxicity.fit(whole, labels)).where("predicted = 0").collect()}
    assert rows["toxicity"].keys() == predicted
    assert all(rows["toxicity"][d] == given[d] for d in predicted)

    want = brute_lines([(d, r["text"]) for d, r in rows["toxicity"].items()])
    got = rows["line_dedup"]
    assert got.keys() == want.keys()
    assert sum(got[d]["text"] != want[d] for d in want) <= 0.02 * len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())

    import numpy as np

    from larmor.llm.simhash import fingerprint

    ids = sorted(got)
    fp = np.array([fingerprint((got[d]["text"] or "").encode()) for d in ids], np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp[i + 1 :]) <= 3) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    assert rows["simhash_near_dedup"].keys() == {ids[i] for i in range(len(ids)) if find(i) == i}

    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    judged = brute_contamination([(d, r["text"]) for d, r in rows["simhash_near_dedup"].items()], items)
    assert rows["decontamination"].keys() == {d for d, v in judged.items() if not v[3]}

    sizes = {}
    for d, r in rows["decontamination"].items():
        sizes[r["source"]] = sizes.get(r["source"], 0) + rows["mixing"][d]["size"]
    goal = targets(sizes)
    for d, r in rows["decontamination"].items():
        assert abs(rows["mixing"][d]["target"] - goal[r["source"]]) < 1e-6


def test_extra_columns_nulls_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).withColumn("score", F.lit("x")).withColumn("h", F.lit(1))
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit(None).cast("string"))
    both = materialize(docs.unionByName(odd), "odd")
    for name, stage in P.STAGES[:4]:
        got = stage(spark, both, sf_dir)
        assert got.columns == both.columns
        # Three rows alike without an id or a text: near duplicates of each other, and of nothing else here.
        assert got.where("doc_id is null").count() == (1 if name == "simhash_near_dedup" else 3)
        assert stage(spark, both.where(F.lit(False)), sf_dir).count() == 0
    assert P.STAGES[4][1](spark, both, sf_dir).count() == 43


def test_rows_without_an_id_and_repeated_ids(spark, sf_dir):
    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    clean = [f"word{i} of a text that nobody else has written {i * 7} times over {i}" * 3 for i in range(4)]
    rows = [(None, passage), (None, clean[0]), (5, clean[1]), (5, passage), (6, clean[2]), (None, clean[2]), (7, clean[2]), (5, clean[3]), (5, clean[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted([tuple(r) for r in P.drop_contaminated(spark, docs, sf_dir).collect()], key=str)
    assert left == sorted([r for r in rows if r[1] != passage], key=str)
    kept = [tuple(r) for r in P.drop_near_duplicates(spark, docs, sf_dir).collect()]
    from larmor.llm.simhash import fingerprint

    prints = [fingerprint(r[1].encode()) for r in kept]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
    assert all(any((fingerprint(r[1].encode()) ^ p).bit_count() <= 3 for p in prints) for r in rows)
    assert (6, clean[2]) in kept and (None, clean[2]) not in kept
