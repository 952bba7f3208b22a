import random

from pyspark.sql import functions as F

from larmor.llm import linededup as L

DOC = "doc_id long, text string"


def fold(line):
    return " ".join(line.lower().split())


def grams(line):
    return {line[i : i + 5] for i in range(len(line) - 4)}


def brute(docs, threshold=0.8):
    """Kept text of every document by comparing all pairs of distinct lines."""
    first, root = {}, {}
    for doc, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        for n, raw in enumerate((text or "").split("\n")):
            if (line := fold(raw)) and line not in first:
                first[line], root[line] = (doc, n), line

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lines, sets = list(first), {x: grams(x) for x in first}
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= threshold * max(len(x), len(y)) and len(x & y) >= threshold * len(x | y):
                root[find(b)] = find(a)
    order = lambda line: (first[line][0] is None, first[line][0] or 0, first[line][1])
    best = {}
    for x in lines:
        r = find(x)
        best[r] = min(best.get(r, x), x, key=order)
    kept = {first[x] for x in best.values()}
    return {d: None if t is None else "\n".join(raw for n, raw in enumerate(t.split("\n")) if not fold(raw) or (d, n) in kept) for d, t in docs}


def test_against_all_pairs(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    got = {r["doc_id"]: r for r in L.dedup(spark.createDataFrame(docs, DOC)).collect()}
    lines = sum(len(t.split("\n")) for t in want.values() if t is not None)
    wrong = [d for d in want if got[d]["text"] != want[d]]
    assert len(got) == len(docs)
    assert len(wrong) <= 0.01 * lines, wrong  # banding finds nearly all
    # A line is never dropped without a similar one: what brute force keeps is kept.
    for d, text in want.items():
        assert set((text or "").split("\n")) <= set((got[d]["text"] or "").split("\n"))


def test_recall_on_noisy_copies(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    docs, clean = [], []
    for i in range(60):
        line = " ".join(rng.choice(words) for _ in range(rng.randint(12, 60)))
        clean.append(line)
        for k in range(8):
            noisy = list(line)
            for _ in range(k * len(line) // 400):
                noisy[rng.randrange(len(noisy))] = rng.choice("xyz")
            docs.append((i * 100 + k, "".join(noisy)))
    want, got = brute(docs), {r["doc_id"]: r["text"] for r in L.dedup(spark.createDataFrame(docs, DOC)).collect()}
    removed = [d for d in want if not want[d]]
    assert len(removed) > 300
    assert sum(got[d] == want[d] for d in removed) >= 0.97 * len(removed)
    assert all(got[d] for d in want if want[d])


def test_edges(spark):
    rows = [(3, "Hello   World\n\n  \nab"), (1, "hello world\nAB\nab"), (2, None), (4, ""), (None, "hello world\nonly here"), (5, "new\nHELLO WORLD"), (5, "new\nHELLO WORLD"), (6, "z " * 30000)]
    docs = spark.createDataFrame(rows, DOC).withColumn("line", F.lit("x")).withColumn("n_kept", F.lit("y")).withColumn("d", F.lit(1))
    got = L.dedup(docs)
    assert set(got.columns) == set(docs.columns) | {"n_lines"}
    found = sorted(((r["doc_id"] or 0, r["text"], r["n_lines"], r["n_kept"]) for r in got.collect()), key=str)
    assert found == sorted([(3, "\n  ", 4, 2), (1, "hello world\nAB", 3, 2), (2, None, 0, 0), (4, "", 1, 1), (0, "only here", 2, 1), (5, "new", 2, 1), (5, "new", 2, 1), (6, "z " * 30000, 1, 1)], key=str)
    assert L.dedup(docs.where(F.lit(False))).collect() == []
