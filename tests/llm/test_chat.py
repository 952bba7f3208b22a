import hashlib

from pyspark.sql import functions as F

from larmor.llm import chat

MESSAGE = "conv_id long, turn long, role string, text string"
EVENT = "conv_id long, turn long, seq long, kind string, role string, text string"


def folded(spark, rows):
    return [tuple(r) for r in chat.fold_events(spark.createDataFrame(rows, EVENT)).orderBy("conv_id", "turn").collect()]


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 0, 1, "message", "user", "helo"), (1, 1, 2, "delta", "assistant", "Hi "), (1, 1, 3, "delta", None, "there"),
        (1, 0, 4, "edit", None, "hello"), (1, 2, 5, "message", "user", "more"), (1, 3, 6, "message", "assistant", "gone"),
        (1, 1, 7, "regenerate", None, ""), (1, 1, 8, "delta", None, "Hey"), (1, 2, 9, "message", "user", "again"),
        (2, 0, 1, None, "user", None), (None, 0, 1, "message", "user", "x"),
    ]
    want = [(None, 0, "user", "x"), (1, 0, "user", "hello"), (1, 1, "assistant", "Hey"), (1, 2, "user", "again"), (2, 0, "user", "")]
    assert folded(spark, rows) == want
    assert folded(spark, rows[::-1]) == want


def test_folding_like_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = [(c, rng.randrange(5), s, rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b|", ""])) for c in range(20) for s in range(40)]
    want = []
    for c in range(20):
        turns = {}
        for _, t, _, kind, role, text in [r for r in rows if r[0] == c]:
            if kind == "regenerate":
                turns = {k: v for k, v in turns.items() if k <= t}
            old_role, old = turns.get(t, (None, ""))
            turns[t] = (role or old_role, old + text if kind == "delta" else text)
        want += [(c, t, *turns[t]) for t in sorted(turns)]
    assert folded(spark, rows) == want


def test_round_trip_and_mask(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "%3C|", "%25", "<%7C", "", None, "a\nb", "<<||>>", "é" * 30000, "%0A"]
    rows = [(1, i, ["user", "assistant", "a\n<|b", None][i % 4], t) for i, t in enumerate(nasty * 20)] + [(2, 0, "assistant", None)]
    rows += [(3, None, "user", "n"), (3, 1, "assistant", "t"), (3, 1, "assistant", "t"), (3, -70, "user", "neg")]
    frame = spark.createDataFrame(rows, MESSAGE).withColumn("part", F.lit(9)).withColumn("formatted", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.digests(chat.render(frame)).collect()}
    whole = {r["conv_id"]: r["formatted"] for r in chat.conversations(chat.render(frame)).collect()}
    for conv in (1, 2, 3):
        mine = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        lines = "".join(f"{role}\n{text}\n" for _, _, role, text in mine)
        loss = "".join(text for _, _, role, text in mine if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (len(mine), len(loss), len(whole[conv]))
        assert r["turns_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert whole[conv].count("<|im_start|>") == len(mine) == whole[conv].count("<|im_end|>")
    assert whole[2] == "<|im_start|>assistant\n<|im_end|>\n"


def test_log_folds_to_its_messages(spark):
    rows = [(1, 0, "user", "héllo"), (1, 1, "assistant", "ab"), (1, 1, "assistant", "ab"), (1, 1, "user", None), (1, 2, None, "x"), (1, 70, "assistant", ""), (1, 200, "user", "z"), (1, None, "assistant", "n"), (None, 3, "user", "q")]
    log = chat.event_log(spark.createDataFrame(rows, MESSAGE).withColumn("seq", F.lit("clash")))
    assert {r["kind"] for r in log.collect()} == {"message", "edit", "regenerate", "delta"}
    got = sorted([tuple(r) for r in chat.fold_events(log, message="message").collect()], key=str)
    assert got == sorted([(c, t, r, x or "") for c, t, r, x in rows], key=str)


def test_query_keeps_rows_of_one_turn(spark, tmp_path):
    from larmor.llm.queries import op4_chat

    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, 1, "assistant", "c")]
    spark.createDataFrame(rows, MESSAGE).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in op4_chat(spark, str(tmp_path)).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 3 and got[-1]["n_turns"] == 2


def test_empty(spark):
    assert chat.fold_events(chat.event_log(spark.createDataFrame([], MESSAGE)), message="message").collect() == []
    none = spark.createDataFrame([], MESSAGE)
    assert chat.digests(chat.render(none)).collect() == []
    assert chat.fold_events(spark.createDataFrame([], EVENT)).collect() == []
