"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log of events is folded into final messages, and these are rendered with a template of control
strings and a loss mask.  Events are dealt out by conversation, turn and message and folded in order of their
sequence: ``message``, ``edit`` and ``regenerate`` start the message's text anew, ``delta`` adds to it, and
``regenerate`` also retracts all events of later turns that came before it.  A long conversation is rendered in
parts of ``PART_TURNS`` messages, so that no group grows with the conversation; only its finished parts
meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 64
START, END = "<|im_start|>", "<|im_end|>"
#: Replaced in this order when escaping, and back in the opposite order.
ESCAPES = (("%", "%25"), ("<|", "%3C|"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "%0A"))


def escape(text: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    """Control strings cannot occur in the result, and ``unescape`` gives the text back."""
    for plain, coded in escapes:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, coded in reversed(escapes):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def event_log(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", streamed: str = "assistant") -> DataFrame:
    """The log that such messages leave: ``conv_id, turn, message, seq, kind, role, text``; folding it gives them back.

    Every message begins as a draft.  One of the role ``streamed`` is then regenerated, which retracts the drafts
    of later turns, and streamed in two deltas; any other is sent with the first half of its text and edited.
    Messages of one turn, repeated rows too, are told apart by ``message``, their number by role and text.  Null
    texts are empty; null conversations, turns and roles stay.  No rows give no rows.
    """
    body, half = F.coalesce(F.col(text), F.lit("")), F.expr("int(length(__body) / 2)")
    m = messages.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), body.alias("__body"))
    m = m.withColumn("message", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "__body")))
    one, two = F.substring(F.col("__body"), F.lit(1), half), F.substring(F.col("__body"), half + 1, F.length("__body"))
    event = lambda seq, kind, said: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), said.alias("text"))
    draft = event(-1, "message", F.lit("draft"))
    stream = F.array(draft, event(0, "regenerate", F.lit("")), event(1, "delta", one), event(2, "delta", two))
    sent = F.array(draft, event(1, "message", one), event(2, "edit", F.col("__body")))
    logged = m.withColumn("e", F.explode(F.when(F.col("role") == streamed, stream).otherwise(sent)))
    return logged.select("conv_id", "turn", "message", "e.seq", "e.kind", "role", "e.text")


def fold_events(events: DataFrame, conv: str = "conv_id", turn: str = "turn", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text", message: str | None = None) -> DataFrame:
    """Events -> ``conv_id, turn, role, text`` of the messages that stand at the end of the log.

    A turn has one message, or one for each value of the column ``message``.  A null kind counts as ``message``, a
    null text as empty, and a message has the role of its last event that names one.  A delta before any message
    opens it.  Repeated events apply again: a repeated message changes nothing, a repeated delta adds its text
    twice.  Equal sequence numbers are applied in order of kind and text.  A null conversation is a conversation of
    its own, a null turn comes before all others.  No rows give no rows.
    """
    e = events.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), (F.col(message) if message else F.lit(0)).alias("message"), F.col(seq).alias("seq"),
        F.coalesce(F.col(kind), F.lit("message")).alias("kind"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    step = F.struct("seq", "kind", "text", "role")
    turns = e.groupBy("conv_id", "turn", "message").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    # What retracts a turn is the last regeneration of any turn before it.  It is found in parts of the conversation:
    # the maximum of the parts before, and inside the part that of the turns before.
    part = F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(-(1 << 62))).cast("long")
    cuts = e.groupBy("conv_id", "turn").agg(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("cut")).withColumn("part", part)
    parts = cuts.groupBy("conv_id", "part").agg(F.max("cut").alias("cut"))
    before = F.max("cut").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("conv_id").alias("pc"), F.col("part").alias("pp"), before.alias("earlier"))
    inside = F.max("cut").over(Window.partitionBy("conv_id", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    cuts = cuts.withColumn("inside", inside).join(parts, F.col("conv_id").eqNullSafe(F.col("pc")) & (F.col("part") == F.col("pp")))
    cuts = cuts.select(F.col("conv_id").alias("of"), F.col("turn").alias("at"), F.greatest("inside", "earlier").alias("cut")).where("cut is not null")
    turns = turns.join(cuts, F.col("conv_id").eqNullSafe(F.col("of")) & F.col("turn").eqNullSafe(F.col("at")), "left")
    alive = F.filter("steps", lambda s: F.col("cut").isNull() | (s["seq"] > F.col("cut")))
    state = F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("role"))
    apply = lambda acc, s: F.struct(
        F.when(s["kind"] == "delta", F.concat(acc["text"], s["text"])).otherwise(s["text"]).alias("text"), F.coalesce(s["role"], acc["role"]).alias("role")
    )
    folded = turns.withColumn("alive", alive).where(F.size("alive") > 0).withColumn("final", F.aggregate("alive", state, apply))
    return folded.select("conv_id", "turn", "final.role", "final.text")


def render(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """Messages -> ``conv_id, part, formatted, n_turns, loss``: the template's text and its loss mask.

    ``loss`` holds (start, length) in code points of ``formatted`` of every text of ``loss_role``, in
    order.  Parts of a conversation, put together by number, are its whole text.  Messages are in order
    of turn (null first), then role and text; rows with the same turn are messages each.  Null roles and
    texts are empty.  Other columns are not read.
    """
    m = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), escape(F.coalesce(F.col(role), F.lit("")), ROLE_ESCAPES).alias("role"), escape(F.coalesce(F.col(text), F.lit(""))).alias("text")
    )
    # Turns are dealt out by their number, so that the rows of one conversation meet in many small groups.
    part = F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(-(1 << 62))).cast("long")
    grouped = m.withColumn("part", part).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    head = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"))
    line = lambda t: F.concat(head(t), t["text"], F.lit(END + "\n"))
    ends = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(line(t))).cast("long").alias("at"),
            F.when(
                t["role"] == escape(F.lit(loss_role), ROLE_ESCAPES),
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(head(t))).cast("long").alias("start"), F.length(t["text"]).cast("long").alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return grouped.select("conv_id", "part", F.array_join(F.transform("turns", line), "").alias("formatted"), F.size("turns").cast("long").alias("n_turns"), ends["spans"].alias("loss"))


def read_turns(rendered: DataFrame) -> DataFrame:
    """Parts -> ``conv_id, part, formatted, turns, masked``, parsed from the formatted text and the mask alone.

    ``turns`` holds (role, text) unescaped; ``masked`` the unescaped text under the mask, in order.
    """
    pieces = F.split("formatted", F.lit("<\\|im_start\\|>"))
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))

    def turn(piece: Column) -> Column:
        begin = F.locate("\n", piece)
        body = F.substring(piece, begin + 1, F.length(piece) - begin - len(END) - 1)
        return F.struct(unescape(F.substring(piece, F.lit(1), begin - 1), ROLE_ESCAPES).alias("role"), unescape(body).alias("text"))

    # Joined texts may be unescaped at once: no code starts in one and ends in the next.
    masked = F.array_join(F.transform("loss", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))), "")
    return rendered.select("conv_id", "part", "formatted", F.transform(pieces, turn).alias("turns"), unescape(masked).alias("masked"))


def conversations(rendered: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, n_turns``, parts put together in order."""
    parts = rendered.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "formatted"))).alias("p"), F.sum("n_turns").alias("n_turns"))
    return parts.select("conv_id", F.array_join(F.col("p.formatted"), "").alias("formatted"), "n_turns")


def digests(rendered: DataFrame) -> DataFrame:
    """Per conversation: number of turns, digests of turns and of masked text, lengths; all read back."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read_turns(rendered).select("conv_id", "part", F.size("turns").alias("n"), lines.alias("lines"), "masked", F.length("formatted").alias("chars"))
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("part", "lines", "masked"))).alias("p")
    )
    masked = F.array_join(F.col("p.masked"), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("p.lines"), ""), 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), "formatted_chars",
    )

