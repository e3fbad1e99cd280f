"""Operator 13: chat formatting from an event log.

A log has one row for each event: `conv_id, seq, kind, message, role, text`. Events are dealt out by
conversation and folded in the order of `seq`, with windows and aggregations only:

    message      begins a message of a role, with its first text
    delta        appends text to its message
    edit         replaces the text that its message has so far
    regenerate   empties its message and discards every message begun between that one and this event

Each message's text is what follows the last event that (re)started it. The messages are rendered by a
template: marks around each turn, and a backslash put inside every control string (and after every
backslash) of a role or text, so that a rendered text holds no mark but the template's own, and can be
read back exactly. The loss mask is a list of spans of code points over the texts of assistants.

Rows: a null text or role is an empty one; null conversations are one conversation. A message is told by
`message`, any value that can be compared; an event whose message was not begun begins it; events of other kinds are
ignored; a message that was discarded stays so. In `turn_log`, each row is a message, a repeated row too;
null turns come first, equal turns are ordered by a hash of role and text, then by their place in the table.
A conversation is one row of the result, and so is its text: 2 GB at most. Other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template: role between HEAD and MIDDLE, text between MIDDLE and TAIL.
HEAD, MIDDLE, TAIL = "<s>[INST] ", " [/INST] ", "</s>\n"
#: What begins a control string <s>, </s>, [INST] or [/INST], or is the escape itself.
MARKS = r"(\\|<(?=/?s>)|\[(?=/?INST\]))"
RESTARTS = ("message", "edit", "regenerate")
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_log(conversations: DataFrame) -> DataFrame:
    """The log of a table `conv_id, turn, role, text`: each row a message, streamed line by line."""
    row = F.struct(F.col("turn").alias("turn"), F.xxhash64("role", "text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    rows = conversations.select("conv_id", F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), row.alias("message"))
    rows = rows.select("conv_id", "role", "message", F.posexplode(F.split("text", r"(?<=\n)")).alias("k", "text"))
    first = F.col("k") == 0
    return rows.select("conv_id", F.struct("message", "k").alias("seq"), F.when(first, "message").otherwise("delta").alias("kind"), "message", F.when(first, F.col("role")).alias("role"), "text")


def messages(log: DataFrame) -> DataFrame:
    """conv_id, turn (from 0), role, text: what a log comes to. One shuffle, by conversation."""
    log = log.select("conv_id", "seq", "kind", "message", "role", "text").filter(F.col("kind").isin("delta", *RESTARTS))
    restart = F.max(F.when(F.col("kind").isin(*RESTARTS), F.col("seq")))
    each = log.repartition("conv_id").groupBy("conv_id", "message").agg(
        F.min("seq").alias("start"), F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"), restart.alias("restart"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("redone"), F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("parts"),
    )
    live = F.filter("parts", lambda p: F.col("restart").isNull() | (p["seq"] >= F.col("restart")))
    whole = each.select("conv_id", "start", "message", "redone", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(live, lambda p: p["text"]), "").alias("text"))
    w = Window.partitionBy("conv_id").orderBy("start", "message")
    kept = whole.withColumn("cut", F.max("redone").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter("cut IS NULL OR cut < start")
    return kept.select("conv_id", (F.row_number().over(w) - 1).alias("turn"), "role", "text")


def rendered(turns: DataFrame, learned: str = LEARNED) -> DataFrame:
    """conv_id, n_turns, formatted, loss: one row a conversation of `conv_id, turn, role, text`.

    `loss` lists the spans that are learned from: `turn`, where that turn begins (`at`), and the span's `begin` and `end`,
    all counted in code points of `formatted`.
    """
    size = lambda c: F.char_length(c).cast("long")
    parts = turns.select("conv_id", "turn", (F.col("role") == learned).alias("learned"), escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"))
    parts = parts.select("conv_id", "turn", "learned", size("text").alias("n"), (size("role") + len(HEAD) + len(MIDDLE)).alias("lead"), F.concat(F.lit(HEAD), "role", F.lit(MIDDLE), "text", F.lit(TAIL)).alias("piece"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("at", F.coalesce(F.sum(F.col("lead") + F.col("n") + len(TAIL)).over(w), F.lit(0).cast("long")))
    begin = F.col("at") + F.col("lead")
    span = F.when(F.col("learned"), F.struct("turn", "at", begin.alias("begin"), (begin + F.col("n")).alias("end")))
    whole = parts.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "piece"))).alias("pieces"), F.sort_array(F.collect_list(span)).alias("loss"))
    return whole.select("conv_id", "n_turns", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text of each), learned (the texts under the loss mask), formatted_chars, from `formatted` and `loss` alone."""
    split = formatted.select("conv_id", "loss", F.char_length("formatted").cast("long").alias("formatted_chars"), F.split("formatted", TAIL).alias("p"))
    pieces = F.slice("p", F.lit(1), F.size("p") - 1)  # nothing follows the last mark

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, MIDDLE, 1)
        return F.struct(unescaped(F.substr(role, F.lit(len(HEAD) + 1))).alias("role"), unescaped(F.substr(piece, F.char_length(role) + len(MIDDLE) + 1)).alias("text"))

    def under(s: Column) -> Column:
        return unescaped(F.substr(F.get("p", s["turn"]), (s["begin"] - s["at"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))

    return split.select("conv_id", F.transform(pieces, turn).alias("turns"), F.transform("loss", under).alias("learned"), "formatted_chars")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the rendered text."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = read_back(formatted).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.array_join("learned", "").alias("learned"), "formatted_chars")
    return back.select("conv_id", "n_turns", "turns_sha256", F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")
