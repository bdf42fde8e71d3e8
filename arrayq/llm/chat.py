"""Chat formatting by event-sourced reconstruction.

A log holds events (conv_id, seq, turn, kind, role, text): ``message`` begins a turn, ``delta`` appends to it,
``edit`` replaces its text, ``regenerate`` empties it for the deltas that follow, ``delete`` removes it.  The log is partitioned by
conversation, once for all steps; there each turn's events are sorted by seq and folded into the final message; the messages of a conversation, by turn, are
rendered as ``<s>[INST] role [/INST]text</s>``.  Inside roles and texts a backslash is doubled, and the four control strings get a
backslash behind their first character, which unescape() takes away again.  Loss is on the texts of the assistant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"
TURN = r"(?s)<s>\[INST\] (.*?) \[/INST\](.*?)</s>"


def escape(c: Column) -> Column:
    c = F.regexp_replace(c, r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(c, r"<(/?s>)", r"<\\$1"), r"\[(/?INST\])", r"[\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def events(rows: DataFrame) -> DataFrame:
    """A log of whole messages from (conv_id, turn, role, text); repeated turns are messages of their own, in the order of role and text."""
    order = F.expr("row_number() over (partition by conv_id, turn order by role, text)")
    return rows.repartition("conv_id").select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text", order.cast("long").alias("copy"))


def streamed(log: DataFrame) -> DataFrame:
    """The log in which each whole message of log has come about by several events, in one of four ways by its place and text.

    Deltas after its beginning; a draft, a delta and an edit; a draft that is regenerated; a draft that is deleted and begun again.
    """
    text = F.coalesce("text", F.lit(""))
    third = F.expr("int(ceil(length(coalesce(text, '')) / 3))")
    pieces = [F.substring(text, F.lit(1), third), F.substring(text, third + 1, third), F.substring(text, 2 * third + 1, third)]
    draft = F.concat(F.lit("draft "), text)
    ways = [
        [("message", pieces[0]), ("delta", pieces[1]), ("delta", pieces[2])],
        [("message", draft), ("delta", pieces[2]), ("edit", text)],
        [("message", draft), ("regenerate", F.lit("")), ("delta", pieces[0]), ("delta", pieces[1]), ("delta", pieces[2])],
        [("message", draft), ("delete", F.lit("")), ("message", pieces[0]), ("delta", pieces[1]), ("delta", pieces[2])],
    ]
    event = lambda k, kind, t: F.struct(F.lit(k).cast("long").alias("seq"), F.lit(kind).alias("kind"), t.alias("text"))
    made = [F.array(*(event(k, *e) for k, e in enumerate(w))) for w in ways]
    way = F.crc32(F.concat_ws(" ", "conv_id", "turn", "copy", "text")) % len(ways)
    chosen = F.when(way == 0, made[0]).when(way == 1, made[1]).when(way == 2, made[2]).otherwise(made[3])
    one = log.where("kind = 'message'").select("conv_id", "turn", "copy", "role", F.col("seq").alias("begin"), F.explode(chosen).alias("e"))
    return one.select("conv_id", "turn", (F.col("begin") + F.col("e.seq")).alias("seq"), "e.kind", "role", "e.text", "copy")


def folded(log: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, role, text): final messages of log(conv_id, turn, copy, seq, kind, role, text).

    Null texts are empty, null roles stay as the turn's first role or empty.  Events of equal seq are taken by kind and text.  Deltas of
    a turn that nothing began begin it.  Null conv_ids are one conversation, null turns come first.
    """
    event = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = log.groupBy("conv_id", "turn", "copy").agg(F.array_sort(F.collect_list(event)).alias("events"))
    zero = F.struct(F.lit("").alias("role"), F.lit("").alias("text"), F.lit(True).alias("there"))

    def step(state: Column, e: Column) -> Column:
        text = F.when(e["kind"] == "delta", F.concat(state["text"], e["text"])).when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])
        return F.struct(F.when(state["role"] == "", e["role"]).otherwise(state["role"]).alias("role"), text.alias("text"), (e["kind"] != "delete").alias("there"))

    final = F.aggregate("events", zero, step)
    return grouped.select("conv_id", "turn", "copy", final.alias("m")).where("m.there").select("conv_id", "turn", "copy", "m.role", "m.text")


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): the text of each conversation and its loss mask, spans [begin, end) in code points.

    A conversation is one cell of the result, so its messages are brought together, already rendered; a running sum over them gives their places.
    Null roles count as empty and null texts too; null conv_ids make one conversation; messages of one turn come by copy, and equal ones stay both.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit("<s>[INST] "), escape(role), F.lit(" [/INST]"))
    parts = messages.select("conv_id", "turn", "copy", F.concat(head, escape(text), F.lit("</s>")).alias("s"), F.length(head).alias("head"), (role == LOSS_ROLE).alias("loss"))
    before = F.sum(F.length("s")).over(Window.partitionBy("conv_id").orderBy("turn", "copy").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("begin", F.coalesce(before, F.lit(0)))
    span = F.when(F.col("loss"), F.struct((F.col("begin") + F.col("head")).cast("int").alias("begin"), (F.col("begin") + F.length("s") - 4).cast("int").alias("end")))
    parts = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("begin", "s", span.alias("span")))).alias("p"))
    return parts.select("conv_id", F.concat_ws("", F.transform("p", lambda x: x["s"])).alias("formatted"), F.filter(F.transform("p", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss"))


def digest(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted(conv_id, formatted, loss); no rows give no rows."""
    roles, texts = (F.transform(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(k)), unescape) for k in (1, 2))
    turns = F.zip_with(roles, texts, lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n")))
    lost = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["begin"] + 1, x["end"] - x["begin"])))
    return formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"), F.concat_ws("", lost).alias("lost")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.concat_ws("", "turns"), 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars"
    )
