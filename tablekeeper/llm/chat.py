"""Chat formatting from event logs, with DataFrame functions only.

A log has one row per event: conv_id, seq, message, kind, role, text.  Events
of a message are folded in order of seq:

* ``message`` sets its role and text,
* ``delta`` appends streamed text,
* ``edit`` replaces the text (a null role keeps the role),
* ``regenerate`` clears the text for the deltas that follow,
* ``delete`` takes the message out, until a later ``message`` or ``edit``.

The final messages of a conversation, in order of ``message``, are rendered as
``<s>role[INST]text[/INST]</s>``.  Control strings inside roles and texts are
escaped: a backslash becomes two, and each control string gets one after its
first character; reading takes the backslashes out again.  The loss mask lists
the places of the assistant's texts in the formatted text, in code points.

Messages are folded by (conv_id, message), so a long conversation is split
there; only rendering, which makes one text, brings a conversation together in
one row.

Nulls and odd rows: null texts and roles are empty; unknown kinds count as
``message``; events without a seq come first; events of equal seq follow the
order of kind, role and text; a null conv_id is a conversation of its own;
empty logs give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: fixed values: the template's control strings
TURN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_INSIDE_CONTROL = r"(?<=<)(?=/?s>)|(?<=\[)(?=/?INST\])"
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), _INSIDE_CONTROL, r"\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, message, role, text.

    A message's text is that of its last event that is no delta, with the deltas
    after it; so its log is looked through for three places and cut once.
    """
    e = F.struct(F.col("seq"), F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"),
                 F.coalesce("text", F.lit("")).alias("text"), F.col("role").isNotNull().alias("named"))
    log = events.select("conv_id", "message", e.alias("e")).groupBy("conv_id", "message").agg(F.sort_array(F.collect_list("e")).alias("log"))
    last = lambda holds: F.expr(f"array_max(transform(log, (x, i) -> IF({holds}, i, -1)))")
    placed = log.select("conv_id", "message", "log", last("x.kind <> 'delta'").alias("reset"), last("x.named AND x.kind <> 'delete'").alias("named"),
                        last("x.kind NOT IN ('delta', 'regenerate')").alias("stands"))
    at = lambda i, field: F.expr(f"IF({i} < 0, NULL, log[{i}].{field})")
    start = F.when(at("reset", "kind").isin("regenerate", "delete"), "").otherwise(F.coalesce(at("reset", "text"), F.lit("")))
    grown = F.array_join(F.expr("transform(slice(log, reset + 2, size(log)), x -> x.text)"), "")
    return placed.where(at("stands", "kind") != "delete").select(
        "conv_id", "message", F.coalesce(at("named", "role"), F.lit("")).alias("role"), F.concat(start, grown).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Per conversation: the formatted text and its loss mask (place of each turn and of its text; loss or not)."""
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(OPEN))
    body = escape(F.col("text"))
    turns = (messages.select("conv_id", "message", head.alias("head"), body.alias("body"), (F.col("role") == LOSS_ROLE).alias("loss"))
             .withColumn("size", F.length("head") + F.length("body") + len(CLOSE + END)))
    order = Window.partitionBy("conv_id").orderBy("message")
    at = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    place = F.struct(F.col("at").alias("turn"), (F.col("at") + F.length("head")).alias("start"),
                     (F.col("at") + F.length("head") + F.length("body")).alias("end"), F.col("loss"))
    turn = F.struct("message", F.concat("head", "body", F.lit(CLOSE + END)).alias("text"), place.alias("mask"))
    return (turns.withColumn("at", at).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
            .select("conv_id", F.array_join("t.text", "").alias("formatted"), F.col("t.mask").alias("loss_mask")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns (role, text) and the unescaped text under the loss mask, from formatted texts."""
    parts = F.split("formatted", END, -1)
    pieces = F.slice(parts, F.lit(1), F.size(parts) - 1)     # nothing follows the last END
    split_ = formatted.withColumn("pieces", pieces)
    turn = lambda p: F.struct(
        unescape(F.substr(F.substring_index(p, OPEN, 1), F.lit(len(TURN) + 1))).alias("role"),
        unescape(F.substring_index(F.substring_index(p, OPEN, -1), CLOSE, 1)).alias("text"))
    under = F.zip_with("pieces", "loss_mask", lambda p, m: F.when(m["loss"], unescape(
        F.substr(p, (m["start"] - m["turn"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))).otherwise(F.lit("")))
    return split_.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"),
                         F.array_join(under, "").alias("loss_text"))


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask of every conversation of an event log."""
    return render(fold(events))
