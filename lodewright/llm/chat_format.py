"""Chat formatting by event-sourced reconstruction (operator 5).

A conversation arrives as a log of events.  The log is partitioned by conversation and
message, sorted by sequence number and folded: ``delta`` appends text, ``edit`` replaces the
message's text, ``regenerate`` empties it for what follows.  The folded messages are rendered
with a template whose control strings are escaped inside texts in a reversible way.

Template, for each message: ``<s>[INST]role[/INST]text</s>``.  Inside a role or text, every
control string gets one more ``~`` after its first character (``<s>`` becomes ``<~s>``,
``<~s>`` becomes ``<~~s>``); taking one away again gives the original.

Scale: deltas are folded per (conversation, message) first; only then do the messages of one
conversation meet, since its rendering is one value.  Two shuffles, of which the second moves
folded messages.  A conversation's messages are one row by contract.

Defined results: null text and null role are empty; very long texts and logs are taken whole; a null sequence sorts first; events of
equal sequence sort by kind, role and text; a null conversation id is a conversation; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings are <s>, </s>, [INST] and [/INST].
BEGIN, ROLE_OPEN, ROLE_CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"(?:<~*/?s>|\[~*/?INST\])"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?:(<)(~*/?s>)|(\[)(~*/?INST\]))", "$1$3~$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?:(<)~(~*/?s>)|(\[)~(~*/?INST\]))", "$1$3$2$4")


def fold(events: DataFrame) -> DataFrame:
    """Messages (conv_id, message, role, text) from events (conv_id, message, seq, kind, role, text).

    The last event that sets a text (an edit, a regeneration) starts it; later deltas extend it.  The
    role is the last one named.  A log is read a fixed number of times, so the work is linear in it.
    """
    event = F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    logs = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"))
    sets = F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i + 1).otherwise(F.lit(1)))
    live = F.slice("log", F.array_max(sets), F.size("log"))
    parts = F.transform(live, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"]))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    role = F.coalesce(F.get(roles, F.size(roles) - 1), F.lit(""))
    return logs.select("conv_id", "message", role.alias("role"), F.array_join(parts, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans): spans are (start from 0, length) in code points of ``formatted``.

    A message's place comes from a running sum over its conversation, which the rendering needs together anyway.
    """
    shown = messages.select("conv_id", "message", "role", "text", escape(F.col("role")).alias("__role"), escape(F.col("text")).alias("body"))
    shown = shown.withColumn("head", F.concat(F.lit(BEGIN + ROLE_OPEN), "__role", F.lit(ROLE_CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("message", "role", "text")
    size = F.length("head") + F.length("body") + len(END)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.struct((before + F.length("head")).cast("int").alias("start"), F.length("body").alias("length"))
    shown = shown.select("conv_id", F.row_number().over(order).alias("n"), F.concat("head", "body", F.lit(END)).alias("shown"), F.when(F.col("role") == TRAINED_ROLE, span).alias("span"))
    turns = F.sort_array(F.collect_list(F.struct("n", "shown", "span")))
    convs = shown.groupBy("conv_id").agg(turns.alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda x: x.isNotNull())
    formatted = F.array_join(F.transform("turns", lambda t: t["shown"]), "")
    return convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, as an array of (role, text), by reading the template back."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(BEGIN + ROLE_OPEN) + 1), F.length(p))
        cut = F.locate(ROLE_CLOSE, body)
        return F.struct(
            unescape(F.substring(body, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(body, cut + len(ROLE_CLOSE), F.length(body))).alias("text"),
        )

    return F.transform(pieces, turn)


def masked(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """Finished turns as a log: each row of the table is a message of one delta.

    Rows that share a turn are messages of their own; their order is that of turn, role and text.
    """
    message = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"), "row")
    numbered = conversations.withColumn("row", F.monotonically_increasing_id())
    return numbered.select("conv_id", message.alias("message"), F.lit(0).alias("seq"), F.lit("delta").alias("kind"), "role", "text")


def drafted(events: DataFrame) -> DataFrame:
    """The same messages by longer logs, from events of one delta each.

    Each message is drafted and regenerated, streamed in part, edited to its first half, and streamed to its end.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.coalesce("text", F.lit(""))
    step = lambda seq, kind, said: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), F.when(F.lit(seq == 0), F.col("role")).alias("role"), said.alias("text"))
    steps = F.array(
        step(0, "delta", F.lit("draft ")),
        step(1, "regenerate", F.lit(None).cast("string")),
        step(2, "delta", F.substring(text, F.lit(1), F.floor(half / 2).cast("int"))),
        step(3, "edit", F.substring(text, F.lit(1), half)),
        step(4, "delta", F.substring(text, half + 1, F.length(text))),
    )
    return events.select("conv_id", "message", F.col("role"), text.alias("text")).select("conv_id", "message", F.explode(steps).alias("e")).select("conv_id", "message", "e.*")
