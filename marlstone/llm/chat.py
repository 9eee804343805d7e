"""Chat formatting from event logs, with DataFrame functions only.

A log has one row per event: conversation, sequence number, message, kind, role, text.
Kinds: ``start`` opens a message, ``delta`` appends text, ``edit`` replaces the text so
far, ``regenerate`` empties it (deltas follow), ``delete`` removes the message. Events are
partitioned by conversation, sorted by sequence and folded into final messages, which are
then rendered.

The rendered form of a message is ``<|role|>text<|end|>``. In roles and texts ``&`` is
written ``&amp;``, ``<`` ``&lt;`` and ``|`` ``&#124;``, so no text can hold a marker, and
unescaping gives it back exactly. ``loss`` marks the assistants' texts by (start, length)
in code points of the rendered string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ("|", "&#124;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("|", "&#124;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, role, text) of a log (conv_id, seq, msg, kind, role, text).

    A conversation's events apply in the order of (seq, kind, text); null text is empty, a
    null kind counts as ``delta``, unknown kinds change nothing. What an event leaves of a
    message: ``start``, ``regenerate`` and ``delete`` nothing, ``edit`` its own text,
    ``delta`` the text so far and its own. So the last of the first four decides, and the
    deltas after it follow: one pass over the sorted events, each looked at once. The last
    role that is given stays. Repeated events apply as often as they stand. Null
    conversations and messages are groups of their own. Extra columns are ignored.
    """
    events = log.select("conv_id", "msg", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role")
    ordered = events.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "kind", "text", "role")))
    resets = F.col("kind").isin("start", "edit", "regenerate", "delete")
    own = Window.partitionBy("conv_id", "msg")
    ordered = ordered.withColumn("reset", F.coalesce(F.max(F.when(resets, F.col("place"))).over(own), F.lit(0)))
    said = (F.col("place") >= F.col("reset")) & F.col("kind").isin("delta", "edit", "start")
    parts = F.array_sort(F.collect_list(F.when(said, F.struct("place", "text"))))
    out = ordered.groupBy("conv_id", "msg").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("place"))).alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
        F.max_by("kind", F.when(F.col("place") == F.col("reset"), F.col("place"))).alias("last"),
    )
    return out.where("last is null or last <> 'delete'").drop("last")


def turn_events(turns: DataFrame) -> DataFrame:
    """The log of plain turns (conv_id, turn, role, text), as an assistant's screen streams them.

    Each turn opens a message, streams a draft that is regenerated, streams the first half of
    the text, edits it to what it is, and streams the rest. Rows of equal turn are ordered by
    role, then text, nulls first; every row is a message.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    half = F.floor(F.length("text") / 2).cast("int")
    placed = turns.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), place.alias("msg")).withColumn("half", F.substring("text", F.lit(1), half))
    later = F.substring("text", half + 1, F.length("text"))
    steps = [("start", F.lit("")), ("delta", F.lit("draft ")), ("delta", F.lit("more")), ("regenerate", F.lit("")), ("delta", F.col("half")), ("edit", F.col("half")), ("delta", later)]
    log = F.array(*(F.struct((F.col("msg") * len(steps) + k).alias("seq"), F.lit(kind).alias("kind"), body.alias("body")) for k, (kind, body) in enumerate(steps)))
    return placed.select("conv_id", "msg", "role", F.explode(log).alias("e")).select("conv_id", "e.seq", "msg", "e.kind", "role", F.col("e.body").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of final messages; ``loss``: array of (start, length).

    A null role is empty. Messages of a conversation follow each other in the order of ``msg``.
    """
    head = F.concat(F.lit(OPEN), escape(F.coalesce("role", F.lit(""))), F.lit(CLOSE))
    body = escape(F.coalesce("text", F.lit("")))
    pieces = messages.select("conv_id", "msg", "role", head.alias("head"), body.alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    start = F.coalesce(F.sum(size).over(Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("conv_id", "msg", F.concat("head", "body", F.lit(END)).alias("piece"), F.when(F.col("role") == "assistant", F.struct((start + F.length("head")).cast("long").alias("start"), F.length("body").cast("long").alias("length"))).alias("span"))
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg", "piece", "span"))).alias("parts"))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss"))


def parse(formatted: Column) -> Column:
    """Array of (role, text), read back from a rendered conversation."""
    pieces = F.split(formatted, r"<\|end\|>", -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.regexp_extract(t, r"(?s)^<\|([^|]*)\|>", 1)).alias("role"),
            unescape(F.regexp_replace(t, r"(?s)^<\|[^|]*\|>", "")).alias("text"),
        ),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(loss, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))), ""))


def format_turns(turns: DataFrame) -> DataFrame:
    """Event-sourced reconstruction of plain turns, rendered: (conv_id, formatted, loss)."""
    return render(fold_events(turn_events(turns)))
