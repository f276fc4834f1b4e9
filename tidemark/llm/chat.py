"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log has rows (conv_id, msg, seq, kind, role, text): message ``msg`` of a conversation receives events in order of ``seq``. ``delta`` appends
its text, ``edit`` replaces all before it by its text, ``regenerate`` discards all before it and starts with its text, ``delete`` removes the message
unless later events write it again. The fold keeps the events from the last edit, regeneration or deletion on and joins their texts: one
pass, no running copies. Messages are folded by (conv_id, msg), which spreads a long conversation over tasks, and only
the finished messages meet to be rendered.

A turn is rendered ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts a backslash is put after the ``<`` of anything that reads ``<|``, or ``<`` with
backslashes and ``|``; in roles backslashes and line feeds are escaped first. Both are undone exactly by ``unescape`` and ``parse``, so no text can forge a
turn. ``loss_spans`` (code points, end exclusive) covers the text of each assistant turn.

Defined cases: null text or role counts as empty; events of equal seq are taken in order of kind and text; null keys are keys of their own; an empty
log gives no conversations. A conversation is one value of its result, so it must fit in one string (2 GB), as any rendered example must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """``text`` without any ``<|``; undone by ``unescape``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # an escaped backslash is put aside so that it is not taken for the start of an escaped line feed
    plain = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(plain, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text): the final messages of a log (conv_id, msg, seq, kind, role, text)."""
    event = F.struct("seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    folded = events.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list(event)).alias("events"))
    # the place of the last event that discards what came before it
    last = F.coalesce(F.array_max(F.transform("events", lambda e, i: F.when(e.kind.isin("edit", "regenerate", "delete"), i + 1))), F.lit(1))
    live = F.slice("events", last, F.greatest(F.size("events"), F.lit(1)))
    folded = folded.withColumn("live", live).where(~((F.size("live") == 1) & (F.col("live")[0].kind == "delete")))
    said = F.array_join(F.transform(F.filter("live", lambda e: e.kind != "delete"), lambda e: e.text), "")
    return folded.select("conv_id", "msg", F.element_at("live", -1).role.alias("role"), said.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_turns, loss_spans, n_turns) from messages (conv_id, msg, role, text), in order of msg."""
    head = F.concat(F.lit(START), _escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    turns = messages.select("conv_id", "msg", (F.coalesce("role", F.lit("")) == "assistant").alias("loss"), head.alias("head"), body.alias("body"))
    sizes = F.length("head") + F.length("body") + len(END)
    before = F.coalesce(F.sum(sizes).over(Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = before + F.length("head")
    turns = turns.withColumn("start", start).withColumn("end", F.col("start") + F.length("body"))
    turn = F.struct("msg", "loss", F.concat("head", "body", F.lit(END)).alias("said"), "start", "end")
    shown = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t.loss), lambda t: F.struct(t.start.alias("start"), t.end.alias("end")))
    return shown.select("conv_id", F.array_join(F.col("turns.said"), "").alias("formatted"), F.col("turns.loss").alias("loss_turns"), spans.alias("loss_spans"), F.size("turns").cast("long").alias("n_turns"))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array<struct<role, text>>, with escapes undone."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")
    inner = F.transform(pieces, lambda p: F.substring(p, len(START) + 1, 2_147_483_647))
    return F.transform(inner, lambda p: F.struct(_unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.locate("\n", p) + 1, F.lit(2_147_483_647))).alias("text")))


def log_of(turns: DataFrame) -> DataFrame:
    """The event log of finished turns (conv_id, turn, role, text): each is streamed as two deltas over a first draft that is regenerated.

    Turns are numbered in order of turn, role and text, so turns of equal number all stay.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", F.row_number().over(order).alias("msg"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = (F.length("text") / 2).cast("int")
    event = lambda seq, kind, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    rest = F.substring(F.col("text"), half + 1, F.length("text"))
    events = F.array(event(1, "delta", F.substring(F.col("text"), F.lit(1), half)), event(2, "regenerate", F.lit("")), event(3, "delta", F.substring(F.col("text"), F.lit(1), half)), event(4, "delta", rest))
    return numbered.select("conv_id", "msg", "role", F.explode(events).alias("e")).select("conv_id", "msg", "e.seq", "e.kind", "role", "e.text")
