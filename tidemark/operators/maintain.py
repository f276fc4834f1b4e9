"""Incremental maintenance: what is due, what has changed, to-dos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import mail as M


def eligible(no_reply: Column) -> Column:
    """Whether a message may be answered: it is classified, and not as no-reply."""
    return F.coalesce(~no_reply, F.lit(False))


def due_stages(rows: DataFrame) -> DataFrame:
    """(email_id, stages): the stages that are due, in canonical order; rows without any are left out.

    ``rows``: processed (whether any run has stored the message), context_at, is_no_reply, score, summary, mentioned_dates, action_items, category, is_scheduling, calendar_context, proposal_status, outline_points and draft; null is
    unknown. A message that was never processed is due for all. An outline is missing only where a message may be answered, a draft only where there is an outline, and what follows from a stage is due with it.
    """
    none = lambda c: F.col(c).isNull()
    true = lambda c: F.coalesce(c, F.lit(False))
    may, outlined = eligible(F.col("is_no_reply")), F.coalesce("outline_points", F.lit(0)) > 0
    outline = may & ~outlined
    calendar = none("is_scheduling") | true(F.col("is_scheduling") & none("calendar_context"))
    due = {
        "chunk": none("context_at"), "embed": none("context_at"), "extract": none("context_at"), "classify": none("is_no_reply"), "score": none("score"), "summarize": none("summary") | none("mentioned_dates"),
        "action_items": none("action_items"), "categorize": none("category"), "scheduling": none("is_scheduling"), "calendar": calendar,
        "propose_event": calendar | true(F.col("is_scheduling") & (F.col("proposal_status") == "none")), "outline": outline, "expand": outline | (may & outlined & (F.coalesce("draft", F.lit("")) == "")),
    }
    new = ~true(F.col("processed"))
    stages = F.array_compact(F.array(*[F.when(new | test, stage) for stage, test in due.items()]))
    return rows.select("email_id", stages.alias("stages")).where(F.size("stages") > 0)


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.select(F.explode("stages").alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


def needs_reply(rows: DataFrame) -> Column:
    """Whether a reply is still owed: the message may be answered, was read, and no reply was sent."""
    return eligible(F.col("is_no_reply")) & (F.col("read_status") == "read") & ~F.coalesce(F.col("outline_status") == "sent", F.lit(False))


def desired_todos(rows: DataFrame) -> DataFrame:
    """(todo_id, email_id, kind, text): one task for each meaningful text of a thread, in any case, claimed by its earliest message, unknown times last, and there by the first item; and one for each message that needs a reply.

    ``rows``: email_id, thread_id, received_at, subject, action_items, is_no_reply, read_status, outline_status. A thread's claims are reduced as they come, never gathered.
    """
    items = rows.select("thread_id", "email_id", "received_at", F.posexplode("action_items").alias("place", "item")).withColumn("text", F.trim("item")).where(M.is_meaningful(F.col("text")))
    claim = F.min(F.struct(F.col("received_at").isNull().alias("unknown"), "received_at", "email_id", "place", "text")).alias("c")
    tasks = items.groupBy("thread_id", F.lower("text")).agg(claim).select("c.email_id", F.lit("action_item").alias("kind"), "c.text")
    replies = rows.where(needs_reply(rows)).select("email_id", F.lit("needs_reply").alias("kind"), M.reply_text(F.col("subject")).alias("text"))
    todo_id = F.substring(F.sha1(F.concat_ws("|", F.col("email_id").cast("string"), "kind", "text")), 1, 24)
    return tasks.unionByName(replies).select(todo_id.alias("todo_id"), "email_id", "kind", "text")


def sync_todos(stored: DataFrame, desired: DataFrame, batch: DataFrame) -> DataFrame:
    """(todo_id, email_id, kind, text, status): new tasks open; stored ones as they are, but open ones of the messages of ``batch`` (email_id) that nothing asks for any more are done."""
    columns = ["todo_id", "email_id", "kind", "text"]
    old = stored.join(desired.select("todo_id", F.lit(True).alias("_wanted")), "todo_id", "left").join(batch.select("email_id", F.lit(True).alias("_in")).distinct(), "email_id", "left")
    retired = (F.col("status") == "open") & F.col("_wanted").isNull() & F.col("_in").isNotNull()
    kept = old.select(*columns, F.when(retired, "done").otherwise(F.col("status")).alias("status"))
    return kept.unionByName(desired.join(stored.select("todo_id"), "todo_id", "left_anti").select(*columns, F.lit("open").alias("status")))


def changed_fingerprints(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` (entity_id, hash) that ``old`` lacks or has otherwise."""
    before = old.select("entity_id", F.col("hash").alias("before"))
    return new.join(before, "entity_id", "left").where(~F.col("hash").eqNullSafe(F.col("before"))).drop("before")
