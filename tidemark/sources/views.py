"""Readers for the star-schema tables and the message, mention, chunk and calendar views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import joined, parts

#: Whose mail the messages are.
OWNER = "owner@example.com"
#: Subjects that messages carry in turn.
SUBJECTS = [
    "Re: Fwd: are you free tomorrow?", "URGENT: action required on CS-40350", "Weekly newsletter", "Please schedule a call next week", "Invoice INV-2041 attached",
    "deadline moved, reply asap", "Lunch on Friday at 12:30", "Fw: your availability", "calendar invite: project sync", "Receipt #4471", "Important: time-sensitive update",
    "Let's catch up over zoom", "Re: RMA-2026-0447 returned", "What time works for you", "Monthly report", "as soon as possible please", "Re: [ops@example.org] disk alert",
    "Aw: Sv: meeting request", "Pencil you in for Monday", "No subject", "push back the meeting to 3 pm", "Good morning", "immediately needed: SN-4400-2283", "Thanks",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its timestamps in the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in df.schema.fields])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: one row an event, a thread for each user, forty senders."""
    e = table(spark, sf_dir, "events")
    subject = F.element_at(F.array(*[F.lit(s) for s in SUBJECTS]), (F.col("event_id") % len(SUBJECTS) + 1).cast("int"))
    level = F.when(F.col("event_type") == "purchase", "urgent").when(F.col("event_type") == "error", "high").when(F.col("event_type") == "click", "medium").otherwise("low")
    return e.select(
        F.col("event_id").alias("email_id"), F.col("user_id").alias("thread_id"), F.concat(F.lit("u"), F.col("user_id") % 40, F.lit("@example.com")).alias("sender"),
        F.col("ts").alias("received_at"), level.alias("level"), F.when(F.col("event_id") % 3 != 0, "read").otherwise("unread").alias("read_status"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 5 == 0).alias("is_no_reply"), F.col("event_type").alias("category"),
        F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 4 == 0).alias("is_scheduling"), F.when(F.col("event_id") % 6 != 0, (F.col("event_id") % 6 - 1).cast("int")).alias("outline_points"),
        subject.alias("subject"), F.col("value"),
        F.when(F.col("event_id") % 4 == 0, "Owner <owner@example.com>, team@example.com").when(F.col("event_id") % 4 == 1, "team@example.com").when(F.col("event_id") % 4 == 3, "owner@example.com").alias("to_line"),
        F.when(F.col("event_id") % 8 == 1, "Owner <OWNER@example.com>").when(F.col("event_id") % 8 == 5, "other@example.com").alias("cc_line"),
    )


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with what earlier runs have stored of each stage; some outputs are missing."""
    e = F.col("email_id")
    items = F.array(F.col("subject"), F.concat(F.lit(" Review the "), "category", F.lit(" report ")), F.lit("ok"), F.lit("- - - -"))
    return messages(spark, sf_dir).withColumns({
        "processed": e % 17 != 0, "context_at": F.when(e % 12 != 0, F.col("received_at")), "score": F.when(e % 13 != 0, F.col("value")), "summary": F.when(e % 14 != 0, F.col("subject")), "mentioned_dates": F.when(e % 9 != 0, ""),
        "action_items": F.when(e % 10 != 3, items), "calendar_context": F.when(e % 3 != 0, "{}"), "proposal_status": F.when(e % 2 == 0, "none").otherwise("suggested"), "draft": F.when(e % 5 != 1, "Hello"),
        "outline_status": F.when(e % 15 == 1, "sent").when(F.col("is_no_reply"), "not_applicable").otherwise("suggested"),
    })


def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log of corrections: one event in fifty sets the level or the no-reply flag of its sender."""
    m = messages(spark, sf_dir).where("email_id % 50 = 0")
    kind = F.when(F.col("email_id") % 100 == 0, "level").otherwise("no_reply")
    value = F.when(F.col("email_id") % 100 == 0, F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "urgent"))), (F.floor(F.col("email_id") / 100) % 4 + 1).cast("int"))).otherwise(F.when(F.floor(F.col("email_id") / 50) % 4 == 1, "true").otherwise("false"))
    return m.select(F.col("email_id").alias("id"), "sender", kind.alias("kind"), value.alias("value"), F.col("received_at").alias("created_at"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages that mention people, cases, projects and organisations: (email_id, kind, key, confidence).

    Rows are dealt by message, in as many parts as there are rows for, so that whatever is counted or joined by message is not shuffled again and no task has more rows when the tables grow.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linestatus", "l_discount")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    conf = F.when(F.col("l_discount") < 0.03, 0.4).otherwise(1.0)
    one = lambda kind, key: F.struct(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"))
    n = parts(spark, li.count())
    rows = joined(li, p, "l_partkey", n).repartition(n, "l_orderkey").join(o.repartition(n, "l_orderkey"), "l_orderkey").select(F.col("l_orderkey").alias("email_id"), conf.alias("confidence"), F.explode(F.array(one("person", "o_custkey"), one("case", "l_suppkey"), one("project", "p_brand"), one("org", "l_linestatus"))).alias("m"))
    return rows.select("email_id", F.concat_ws(":", "m.kind", "m.key").alias("entity_id"), "m.kind", "confidence")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text chunks (chunk_id, email_id, ord, kind, text), two a message."""
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 10 == 8, "quoted").when(F.col("doc_id") % 10 == 9, "signature").otherwise("body")
    return d.select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 2).alias("email_id"), (F.col("doc_id") % 2).cast("int").alias("ord"), kind.alias("kind"), "text")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as names of things, five of a group near each other: (vec_id, kind, key, vec). Some names contain others."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    base = v.select((F.col("vec_id")).alias("base"), F.col("embedding").alias("centre"))
    v = v.withColumn("base", F.col("vec_id") - F.col("vec_id") % 5).join(base, "base")
    nth, group = F.col("vec_id") % 5, F.floor(F.col("vec_id") / 5).cast("string")
    key = F.when(nth == 0, F.concat(F.lit("lot "), group)).when(nth == 1, F.concat(F.lit("anshun lot "), group)).when(nth == 2, F.concat(F.lit("lot "), group, F.lit(" dock"))).otherwise(F.concat(F.lit("item "), F.col("vec_id").cast("string")))
    kind = F.element_at(F.array(F.lit("topic"), F.lit("org"), F.lit("case")), (F.floor(F.col("vec_id") / 5) % 3 + 1).cast("int"))
    share = 0.25 + 0.1 * nth
    return v.select("vec_id", kind.alias("kind"), key.alias("key"), F.zip_with("centre", "embedding", lambda c, e: c.cast("double") + share * e.cast("double")).alias("vec"))


def busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as busy time: (calendar_id, start, end), ten minutes for each unit of value."""
    e = table(spark, sf_dir, "events")
    start = F.unix_micros("ts")
    return e.select(F.col("user_id").alias("calendar_id"), "event_id", start.alias("start"), (start + F.floor(F.col("value") * 600).cast("long") * 1_000_000).alias("end"))
