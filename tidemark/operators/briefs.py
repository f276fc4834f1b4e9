"""Briefs of threads, cases and projects: which are due, their evidence, and the packs built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import evidence


def candidate_nodes(entities: DataFrame, messages: DataFrame) -> DataFrame:
    """(node_type, node_id): every case, project and thread."""
    nodes = entities.where("kind in ('case', 'project')").select(F.col("kind").alias("node_type"), F.col("entity_id").cast("string").alias("node_id"))
    threads = messages.select(F.lit("thread").alias("node_type"), F.col("thread_id").cast("string").alias("node_id"))
    return nodes.unionByName(threads).where("node_id is not null").distinct()


def evidence_hash(pairs: DataFrame, keys: list[str], item: Column) -> DataFrame:
    """(keys, emails, hash): how many distinct items each node rests on, and a hash of them that doesn't depend on their order.

    Sums of two independent hashes are folded as rows come, so a node with any number of messages is never gathered.
    """
    return evidence.fingerprints(evidence.fingerprint_sums(pairs, keys, item), keys)


def is_generated(generated_at: Column, body: Column) -> Column:
    """Whether a brief was written, and not only reserved."""
    return generated_at.isNotNull() & (F.length(F.trim(F.coalesce(body, F.lit("")))) > 0)


def due_briefs(evidence: DataFrame, stored: DataFrame, least: int = 2) -> DataFrame:
    """(node_type, node_id, emails, hash) of the nodes with evidence enough whose brief is missing, not generated, or of other evidence; most evidence first."""
    old = stored.select("node_type", "node_id", F.col("hash").alias("_old"), is_generated(F.col("generated_at"), F.col("body")).alias("_done"))
    both = evidence.where(F.col("emails") >= least).join(old, ["node_type", "node_id"], "left")
    return both.where(~(F.coalesce("_done", F.lit(False)) & F.col("_old").eqNullSafe(F.col("hash")))).drop("_old", "_done").orderBy(F.desc("emails"), "node_type", "node_id")


def pack_label(sender: Column, received_at: Column, subject: Column) -> Column:
    return F.concat(F.lit("From "), sender, F.lit(", "), F.date_format(received_at, "yyyy-MM-dd"), F.lit(", re: "), F.coalesce(F.nullif(subject, F.lit("")), F.lit("(no subject)")))


def sections(messages: DataFrame, briefs: DataFrame, of_message: DataFrame, foreign: DataFrame) -> DataFrame:
    """(anchor, priority, label, text): all sections of every message's pack, in the order in which they are packed.

    First the message itself; the brief of its thread, if that has several messages; the briefs of its cases and projects, the most salient first; their open items; then foreign chunks
    (anchor, rank, email_id, text), the first of each message, never the anchor's own. ``of_message``: (email_id, nth, kind, entity_id); ``briefs``: (node_type, node_id, headline, body, open_items).
    """
    many = messages.groupBy("thread_id").agg(F.count("*").alias("_n")).where("_n > 1").select("thread_id")
    body = F.concat_ws("\n", "headline", "body")
    place = lambda part, nth: F.struct(F.lit(part).alias("part"), nth.cast("long").alias("nth"))
    one = lambda df, anchor, part, nth, label, text: df.select(F.col(anchor).alias("anchor"), place(part, nth).alias("priority"), label.alias("label"), text.alias("text"))
    itself = one(messages, "email_id", 0, F.lit(0), F.lit("This email"), F.concat(F.lit("Subject: "), F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.lit("(no subject)"))))
    threads = briefs.where("node_type = 'thread'").select(F.col("node_id").alias("_thread"), "headline", "body")
    threaded = messages.select("email_id", "thread_id").join(many, "thread_id", "left_semi").join(threads, F.col("thread_id").cast("string") == F.col("_thread"))
    thread = one(threaded, "email_id", 1, F.lit(0), F.lit("Thread so far"), body)
    linked = of_message.where("kind in ('case', 'project')").join(briefs.select(F.col("node_type").alias("kind"), F.col("node_id").alias("entity_id"), "headline", "body", "open_items"), ["kind", "entity_id"])
    nodes = one(linked, "email_id", 2, F.col("nth"), F.concat(F.initcap("kind"), F.lit(": "), F.col("entity_id")), body)
    items = one(linked.where(F.size("open_items") > 0), "email_id", 3, F.col("nth"), F.concat(F.lit("Open items ("), F.col("entity_id"), F.lit(")")), F.array_join(F.transform("open_items", lambda x: F.concat(F.lit("- "), x)), "\n"))
    first = F.row_number().over(Window.partitionBy("anchor", "email_id").orderBy("rank"))
    found = foreign.where("email_id != anchor").withColumn("_first", first).where("_first = 1").join(messages.select("email_id", "sender", "subject", "received_at"), "email_id")
    other = one(found, "anchor", 4, F.col("rank"), pack_label(F.col("sender"), F.col("received_at"), F.col("subject")), F.col("text"))
    return itself.unionByName(thread).unionByName(nodes).unionByName(items).unionByName(other).where("text != ''")


def build_pack(parts: DataFrame, budget: int = 6000) -> DataFrame:
    """(anchor, nth, label, text): the sections of each anchor until ``budget`` characters are full; the last is cut to what is left."""
    w = Window.partitionBy("anchor").orderBy("priority", "label")
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = parts.withColumn("before", before).withColumn("nth", F.row_number().over(w)).where(F.col("before") < budget)
    return cut.select("anchor", "nth", "label", F.left("text", (F.lit(budget) - F.col("before")).cast("int")).alias("text"))
