"""The review queue: filters, orders, pages, statistics, scores and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import mail as M
from tidemark.functions import text as T
from tidemark.sources.tables import placed

#: The floor of each level's band of 25 points and the weights of the signals inside it.
FLOORS = {"low": 0.0, "medium": 25.0, "high": 50.0, "urgent": 75.0}
WEIGHTS = {"vip": 0.30, "direct": 0.20, "urgency": 0.30, "unread_age": 0.15, "recency": 0.05}


def filter_queue(rows: DataFrame, read=None, level=None, category=None, no_reply=None, scheduling=None, search=None, has_outline=None) -> DataFrame:
    """All given predicates; ``no_reply`` leaves out unknown rows, ``scheduling`` takes unknown as false. ``search`` looks into subject and sender, and into the summary where the rows have one; ``has_outline`` asks for points."""
    tests = {
        "read_status": None if read is None else F.col("read_status") == read,
        "level": None if level is None else F.col("level") == level,
        "category": None if category is None else F.lower("category") == category.lower().strip(),
        "no_reply": None if no_reply is None else F.col("is_no_reply").eqNullSafe(no_reply),
        "scheduling": None if scheduling is None else F.coalesce("is_scheduling", F.lit(False)) == scheduling,
        "search": None if search is None else F.lower(F.concat_ws("\n", "subject", "sender", *[c for c in ("summary",) if c in rows.columns])).contains(search.lower().strip()),
        "has_outline": None if has_outline is None else (F.coalesce("outline_points", F.lit(0)) > 0) == has_outline,
    }
    for test in tests.values():
        rows = rows if test is None else rows.where(test)
    return rows


def filter_review(rows: DataFrame, no_reply: bool, scheduling: bool) -> DataFrame:
    """Both flags with unknown as false."""
    return rows.where((F.coalesce("is_no_reply", F.lit(False)) == no_reply) & (F.coalesce("is_scheduling", F.lit(False)) == scheduling))


def score_in_band(level: Column, no_reply: Column, vip: Column, direct: Column, hits: Column, unread_hours: Column, age_hours: Column) -> Column:
    """The score inside the level's band: no-reply mail at its floor, others by their weighted signals, never at the next floor."""
    floor = F.element_at(F.create_map(*[F.lit(x) for pair in FLOORS.items() for x in pair]), level)
    weight = vip.cast("double") * WEIGHTS["vip"] + direct.cast("double") * WEIGHTS["direct"] + F.least(hits, F.lit(3)) / 3.0 * WEIGHTS["urgency"]
    weight += F.coalesce(F.least(unread_hours, F.lit(72.0)) / 72.0, F.lit(0.0)) * WEIGHTS["unread_age"] + F.greatest(F.lit(0.0), 1.0 - F.least(age_hours, F.lit(168.0)) / 168.0) * WEIGHTS["recency"]
    score = floor + 25.0 * F.least(weight, F.lit(1.0))
    capped = F.when(level == "urgent", score).otherwise(F.least(score, floor + 24.9))
    return F.when(F.coalesce(no_reply, F.lit(False)), floor).otherwise(F.bround(capped, 1))


def with_signals(rows: DataFrame, owner: str | None) -> DataFrame:
    """``rows`` with is_vip, whether the sender is among those who write most, is_direct, whether the owner is addressed and not only copied, and age_hours, back from the newest message."""
    address = T.addr_only(F.col("sender"))
    now = rows.agg(F.max("received_at").alias("_now"))
    vips = vip_senders(rows.select("email_id", address.alias("entity_id"))).where(F.lit(True) if owner is None else F.col("entity_id") != owner)
    vips = vips.select(F.col("entity_id").alias("_address"), F.lit(True).alias("_vip"))
    marked = rows.join(vips, address == F.col("_address"), "left").withColumn("is_vip", F.coalesce("_vip", F.lit(False))).drop("_address", "_vip").crossJoin(F.broadcast(now))  # one row
    age = F.bround((F.unix_micros("_now") - F.unix_micros("received_at")) / 3_600_000_000, 1)
    return marked.withColumns({"is_direct": M.is_direct(F.col("to_line"), F.col("cc_line"), owner), "age_hours": age}).drop("_now")


def _own_score(level: Column, no_reply: Column) -> Column:
    """The score of a message with its signals (is_vip, is_direct, age_hours) at a level."""
    unread = F.when(F.col("read_status") == "unread", F.col("age_hours"))
    return score_in_band(level, no_reply, F.col("is_vip"), F.col("is_direct"), F.size(T.urgency_hits(F.col("subject"))), unread, F.col("age_hours"))


def score_messages(rows: DataFrame) -> DataFrame:
    """level (no-reply mail at most medium) and score of each message with its signals (see ``with_signals``)."""
    level = F.when(F.coalesce("is_no_reply", F.lit(False)) & F.col("level").isin("high", "urgent"), "medium").otherwise(F.col("level"))
    return rows.withColumn("level", level).withColumn("score", _own_score(F.col("level"), F.col("is_no_reply")))


def sender_priors(log: DataFrame) -> DataFrame:
    """(sender, level, no_reply): the last valid correction of each kind; senders are bare addresses."""
    valid = log.where("(kind = 'level' and value in ('low', 'medium', 'high', 'urgent')) or (kind = 'no_reply' and value in ('true', 'false'))")
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("value")), F.when(F.col("kind") == kind, F.struct("created_at", "id")))
    return valid.groupBy(T.addr_only(F.col("sender")).alias("sender")).agg(last("level").alias("prior_level"), (last("no_reply") == "true").alias("prior_no_reply"))


def clear_priors(log: DataFrame, senders: DataFrame, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The log without the entries of ``senders``, of one kind where it is given, and these entries."""
    hit = F.lit(True) if kind is None else F.col("kind") == kind
    keys = senders.select(T.addr_only(F.col("sender")).alias("_address")).distinct()
    of = T.addr_only(F.col("sender")) == F.col("_address")
    return log.where(~hit).unionByName(log.where(hit).join(keys, of, "left_anti")), log.where(hit).join(keys, of, "left_semi")


#: What is said of rows that corrections change.
PINNED, MARKED, UNMARKED = "Pinned to {0} by your feedback on this sender.", "your feedback: sender marked automated", "your feedback: sender marked as a real correspondent"


def apply_feedback(rows: DataFrame, priors: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Scored rows with their senders' priors applied: ``changed`` tells whether that changed them; old_level and old_no_reply are what they were.

    A pinned level is taken as it is, and only a row whose level it changes, or that has no score, is scored anew: by its own signals, or with ``raw`` (email_id) at its band's floor where its raw message is gone. Marked mail loses its
    outline (outline_points, outline_status, where the rows have them); mail that is unmarked may get one again. ``no_reply_reason`` and ``justification`` are set where they are told anew.
    """
    both = rows.join(priors.withColumnRenamed("sender", "_address"), T.addr_only(F.col("sender")) == F.col("_address"), "left").drop("_address")
    if raw is not None:
        both = both.join(raw.select("email_id", F.lit(True).alias("_raw")).distinct(), "email_id", "left")
    c = F.col
    marked = c("prior_no_reply").isNotNull() & ~c("is_no_reply").eqNullSafe(c("prior_no_reply"))
    pinned = c("prior_level").isNotNull() & (~c("level").eqNullSafe(c("prior_level")) | c("score").isNull())
    no_reply = F.coalesce("prior_no_reply", "is_no_reply")
    floor = F.element_at(F.create_map(*[F.lit(x) for pair in FLOORS.items() for x in pair]), c("prior_level"))
    anew = _own_score(c("prior_level"), no_reply)
    keep_ = lambda name, kind: c(name) if name in rows.columns else F.lit(None).cast(kind)
    new = {
        "changed": marked | pinned, "old_level": c("level"), "old_no_reply": c("is_no_reply"), "level": F.coalesce("prior_level", "level"), "is_no_reply": no_reply,
        "score": F.when(pinned, anew if raw is None else F.when(c("_raw").isNotNull(), anew).otherwise(floor)).otherwise(c("score")),
        "no_reply_reason": F.when(marked, F.when(c("prior_no_reply"), MARKED).otherwise(UNMARKED)).otherwise(keep_("no_reply_reason", "string")),
        "justification": F.when(pinned, F.concat(F.lit(PINNED.partition("{0}")[0]), c("prior_level"), F.lit(PINNED.partition("{0}")[2]))).otherwise(keep_("justification", "string")),
    }
    if "outline_points" in rows.columns:
        new["outline_points"] = F.when(~(marked & c("prior_no_reply")), c("outline_points"))
    if "outline_status" in rows.columns:
        status = c("outline_status")
        new["outline_status"] = F.when(marked & c("prior_no_reply"), "not_applicable").when(marked & (status == "not_applicable"), "none").otherwise(status)
    done = both.select(*[new[x].alias(x) if x in new else c(x) for x in rows.columns], *[v.alias(k) for k, v in new.items() if k not in rows.columns])
    return done


def top_of_queue(rows: DataFrame, n: int, digits: int = 6) -> DataFrame:
    """The ``n`` rows of the highest spread scores (see ``spread_scores``), with ``spread``: ranks are needed of these rows alone, counted from the top of their level."""
    floor = F.element_at(F.create_map(*[F.lit(x) for pair in FLOORS.items() for x in pair]), F.col("level"))
    known = rows.where("score is not null and level is not null")
    order = [F.desc("score"), F.desc("received_at"), F.desc("email_id")]
    sizes = known.groupBy("level").agg(F.count("*").alias("_n"))  # a row a level
    first = known.orderBy(floor.desc(), *order).limit(n)
    first = first.withColumn("_nth", F.row_number().over(Window.partitionBy("level").orderBy(*order))).join(F.broadcast(sizes), "level")
    spread = F.round(floor + 25.0 * (F.col("_n") - F.col("_nth") + 1) / (F.col("_n") + 1), digits)
    return first.withColumn("spread", spread).drop("_nth", "_n").orderBy(F.desc("spread"), F.desc("received_at"), "email_id")


def spread_scores(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Scores spread evenly over each level's band in order of (score, received_at, email_id).

    There are four levels, so ranks come from places in one order of all rows, sorted in ranges, not from a window that has a level in one task.
    """
    known = placed(rows.where("score is not null and level is not null"), F.col("level"), F.col("score"), F.col("received_at"), F.col("email_id"))
    sizes = known.groupBy("level").agg(F.min("place").alias("_first"), F.count("*").alias("_n"))  # a row a level
    floor = F.element_at(F.create_map(*[F.lit(x) for pair in FLOORS.items() for x in pair]), F.col("level"))
    both = known.join(F.broadcast(sizes), "level")
    return both.withColumn("spread", F.round(floor + 25.0 * (F.col("place") - F.col("_first") + 1) / (F.col("_n") + 1), digits)).drop("place", "_first", "_n")


def queue_stats(rows: DataFrame) -> DataFrame:
    n = lambda test: F.count_if(test).alias
    levels = [n(F.col("level") == k)(k) for k in FLOORS]
    return rows.agg(F.count("*").alias("total"), n(F.col("read_status") == "unread")("unread"), n(F.coalesce("is_no_reply", F.lit(False)))("no_reply"), n(F.coalesce("is_scheduling", F.lit(False)))("scheduling"), n(F.coalesce("outline_points", F.lit(0)) > 0)("with_outline"), *levels)


def stale_outlines(rows: DataFrame) -> DataFrame:
    """Messages with an outline that a newer message of their thread has overtaken."""
    newest = F.max("received_at").over(Window.partitionBy("thread_id"))
    return rows.withColumn("newest", newest).where("outline_points is not null and received_at < newest")


def vip_senders(pairs: DataFrame, percent: int = 90) -> DataFrame:
    """People in at least as many messages as the nearest-rank percentile of people has: (entity_id, emails)."""
    counts = pairs.groupBy("entity_id").agg(F.count_distinct("email_id").alias("emails"))
    by_count = counts.groupBy("emails").agg(F.count("*").alias("people"))  # a row for each distinct count, so the running sum is small
    upto = F.sum("people").over(Window.orderBy("emails"))
    total = F.sum("people").over(Window.partitionBy())
    bar = by_count.withColumn("upto", upto).withColumn("place", F.bround(F.lit(percent / 100.0) * (total - 1)) + 1).where("upto >= place").agg(F.min("emails").alias("bar"))
    return counts.crossJoin(F.broadcast(bar)).where("emails >= bar").drop("bar")
