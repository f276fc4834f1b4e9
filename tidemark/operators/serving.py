"""Reads of the message, entity and to-do tables: lookups, listings, orders and bounded projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import mail as M
from tidemark.functions import text as T
from tidemark.sources.tables import keep, small

#: Ranks of reply efforts, and most rows of a listing.
EFFORTS = {"quick": 0, "moderate": 1, "involved": 2}
MOST_LISTED, MOST_QUEUED = 25, 50


def recent(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.desc("received_at"), "email_id").limit(n)


def get_many(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ``ids``."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def get_or_error(rows: DataFrame, ids: DataFrame, key: str, shown: dict[str, Column]) -> DataFrame:
    """One row for each distinct id: the ``shown`` columns, or an error where there is no such row."""
    found = rows.select(key, *[c.alias(n) for n, c in shown.items()], F.lit(True).alias("_found"))
    error = F.when(F.col("_found").isNull(), F.concat(F.lit("not found: "), F.col(key).cast("string")))
    return ids.select(key).distinct().join(found, key, "left").withColumn("error", error).drop("_found")


def by_sender(rows: DataFrame, address: str) -> DataFrame:
    return rows.where(T.addr_only(F.col("sender")) == address.lower().strip())


def effort_rank(points: Column, scheduling: Column) -> Column:
    """0 to 2 for quick to involved; null where there is no outline."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in EFFORTS.items() for x in pair]), T.reply_effort(points, scheduling))


def sort_queue(rows: DataFrame, by: str = "importance", descending: bool = True) -> list[Column]:
    """The order of the queue by one of five keys: unknown values come last in both directions; inside a category or an effort, importance decides; then time and id."""
    importance, received = F.desc_nulls_last("score"), F.desc("received_at")
    key = {
        "importance": F.col("score"), "received": F.col("received_at"), "sender": F.lower("sender"), "category": F.lower(F.nullif(F.col("category"), F.lit(""))),
        "effort": effort_rank(F.col("outline_points"), F.col("is_scheduling")),
    }[by]
    first = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return [first, importance, received, F.asc("email_id")]


def client_order(by: str) -> list[Column]:
    """The order in which the clients show the queue: unknown scores as -1, unknown efforts after all others, unknown categories last."""
    importance = F.desc(F.coalesce("score", F.lit(-1.0)))
    first = {
        "importance": [], "newest": [F.desc("received_at")], "sender": [F.desc(F.lower("sender"))], "subject": [F.desc(F.lower("subject"))],
        "category": [F.asc_nulls_last(F.nullif(F.col("category"), F.lit("")))], "effort": [F.asc(F.coalesce(effort_rank(F.col("outline_points"), F.col("is_scheduling")), F.lit(3)))],
    }[by]
    return [*first, importance, F.asc("email_id")]


def queue_slice(rows: DataFrame, limit: int = 20, by: str = "importance") -> DataFrame:
    """A short list of the queue, lean columns only, with the number of all rows."""
    total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
    lean = rows.orderBy(*sort_queue(rows, by)).limit(max(1, min(limit, MOST_QUEUED)))
    return lean.crossJoin(total).select("email_id", F.coalesce("subject", F.lit("")).alias("subject"), "sender", "read_status", "level", "category", "is_no_reply", (F.coalesce("outline_points", F.lit(0)) > 0).alias("has_outline"), "total")


def entities_for_email(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(email_id, nth, entity_id): the distinct entities of each message, the most salient first."""
    pairs = mentions.select("email_id", "entity_id").distinct().join(small(keep(entities.select("entity_id", "salience"), "salience")), "entity_id")
    nth = F.row_number().over(Window.partitionBy("email_id").orderBy(F.desc("salience"), "entity_id"))
    return pairs.select("email_id", nth.alias("nth"), "entity_id")


def emails_for_entity(mentions: DataFrame, messages: DataFrame) -> DataFrame:
    """(entity_id, email_id, received_at): the messages of each entity; those that aren't stored have no time."""
    pairs = mentions.select("entity_id", "email_id").distinct()
    return pairs.join(messages.select("email_id", "received_at"), "email_id", "left").select("entity_id", "email_id", "received_at")


def touching(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, src, dst, weight): the edges that begin or end in each entity, as two equi-joins."""
    ids = entities.select("entity_id").distinct()
    out = edges.join(ids, edges.src == ids.entity_id).select("entity_id", "src", "dst", "weight")
    into = edges.where("src != dst").join(ids, F.col("dst") == ids.entity_id).select("entity_id", "src", "dst", "weight")
    return out.unionByName(into)


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def match_entities(entities: DataFrame, aliases: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, entity_id) where the needle is a part of the entity's name or of an alias, in any case. Any number of needles: they meet the names that have their first three characters (fewer, if they are shorter), and these are then searched."""
    wanted = needles.select(F.lower(F.trim("needle")).alias("needle")).where("needle != ''").distinct().withColumn("gram", F.left("needle", F.lit(3)))
    named = entities.select("entity_id", F.lower("name").alias("said")).unionByName(aliases.select("entity_id", F.lower("alias").alias("said"))).where("said is not null").distinct()
    grams = named.withColumn("gram", F.explode(F.concat(*[_grams(F.col("said"), size) for size in (1, 2, 3)])))
    return grams.join(wanted, "gram").where(F.contains("said", "needle")).select("needle", "entity_id").distinct()


def open_items(briefs: DataFrame, most: int = MOST_LISTED) -> DataFrame:
    """(node_id, place, item, truncated): the open items of the briefs in order, ``most`` of them, and whether there are more."""
    items = briefs.select("node_id", F.posexplode("open_items").alias("place", "item")).orderBy("node_id", "place").limit(most + 1)
    many = F.broadcast(items.agg((F.count("*") > most).alias("truncated")))  # one row
    return items.orderBy("node_id", "place").limit(most).crossJoin(many).select("node_id", "place", M.truncate(F.col("item"), 500).alias("item"), "truncated")


def list_open_todos(todos: DataFrame, messages: DataFrame) -> DataFrame:
    """Open to-dos with their messages, the most important first."""
    both = todos.where("status = 'open'").join(messages.select("email_id", "thread_id", "subject", "sender", "score", "level"), "email_id")
    return both.orderBy(F.desc_nulls_last("score"), "todo_id").select("todo_id", "email_id", "thread_id", "kind", "text", F.coalesce("subject", F.lit("")).alias("subject"), "sender", "score", "level")


def wire(rows: DataFrame) -> DataFrame:
    """The queue as clients read it."""
    eligible = ~F.coalesce("is_no_reply", F.lit(True))
    return rows.select(
        F.col("email_id").alias("emailId"), F.col("thread_id").alias("threadId"), "sender", F.coalesce("subject", F.lit("")).alias("subject"), F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("receivedAt"),
        F.col("read_status").alias("readStatus"), F.col("is_no_reply").alias("isNoReply"), F.col("score").alias("importanceScore"), F.col("level").alias("importanceLevel"), "category",
        F.col("is_scheduling").alias("isSchedulingRelated"), T.reply_effort(F.col("outline_points"), F.col("is_scheduling")).alias("replyEffort"), eligible.alias("outlineEligible"),
    )


def outline_status(no_reply: Column) -> Column:
    """Whether a message may have a reply outline: unclassified ones not yet, no-reply ones never."""
    return F.when(no_reply.isNull(), "none").when(no_reply, "not_applicable").otherwise("suggested")


def init_processed(raw: DataFrame) -> DataFrame:
    """Raw messages as processed ones that no stage has seen: the copied columns, all others unknown."""
    unknown = {"is_no_reply": "boolean", "score": "double", "level": "string", "summary": "string", "category": "string", "is_scheduling": "boolean", "outline_points": "int"}
    return raw.select("email_id", "thread_id", "sender", "subject", "received_at", "read_status", *[F.lit(None).cast(t).alias(c) for c, t in unknown.items()])


def backfill_senders(rows: DataFrame) -> DataFrame:
    """Messages that a relay tagged get the tagged sender and lose the tag; only these are returned."""
    tag = T.split_relay_tag(F.col("subject"))
    return rows.withColumn("_tag", tag).where("_tag.sender is not null").withColumns({"sender": F.col("_tag.sender"), "subject": F.col("_tag.rest")}).drop("_tag")


def orphan_priors(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The feedback whose sender has no message any more."""
    known = rows.select(T.addr_only(F.col("sender")).alias("_address")).distinct()
    return log.join(known, T.addr_only(F.col("sender")) == F.col("_address"), "left_anti")


def listing(entities: DataFrame, aliases: DataFrame, kind: str | None = None, most: int = MOST_LISTED) -> DataFrame:
    """(entity_id, salience, mentions, aliases, total, truncated): the most salient entities, of one kind where it is given, with their aliases."""
    some = entities if kind is None else entities.where(F.col("kind") == kind)
    total = F.broadcast(some.agg(F.count("*").alias("total")))  # one row
    shown = some.orderBy(F.desc("salience"), F.desc("mentions"), "entity_id").limit(most)
    names = aliases.join(shown.select("entity_id"), "entity_id", "left_semi").groupBy("entity_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    both = shown.join(names, "entity_id", "left").crossJoin(total)
    return both.select("entity_id", "salience", "mentions", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "total", (F.col("total") > most).alias("truncated"))


def agenda(events: DataFrame, proposals: DataFrame, now: Column, until: Column) -> DataFrame:
    """(day, start, kind, title, confirmed, proposed): confirmed events (title, start) and suggested proposals (title, start, status) of a range in order of start, with the numbers of each by day."""
    rows = events.select(F.lit("event").alias("kind"), "title", "start").unionByName(proposals.where("status = 'suggested'").select(F.lit("proposal").alias("kind"), "title", "start"))
    rows = rows.where((F.col("start") >= now) & (F.col("start") <= until)).withColumn("day", F.to_date(F.timestamp_micros("start")))
    per_day = rows.groupBy("day").agg(F.count_if(F.col("kind") == "event").alias("confirmed"), F.count_if(F.col("kind") == "proposal").alias("proposed"))
    return rows.join(per_day, "day").orderBy("start", "kind", "title").select("day", "start", "kind", "title", "confirmed", "proposed")


def events_by_day(events: DataFrame, zone: str) -> DataFrame:
    """(week, day, n): events (start, all_day) by local day, those of whole days by the day in UTC; weeks begin on Monday."""
    day = F.to_date(F.when(F.col("all_day"), F.timestamp_micros("start")).otherwise(F.from_utc_timestamp(F.timestamp_micros("start"), zone)))
    return events.groupBy(F.to_date(F.date_trunc("week", day)).alias("week"), day.alias("day")).agg(F.count("*").alias("n"))


def iso(at: Column) -> Column:
    """A time with its offset from UTC, seconds and, where there are some, their fractions."""
    whole, zone = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(at, "xxx")
    micros = F.pmod(F.unix_micros(at), F.lit(1_000_000))
    return F.concat(whole, F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), zone)


def wire_calendar(context: Column) -> Column:
    """A calendar context as clients read it (null for null): struct<range_start, range_end, busy_blocks, suggested_slots (arrays of struct<start, end>), existing_events (array of struct<summary, start, end, all_day>), generated_at>."""
    slot = lambda x: F.struct(iso(x.start).alias("start"), iso(x.end).alias("end"))
    event = lambda x: F.struct(x.summary.alias("summary"), iso(x.start).alias("start"), iso(x.end).alias("end"), F.coalesce(x.all_day, F.lit(False)).alias("allDay"))
    c = context
    shown = F.struct(
        iso(c.range_start).alias("rangeStart"), iso(c.range_end).alias("rangeEnd"), F.transform(c.busy_blocks, slot).alias("busyBlocks"), F.transform(c.suggested_slots, slot).alias("suggestedSlots"),
        F.size(c.existing_events).alias("eventCount"), F.transform(c.existing_events, event).alias("events"), iso(c.generated_at).alias("generatedAt"),
    )
    return F.when(context.isNotNull(), shown)


def wire_todos(todos: DataFrame) -> DataFrame:
    """Open to-dos with their messages (see ``list_open_todos``) as clients read them."""
    at = iso(F.col("created_at")) if "created_at" in todos.columns else F.lit(None).cast("string")
    return todos.select(
        F.col("todo_id").alias("todoId"), F.col("email_id").alias("emailId"), F.col("thread_id").alias("threadId"), "kind", "text", at.alias("createdAt"), F.coalesce("subject", F.lit("")).alias("subject"), "sender",
        F.col("score").alias("importanceScore"), F.col("level").alias("importanceLevel"),
    )


def tally(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(email_id, what, name, n): a message's mentions by source and its chunks by kind."""
    count = lambda df, what, name: df.groupBy("email_id", F.col(name).alias("name")).agg(F.count("*").alias("n")).select("email_id", F.lit(what).alias("what"), "name", "n")
    return count(mentions, "mentions", "source").unionByName(count(chunks, "chunks", "kind"))


def related_context(mentions: DataFrame, salience: DataFrame, anchors: DataFrame, most: int = 10) -> DataFrame:
    """(email_id, what, nth, id): of each anchor (email_id) its ``most`` most salient entities, and the first ``most`` other messages by id that share one of these.

    ``mentions``: (email_id, entity_id) of cases and projects; ``salience``: (entity_id, salience). Of an entity's messages none but the first ``most`` and one can be among them, so no more of a frequent one is joined.
    """
    linked = mentions.select("email_id", "entity_id").distinct()
    top = entities_for_email(linked.join(anchors.select("email_id").distinct(), "email_id", "left_semi"), salience).where(F.col("nth") <= most)
    at = F.row_number().over(Window.partitionBy("entity_id").orderBy("email_id"))
    first = linked.withColumn("_at", at).where(F.col("_at") <= most + 1).select("entity_id", F.col("email_id").alias("other"))
    shared = top.select("email_id", "entity_id").join(first, "entity_id").where("other != email_id").select("email_id", "other").distinct()
    nth = F.row_number().over(Window.partitionBy("email_id").orderBy("other"))
    others = shared.withColumn("nth", nth).where(F.col("nth") <= most).select("email_id", F.lit("message").alias("what"), "nth", F.col("other").cast("string").alias("id"))
    return top.select("email_id", F.lit("entity").alias("what"), "nth", F.col("entity_id").alias("id")).unionByName(others)


def email_mentions(mentions: DataFrame, ids: DataFrame) -> DataFrame:
    """The mentions of the messages of ``ids`` (email_id), by source, kind and entity in each."""
    nth = F.row_number().over(Window.partitionBy("email_id").orderBy("source", "kind", "entity_id"))
    return get_many(mentions, ids, "email_id").withColumn("nth", nth)


def email_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of the messages of ``ids`` (email_id), in their order."""
    return get_many(chunks, ids, "email_id").withColumn("nth", F.row_number().over(Window.partitionBy("email_id").orderBy("ord", "chunk_id")))


def entity_index(entities: DataFrame, aliases: DataFrame, vectors: DataFrame) -> DataFrame:
    """(entity_id, kind, key, aliases, vec): all that resolution needs of the stored entities; an entity's names in order."""
    names = aliases.groupBy("entity_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    both = entities.select("entity_id", "kind", "key").join(names, "entity_id", "left").join(vectors.select("entity_id", "vec"), "entity_id", "left")
    return both.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
