"""Catalog queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.numbers import rounded
from tidemark.operators import chunking, graph, intervals, maintain, merge, postings, queue, resolution, retrieval, serving
from tidemark.sources import views as V
from tidemark.sources.tables import keep, spread
from tidemark.streaming import streams

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _ntz(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


# the review queue


def _fed(s, d):
    """Scored messages with the corrections of their senders."""
    return queue.apply_feedback(queue.score_messages(queue.with_signals(V.messages(s, d), V.OWNER)), queue.sender_priors(V.feedback_log(s, d)))


@query
def review_queue(s, d):
    return queue.top_of_queue(keep(_fed(s, d), "fed"), 20).select("email_id", "sender", "level", "score", "spread")


@query
def spread_scores(s, d):
    return queue.spread_scores(_fed(s, d)).select("email_id", "level", "spread")


@query
def score_messages(s, d):
    return queue.score_messages(queue.with_signals(V.messages(s, d), V.OWNER)).select("email_id", "level", "score")


@query
def filter_queue(s, d):
    return queue.filter_queue(V.processed(s, d), read="unread", no_reply=False, scheduling=False, search="re", has_outline=True).select("email_id", "sender", "subject")


@query
def filter_review(s, d):
    return queue.filter_review(V.messages(s, d), False, True).select("email_id")


@query
def urgent_unread(s, d):
    return V.messages(s, d).where("level = 'urgent' and read_status = 'unread'").select("email_id", "sender")


@query
def page_queue(s, d):
    rows = queue.filter_queue(V.messages(s, d), category="click")
    total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
    return rows.orderBy(F.desc("value"), "email_id").offset(20).limit(20).crossJoin(total).select("email_id", "value", "total")


@query
def queue_stats(s, d):
    return queue.queue_stats(V.messages(s, d))


@query
def level_share(s, d):
    rows = V.messages(s, d).groupBy("level").agg(F.count("*").alias("n"))
    return rows.withColumn("percent", F.floor(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()) + 0.5).cast("long"))


@query
def top_categories(s, d):
    return V.messages(s, d).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(12)


@query
def stale_outlines(s, d):
    return queue.stale_outlines(V.messages(s, d)).select("email_id", "thread_id")


@query
def thread_sizes(s, d):
    return V.messages(s, d).groupBy("thread_id").agg(F.count("*").alias("n")).where("n > 1")


@query
def thread_representative(s, d):
    return merge.latest(V.messages(s, d), ["thread_id"], F.desc_nulls_last("value"), F.desc("received_at"), "email_id").select("thread_id", "email_id", "value")


@query
def last_n_turns(s, d):
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return V.table(s, d, "conversations").withColumn("nth", nth).where("nth <= 3").select("conv_id", "turn", "role")


@query
def conversation_heads(s, d):
    return V.table(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("turns"))


@query
def sender_priors(s, d):
    return queue.sender_priors(V.feedback_log(s, d))


@query
def apply_feedback(s, d):
    """What corrections change, where the raw message of one in nine is gone."""
    m = V.processed(s, d)
    scored = queue.score_messages(queue.with_signals(m, V.OWNER))
    fed = queue.apply_feedback(scored, queue.sender_priors(V.feedback_log(s, d)), m.where("email_id % 9 != 2"))
    return fed.where("changed").select("email_id", "level", "is_no_reply", "score", F.coalesce("outline_points", F.lit(-1)).alias("outline_points"), "outline_status", F.coalesce("justification", "no_reply_reason").alias("why"))


@query
def clear_priors(s, d):
    """What is left of the log once the people who write most have their levels cleared, and how many entries that takes."""
    log, m = V.feedback_log(s, d), V.messages(s, d)
    vips = queue.vip_senders(m.select("email_id", F.col("sender").alias("entity_id"))).select(F.col("entity_id").alias("sender"))
    left, gone = queue.clear_priors(log, vips, "level")
    return left.groupBy("kind").agg(F.count("*").alias("n")).crossJoin(F.broadcast(gone.agg(F.count("*").alias("cleared"))))


@query
def vip_senders(s, d):
    return queue.vip_senders(V.mentions(s, d).where("kind = 'person'").select("email_id", "entity_id"))


@query
def score_spread_stats(s, d):
    v = F.col("value")
    return V.messages(s, d).groupBy("level").agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("stdev"), F.count_distinct(v).alias("values"))


@query
def majority_dim(s, d):
    v = V.table(s, d, "embeddings").withColumn("dim", F.size("embedding"))
    most = v.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).select("dim")
    return v.join(F.broadcast(most), "dim").groupBy("dim", "label").agg(F.count("*").alias("n"))


# keyed tables


def _halves(s, d):
    o = V.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.unix_micros("o_orderdate").alias("at"))
    return o.where("o_orderkey % 3 != 0"), o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("N"))


@query
def merge_latest(s, d):
    return merge.merge_latest(*_halves(s, d), ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query
def replace_by_parent(s, d):
    old, new = _halves(s, d)
    return merge.replace_by_parent(old, new.where("o_custkey % 5 = 0"), "o_custkey").select("o_orderkey", "o_custkey", "o_orderstatus")


@query
def merge_entities(s, d):
    per = lambda df: df.groupBy("o_custkey").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count("*").alias("n"))
    old, new = map(per, _halves(s, d))
    return merge.merge_spans(old, new, ["o_custkey"], "first_seen", "last_seen")


@query
def insert_ignore(s, d):
    old, new = _halves(s, d)
    old = merge.latest(old, ["o_custkey"], F.col("o_orderkey"))
    return merge.insert_ignore(old, new, ["o_custkey"], F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


@query
def apply_updates(s, d):
    m = V.messages(s, d)
    edits = m.where("email_id % 4 = 0").select((F.col("email_id") - F.col("email_id") % 8).alias("email_id"), F.concat(F.lit("edited "), F.col("email_id")).alias("value"), F.col("received_at").alias("at"))
    return merge.apply_updates(m.select("email_id", "category", "read_status"), edits, "email_id", "category", F.col("read_status") == "unread")


@query
def remap_keys(s, d):
    m = V.mentions(s, d).where("kind = 'case'")
    mapping = m.select(F.col("entity_id").alias("old")).distinct().where(F.xxhash64("old").isNotNull() & F.col("old").rlike("[02468]$")).select("old", F.concat(F.lit("merged:"), F.right("old", F.lit(1))).alias("new"))
    return merge.remap_keys(m, mapping, "entity_id").groupBy("entity_id").agg(F.count("*").alias("n"))


# the graph


@query
def entity_counts(s, d):
    return V.mentions(s, d).groupBy("kind").agg(F.count_distinct("entity_id").alias("entities"), F.count("*").alias("mentions"))


@query
def email_counts(s, d):
    return V.mentions(s, d).groupBy("entity_id").agg(F.count_distinct("email_id").alias("emails"))


@query
def email_counts_sketched(s, d):
    """The exact numbers of messages, and whether those merged from sketches of a thousand ids each are within 3 %."""
    m = V.mentions(s, d)
    about = graph.sketched_counts(graph.email_sketches(m, F.floor(F.col("email_id") / 1000))).withColumnRenamed("emails", "about")
    exact = m.groupBy("entity_id").agg(F.count_distinct("email_id").alias("emails"))
    return exact.join(about, "entity_id").select("entity_id", "emails", (F.abs(F.col("about") - F.col("emails")) <= 0.03 * F.col("emails")).alias("near"))


@query
def cooccurrence(s, d):
    return graph.cooccurrence(V.mentions(s, d))


@query
def entity_idf(s, d):
    return graph.entity_idf(graph.cooccurrence(V.mentions(s, d))).withColumn("idf", F.round("idf", 6))


@query
def salience(s, d):
    return graph.salience(V.mentions(s, d))


@query
def relations(s, d):
    return graph.relations(V.mentions(s, d))


@query
def fragmentation(s, d):
    m = V.mentions(s, d)
    return graph.fragmentation(m.select("entity_id", "kind"), m.where("email_id % 2 = 0"))


def _edges(s, d):
    return _edges_of(V.mentions(s, d))


def _edges_of(mentions):
    # whole edges between cases and projects: weights are counts of shared messages
    m = mentions.select("email_id", "entity_id", "kind").distinct()
    a, b = m.where("kind = 'case'").alias("a"), m.where("kind = 'project'").alias("b")
    both = a.join(b, "email_id").groupBy(F.col("a.entity_id").alias("src"), F.col("b.entity_id").alias("dst")).agg(F.count("*").alias("n"))
    return both.where("n >= 2").select("src", "dst", F.round(F.col("n") / (F.col("n") + 10.0), 6).alias("weight"))


@query
def neighbors_weighted(s, d):
    e = keep(_edges(s, d), "edges")
    starts = e.select(F.col("src").alias("entity_id")).distinct()
    return graph.neighbors_weighted(e, starts).withColumn("score", rounded(F.col("score")))


@query
def neighbors_decayed(s, d):
    e = keep(_edges(s, d), "edges")
    starts = e.select(F.col("src").alias("entity_id")).distinct()
    return graph.neighbors_decayed(e, starts).withColumn("score", rounded(F.col("score")))


@query
def evidence_fingerprint(s, d):
    return graph.fingerprint(V.mentions(s, d))


@query
def dirty_briefs(s, d):
    m = V.mentions(s, d).where("kind = 'case'")
    return maintain.changed_fingerprints(graph.fingerprint(m.where("email_id % 1000 != 1")).select("entity_id", "hash"), graph.fingerprint(m)).select("entity_id", "emails", "hash")


# search


def _asked(s, d, table):
    """A query (query_id, query) for every chunk whose id is divisible by 50: its two most frequent words of five to eight letters, or the first of these and a phrase of the chunk's first two words."""
    some = table.where("chunk_id % 50 = 0 and length(term) between 5 and 8")
    nth = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("tf"), "term"))
    frequent = some.withColumn("nth", nth).groupBy("chunk_id").agg(F.max(F.when(F.col("nth") == 1, F.col("term"))).alias("one"), F.max(F.when(F.col("nth") == 2, F.col("term"))).alias("two"))
    chunks = V.chunks(s, d).where("chunk_id % 50 = 0").withColumn("words", postings.words(F.col("text")))
    phrase = F.when(F.size("words") >= 2, F.concat_ws("-", F.get("words", F.lit(0)), F.get("words", F.lit(1))))
    query = F.concat_ws(" ", "one", F.when(F.col("chunk_id") % 100 == 0, F.col("two")).otherwise(phrase))
    return chunks.join(frequent, "chunk_id", "left").select(F.col("chunk_id").alias("query_id"), query.alias("query"))


@query
def bm25_search(s, d):
    chunks = V.chunks(s, d)
    return postings.search(None, chunks, _asked(s, d, postings.postings(chunks.where("chunk_id % 50 = 0"))))


@query
def vector_search(s, d):
    v = V.table(s, d, "embeddings")
    return retrieval.vector_topk(v, v.where("vec_id % 50 = 0"))


@query
def body_vectors(s, d):
    """The body chunks among the nearest vectors."""
    return retrieval.body_hits(vector_search(s, d), V.chunks(s, d))


def _near_messages(s, d, anchors, targets=None):
    m = keep(V.mentions(s, d).where("kind in ('case', 'project')"), "mentions")
    return graph.graph_search(_edges_of(m), m, graph.salience(m), anchors, targets=targets)


@query
def hybrid_search(s, d):
    """Every chunk whose id is divisible by 50 as a query against all chunks: its words, its vector, which has its number, and the graph around its message, which shows the first body chunk of each message."""
    chunks = V.chunks(s, d)
    first = keep(graph.first_chunks(chunks), "first_chunks")
    asked = chunks.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("email_id").alias("anchor"))
    near = _near_messages(s, d, asked.select(F.col("anchor").alias("email_id")), first.select("email_id"))
    linked = near.join(first, "email_id").join(asked, "anchor").select("query_id", "rank", "chunk_id")
    return retrieval.fuse({"bm25": bm25_search(s, d), "vector": body_vectors(s, d), "graph": linked})


@query
def first_chunk(s, d):
    """The first body chunk of each message."""
    return graph.first_chunks(V.chunks(s, d))


@query
def build_pack(s, d):
    sections = V.table(s, d, "conversations").select(F.col("conv_id").alias("anchor"), F.col("turn").alias("priority"), "text")
    return retrieval.budget_prefix(sections, 1500).select("anchor", "priority", F.length("text").alias("chars"), F.md5("text").alias("digest"))


# text


@query
def find_addresses(s, d):
    return V.table(s, d, "documents").select("doc_id", F.array_join(T.find_addresses(F.col("text")), ",").alias("addresses")).where("addresses != ''")


@query
def normalize_name(s, d):
    return V.table(s, d, "part").select("p_partkey", T.normalize_name(F.concat(F.lit("The "), "p_name", F.lit(" Projects."))).alias("name"))


@query
def normalize_topic(s, d):
    return V.table(s, d, "conversations").select("conv_id", "turn", T.normalize_topic(F.col("text")).alias("topic"))


@query
def reply_subjects(s, d):
    tag = T.split_relay_tag(F.col("subject"))
    return V.messages(s, d).select("email_id", T.strip_reply_prefixes(F.col("subject")).alias("bare"), tag.sender.alias("relayed"), tag.rest.alias("rest"))


@query
def message_ids(s, d):
    i = F.explode(T.find_ids(F.col("subject"))).alias("i")
    return V.messages(s, d).select("email_id", i).select("email_id", "i.id", "i.kind", T.normalize_id(F.col("i.id")).alias("key"))


@query
def urgency_hits(s, d):
    return V.messages(s, d).select("email_id", F.array_join(T.urgency_hits(F.col("subject")), ",").alias("hits")).where("hits != ''")


@query
def scheduling_signals(s, d):
    e = F.col("email_id")
    kind = F.when(e % 13 == 0, "Text/Calendar; method=REQUEST").when(e % 13 == 1, 'multipart/mixed; name="plan.ics"').when(e % 13 == 2, "multipart/alternative; METHOD = reply").otherwise("text/plain")
    found = T.scheduling_signals(F.col("subject"), F.concat(F.repeat(F.lit("x "), 990), "category", F.lit(" let us find some time")), kind, e % 5 == 0)
    return spread(V.messages(s, d)).select("email_id", found.alias("f")).select("email_id", "f.points", F.array_join("f.reasons", ";").alias("reasons"), "f.related")


@query
def no_reply_rules(s, d):
    m = V.messages(s, d)
    e = F.col("email_id")
    sender = F.when(e % 9 == 0, "No-Reply <noreply@example.com>").when(e % 9 == 1, "alerts@example.com").otherwise(F.col("sender"))
    verdict = T.no_reply(sender, F.when(e % 8 == 0, "bulk"), e % 6 == 0, F.when(e % 7 == 0, "auto-generated"), F.when(e % 12 == 0, "Desk <desk@example.com>"))
    return m.select("email_id", verdict.alias("verdict"))


@query
def reply_effort(s, d):
    return V.messages(s, d).select("email_id", T.reply_effort(F.col("outline_points"), F.col("is_scheduling")).alias("effort"))


@query
def html_to_text(s, d):
    return V.table(s, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query
def chunk_corpus(s, d):
    return chunking.chunk_corpus(V.table(s, d, "documents").select(F.col("doc_id").alias("email_id"), F.col("text").alias("body")))


@query
def extract_mentions(s, d):
    return chunking.extract_mentions(chunk_corpus(s, d))


@query
def resolve_entities(s, d):
    # the texts are read once; all else is made of the distinct names
    m = keep(chunking.extract_mentions(chunk_corpus(s, d)).select("kind", "key").distinct(), "mentioned_names")
    known = m.where("kind = 'org'").select("kind", "key").distinct().withColumn("entity_id", F.concat(F.lit("org_"), "key"))
    alias = m.where("kind = 'person'").select("kind", "key").distinct().where("length(key) % 2 = 0").withColumn("entity_id", F.concat(F.lit("p_"), F.md5("key")))
    return chunking.resolve_entities(m, known, alias)


@query
def model_stage(s, d):
    return chunking.model_stage(V.table(s, d, "documents").select("doc_id", "text"), _first_words, ["doc_id", "text"], "string").select("doc_id", "value", "error")


def _first_words(rows):
    """A stand-in for a model: the first three words."""
    return [" ".join((r["text"] or "").split()[:3]) for r in rows]


# calendars


@query
def merge_intervals(s, d):
    return intervals.merge_intervals(V.busy(s, d))


def _windows(s, d):
    days = V.busy(s, d).select("calendar_id", F.floor(F.col("start") / intervals.DAY).alias("day")).distinct()
    return days.select("calendar_id", (F.col("day") * intervals.DAY + 9 * intervals.HOUR).alias("from"), (F.col("day") * intervals.DAY + 17 * intervals.HOUR).alias("to"))


@query
def free_windows(s, d):
    return intervals.free_windows(_windows(s, d), V.busy(s, d))


@query
def suggest_slots(s, d):
    return intervals.first_slots(intervals.free_windows(_windows(s, d), V.busy(s, d)), intervals.HOUR // 2)


@query
def slot_conflicts(s, d):
    b = V.busy(s, d)
    slots = b.where("event_id % 10 = 0").select(F.col("event_id").alias("slot_id"), "calendar_id", "start", (F.col("start") + intervals.HOUR).alias("end"))
    return intervals.slot_conflicts(slots, b)


@query
def events_by_day(s, d):
    return V.table(s, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


# maintenance


@query
def due_stages(s, d):
    return maintain.due_stages(V.processed(s, d)).select("email_id", F.array_join("stages", ",").alias("stages"))


@query
def plan_summary(s, d):
    return maintain.plan_summary(maintain.due_stages(V.processed(s, d)))


@query
def desired_todos(s, d):
    return maintain.desired_todos(V.processed(s, d))


@query
def sync_todos(s, d):
    """The to-dos after a run over all messages whose id isn't divisible by seven, where those of even ids were stored, claimed among themselves, and some are done."""
    m = V.processed(s, d)
    stored = maintain.desired_todos(m.where("email_id % 2 = 0")).withColumn("status", F.when(F.col("email_id") % 3 == 0, "done").otherwise("open"))
    batch = m.where("email_id % 7 != 0")
    return maintain.sync_todos(stored, maintain.desired_todos(batch), batch)


# streams


@query
def stream_stats(s, d):
    return _ntz(streams.drain(streams.stats(streams.events(s, d)), "complete"))


@query
def stream_dedupe(s, d):
    return streams.drain(streams.dedupe(streams.events(s, d)), "append").select("event_id", "user_id")


@query
def stream_latest(s, d):
    return merge.latest(streams.drain(streams.latest_by_user(streams.events(s, d)), "complete"), ["user_id", "event_type"], F.col("value"))


@query
def stream_sessions(s, d):
    return _ntz(streams.drain(streams.sessions(streams.events(s, d)), "complete"))


# more of the graph and of the serving queries


@query
def graph_search(s, d):
    return _near_messages(s, d, V.mentions(s, d).where("kind in ('case', 'project') and email_id % 50 = 0").select("email_id").distinct())


@query
def related_context(s, d):
    """Cases and projects of every message whose id is divisible by 50, and other messages that share them."""
    m = V.mentions(s, d).where("kind in ('case', 'project')")
    return serving.related_context(m, graph.salience(m), m.where("email_id % 50 = 0"))


@query
def project_rollup(s, d):
    """The twenty most salient projects with their nearest cases."""
    m = V.mentions(s, d).where("kind in ('case', 'project')")
    per = graph.salience(m, "kind")
    return graph.rollup(per.where("kind = 'project'"), _edges(s, d), per.select("entity_id", "kind"), ("case", "project")).withColumn("score", F.round("score", 6))


@query
def entity_listing(s, d):
    """The 25 entities of highest salience, with the total."""
    per = graph.salience(V.mentions(s, d))
    total = F.broadcast(per.agg(F.count("*").alias("total")))  # one row
    return per.orderBy(F.desc("salience"), F.desc("mentions"), "entity_id").limit(25).crossJoin(total).select("entity_id", "salience", "mentions", "total")


@query
def batch_rows(s, d):
    """Messages of each sender in batches of twenty, in order."""
    nth = F.row_number().over(Window.partitionBy("sender").orderBy("received_at", "email_id")) - 1
    rows = V.messages(s, d).withColumn("batch", F.floor(nth / 20))
    return rows.groupBy("sender", "batch").agg(F.count("*").alias("n"), F.min("email_id").alias("least"))


@query
def sort_by_effort(s, d):
    """Queue order by reply effort, unknown last, then by value."""
    effort = T.reply_effort(F.col("outline_points"), F.col("is_scheduling"))
    rank = F.when(effort == "quick", 0).when(effort == "moderate", 1).when(effort == "involved", 2)
    return V.messages(s, d).withColumn("effort", rank).orderBy(F.asc_nulls_last("effort"), F.desc("value"), "email_id").limit(50).select("email_id", "effort", "value")


@query
def agenda(s, d):
    """Busy time of the last three days and how much of it there is, by day and calendar."""
    b = V.busy(s, d)
    now = F.broadcast(b.agg((F.max("start") - 3 * intervals.DAY).alias("now")))  # one row
    rows = b.crossJoin(now).where("start >= now").withColumn("day", F.floor(F.col("start") / intervals.DAY))
    return rows.groupBy("day", "calendar_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("micros"))


@query
def sender_counts(s, d):
    """Messages and unread messages of each sender's address parts."""
    m = V.messages(s, d).select(T.local_part(F.col("sender")).alias("local"), T.org_from_domain(F.col("sender")).alias("org"), "read_status")
    return m.groupBy("local", "org").agg(F.count("*").alias("n"), F.count_if(F.col("read_status") == "unread").alias("unread"))


@query
def first_claimant(s, d):
    """Customers that place orders under names that others use too: whose entity each name belongs to, by the order of the orders."""
    o = V.table(s, d, "orders").select(F.lit("person").alias("kind"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("span"), F.col("o_orderkey").alias("place"))
    none = s.createDataFrame([], "entity_id string, kind string, key string, vec array<double>")
    _, claimed = resolution.resolve_all(o, none, none.select("kind", "key", "entity_id"), none.select("kind", "key", "vec"))
    return claimed.select("name", "entity_id", "place")


@query
def table_counts(s, d):
    """Rows of each derived table."""
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return one("messages", V.messages(s, d)).unionByName(one("mentions", V.mentions(s, d))).unionByName(one("chunks", V.chunks(s, d))).unionByName(one("feedback", V.feedback_log(s, d)))


@query
def match_vector(s, d):
    n = V.names(s, d)
    return retrieval.match_vector(n.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "id"), n.where("vec_id % 4 != 0").withColumnRenamed("vec_id", "entity_id"))
