"""Catalog queries of the model stages and of whole refreshes, each beside the SQL it must equal where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import mail as MAIL
from tidemark.functions import text as T
from tidemark.operators import maintain, queue, refresh, stages
from tidemark.plans import oracles as O
from tidemark.plans.registry import registry
from tidemark.sources import views as V
from tidemark.sources.tables import keep, parts
from tidemark.streaming import streams

query, QUERIES, ORACLE_SQL = registry()


def _mail(s, d):
    """Messages whose body is their subject and category."""
    return V.messages(s, d).withColumn("body", F.concat_ws(". ", "subject", "category"))


def _wants_reply(rows):
    """A stand-in for a model: whether a message asks something; it fails on newsletters."""
    if any("newsletter" in r["subject"] for r in rows):
        raise ValueError("refused")
    return ["?" in r["subject"] or "please" in r["subject"].lower() for r in rows]


def _words(rows):
    return [r["body"].split() for r in rows]


def _loud(rows):
    return ["URGENT " if r["subject"].isupper() or "URGENT" in r["subject"] else "high" for r in rows]


@query("""select email_id, case when is_no_reply is null and not contains(subject, 'newsletter') then not (contains(subject, '?') or contains(lower(subject), 'please')) end as classified,
  case when is_no_reply is null and contains(subject, 'newsletter') then 'refused' end as error from msg""", O._MSG)
def stage_classify(s, d):
    return stages.run_stage(_mail(s, d), stages.STAGES["classify"], _wants_reply).select("email_id", F.col("classify").alias("classified"), F.col("classify_error").alias("error"))


@query("select email_id, case when coalesce(is_no_reply, false) then 'medium' when contains(subject, 'URGENT') then 'urgent' else 'high' end as level from msg", O._MSG)
def stage_score(s, d):
    return stages.run_stage(_mail(s, d), stages.STAGES["score_level"], _loud).select("email_id", F.col("score_level").alias("level"))


@query("select email_id, coalesce(array_to_string(list_filter(string_split_regex(trim(subject || '. ' || category), '\\s+'), lambda w: length(w) >= 6 and regexp_matches(w, '^[\\p{L}\\p{N}]') and regexp_matches(w, '[A-Za-z]{2}'))[1:8], '|'), '') as items from msg", O._MSG)
def stage_items(s, d):
    return stages.run_stage(_mail(s, d), stages.STAGES["action_items"], _words).select("email_id", F.array_join("action_items", "|").alias("items"))


@query("select email_id, case when not coalesce(is_no_reply, true) then array_to_string(string_split_regex(trim(subject || '. ' || category), '\\s+')[1:5], '|') end as outline from msg", O._MSG)
def stage_outline(s, d):
    return stages.run_stage(_mail(s, d), stages.STAGES["outline"], _words).select("email_id", F.array_join("outline", "|").alias("outline"))


def _bullets(rows):
    """A stand-in for a model: nothing to say of thanks, else three bullets, and all words with digits for dates."""
    said = lambda r: ["", " .. ", "x"] if r["subject"] == "Thanks" else [r["subject"] + ".", "cut off. here", "..", "A fourth."]
    return [{"bullets": said(r), "dates": [w for w in r["body"].split() if any(c.isdigit() for c in w)] * 6} for r in rows]


@query("""select email_id, case when subject <> 'Thanks' then subject || '.' || chr(10) || 'cut off.' end as summary, case when subject <> 'Thanks' then coalesce(array_to_string(list_concat(ds, ds, ds, ds, ds)[1:5], '|'), '') end as dates, case when subject = 'Thanks' then 'empty summary' end as error
  from (select *, list_filter(string_split_regex(subject || '. ' || category, '\\s+'), lambda w: regexp_matches(w, '[0-9]')) as ds from msg)""", O._MSG)
def stage_summarize(s, d):
    done = stages.run_stage(_mail(s, d), stages.STAGES["summarize"], _bullets)
    return done.select("email_id", "summarize.summary", F.array_join("summarize.dates", "|").alias("dates"), F.col("summarize_error").alias("error"))


@query("select email_id, left(coalesce(nullif(array_to_string((string_split_regex(trim(regexp_replace(lower(subject), '[\"''.]', '', 'g')), '\\s+'))[1:3], ' '), ''), 'other'), 40) as topic from msg", O._MSG)
def stage_categorize(s, d):
    return stages.run_stage(_mail(s, d), stages.STAGES["categorize"], lambda rows: [r["subject"] for r in rows]).select("email_id", F.col("categorize").alias("topic"))


@query("select email_id, case when coalesce(is_scheduling, false) then subject end as title, case when coalesce(is_scheduling, false) then '2026-01-02T10:00:00Z' end as start from msg", O._MSG)
def stage_propose(s, d):
    fn = lambda rows: [{"title": r["subject"], "start": "2026-01-02T10:00:00Z", "end": "2026-01-02T11:00:00Z"} for r in rows]
    return stages.run_stage(_mail(s, d), stages.STAGES["propose_event"], fn).select("email_id", "propose_event.title", "propose_event.start")


@query("select email_id, case when email_id % 4 <> 0 and email_id % 3 = 1 then 'Dear all: one / ' || subject end as draft from msg", O._MSG)
def stage_expand(s, d):
    e = F.col("email_id")
    m = _mail(s, d).withColumns({"draft": F.when(e % 4 == 0, "kept"), "outline": F.when(e % 3 == 1, F.array(F.lit("one"), "subject")).when(e % 3 == 2, F.array().cast("array<string>"))})
    return stages.run_stage(m, stages.STAGES["expand"], lambda rows: ["]} Dear all: " + r["body"].replace("\n", " / ") for r in rows]).select("email_id", F.col("expand").alias("draft"))


@query("select email_id, least(len(ws), 4)::int as projects, least(len(ws), 8)::int as ids, case when email_id % 2 = 0 then 1.0::double else 0.5::double end as confidence, left(ws[1], 40) as topic from (select email_id, string_split_regex(trim(subject || '. ' || category || ' ' || (email_id % 2)), '\\s+') as ws from msg)", O._MSG)
def stage_extract(s, d):
    def fn(rows):
        words = [r["body"].split() for r in rows]
        return [{"projects": w, "deliverables": w, "topics": w, "primary_ids": w, "case_ids": w, "confidence": 7.5 if w[-1] == "0" else None} for w in words]

    m = _mail(s, d).withColumn("body", F.concat_ws(" ", "body", (F.col("email_id") % 2).cast("string")))
    done = stages.run_stage(m, stages.STAGES["extract_names"], fn).select("email_id", "extract_names.*")
    return done.select("email_id", F.size("projects").alias("projects"), F.size("case_ids").alias("ids"), "confidence", F.element_at("topics", 1).alias("topic"))


@query("""select node_id, case when emails > 3 then headline end as headline, case when emails > 3 then least(n, 8)::int end as items, case when emails > 3 then lines end as lines, case when emails <= 3 then 'empty brief' end as error from (
  select thread_id::varchar as node_id, count(*) as emails, 'State document for thread ' || thread_id || '. Evidence emails:' as headline, least(count(*), 100)::int as n,
    md5(left(string_agg('- From ' || sender || ', ' || strftime(received_at, '%Y-%m-%d') || ', re: ' || subject || ': ' || case when email_id % 14 <> 0 then subject else category end, chr(10) order by received_at, email_id) filter (nth <= 100), 2000)) as lines
  from (select *, row_number() over (partition by thread_id order by received_at desc, email_id desc) as nth from msg) group by thread_id)""", O._MSG)
def stage_brief(s, d):
    """A brief of every thread by a stand-in that repeats its evidence and has nothing to say of few messages."""
    def fn(rows):
        lines = [r["evidence"].split("\n") for r in rows]
        return [{"headline": x[0], "body": "\n".join(x[1:]), "open_items": x[1:]} if len(x) > 4 else {"headline": " ", "body": "", "open_items": None} for x in lines]

    m = V.processed(s, d).withColumn("body", F.col("category"))
    pairs = m.select(F.lit("thread").alias("node_type"), F.col("thread_id").cast("string").alias("node_id"), "email_id")
    n = parts(s, V.table(s, d, "events").count(), 50_000)
    nodes = keep(stages.evidence_lines(pairs, m.select("email_id", "sender", "received_at", "subject", "summary", "body"), n=n), "evidence_lines")
    done = stages.run_stage(nodes, stages.STAGES["brief"], fn, "node_id", n)
    return done.select("node_id", "brief.headline", F.when(F.col("brief").isNotNull(), F.size("brief.open_items")).alias("items"), F.md5("brief.body").alias("lines"), F.col("brief_error").alias("error"))


@query("select email_id, case when email_id % 6 = 0 then '0.0|0.0' else round(3.0 / sqrt(9.0 + length(subject) * length(subject)), 4) || '|' || round(length(subject) / sqrt(9.0 + length(subject) * length(subject)), 4) end as vec from msg", O._MSG)
def stage_embed(s, d):
    m = V.messages(s, d).withColumn("body", F.when(F.col("email_id") % 6 != 0, F.col("subject")).otherwise(" "))
    done = stages.embedded(m, lambda rows: [[3.0, float(len(r["body"]))] for r in rows])
    return done.select("email_id", F.array_join(F.transform("embed", lambda v: F.round(v.cast("double"), 4).cast("string")), "|").alias("vec"))


@query(f"select email_id, case when not coalesce(is_no_reply, true) then array_to_string(list_concat(string_split_regex(trim(subject || '. ' || category), '\\s+')[1:5], case when coalesce(is_scheduling, false) then [case when email_id % 5 = 0 then {O._lit(MAIL.NO_CALENDAR)} when email_id % 5 = 1 then {O._lit(MAIL.NONE_FREE)} else {O._lit(MAIL.OFFER)} || 'Mon 10:00' end] else [] end), '|') end as outline from msg", O._MSG)
def stage_outline_with_time(s, d):
    e = F.col("email_id") % 5
    m = _mail(s, d).withColumns({"calendar_read": e != 0, "slots": F.when(e > 1, F.array(F.lit("Mon 10:00"))).otherwise(F.array().cast("array<string>"))})
    return stages.with_free_time(stages.run_stage(m, stages.STAGES["outline"], _words)).select("email_id", F.array_join("outline", "|").alias("outline"))


def _joined(rows):
    return [" / ".join(r["texts"].split("\n")) for r in rows]


@query("select thread_id as group_id, string_agg(subject, ' / ' order by email_id) as said from (select * from msg qualify row_number() over (partition by thread_id order by email_id) <= 20) group by thread_id", O._MSG)
def summarize_selection(s, d):
    rows = V.messages(s, d).select(F.col("thread_id").alias("group_id"), F.col("email_id").alias("place"), F.col("subject").alias("text"))
    return stages.summarize_groups(rows, _joined).select("group_id", F.col("value").alias("said"))


def _ids(s, d):
    """Ids of the subjects as mentions, and a model's word on them: every second message is about its first id, every third says it is a case."""
    m = V.messages(s, d).select("email_id", F.explode(T.find_ids(F.col("subject"))).alias("i"))
    found = m.select("email_id", "i.kind", T.normalize_id(F.col("i.id")).alias("key"), F.col("i.id").alias("span"), F.lit("regex").alias("source"), F.lit(0.9).alias("confidence"))
    none = F.array().cast("array<string>")
    e = F.col("email_id")
    said = m.select("email_id", F.when(e % 2 == 0, F.array(F.lit("other"))).otherwise(none).alias("primary_ids"), F.when(e % 3 == 0, F.array("i.id")).otherwise(none).alias("case_ids"), F.array(F.lit("The Alpha Project"), F.lit("a@b.co")).alias("projects"), F.array(F.lit("Reports"), F.lit("alpha")).alias("deliverables"), none.alias("topics"), (e % 4 / 2.0).alias("confidence"))
    return found, said


_IDS = """ids as (select email_id, unnest(list_filter([nullif(regexp_extract(subject, '\\b([A-Z]{2,10}-\\d{1,6}(-\\d{1,6})?)\\b', 1), ''), nullif(regexp_extract(subject, '(#\\d{3,})', 1), '')], lambda x: x is not null)) as span from msg),
 kinds as (select *, upper(regexp_replace(span, '[^A-Za-z0-9_]+', '', 'g')) as key, string_split(span, '-')[1] as prefix from ids)"""


@query("""select email_id, case when prefix in ('CS') or span like '#%' then 'case' when email_id % 3 = 0 and prefix not in ('INV', 'RMA', 'SN') then 'case' else 'document' end as kind, key, case when email_id % 2 = 0 then 0.4::double else 0.9::double end as confidence from kinds
  union all select email_id, unnest(['project', 'deliverable']), unnest(['alpha', 'report']), least(1.0::double, email_id % 4 / 2.0::double) from kinds""", O._MSG, _IDS)
def extract_full(s, d):
    return stages.extract_full(*_ids(s, d)).select("email_id", "kind", "key", F.col("confidence").cast("double").alias("confidence"))


@query("select event_id as email_id, array_to_string(list_filter([case when event_id % 10 >= 8 or event_id not in (select doc_id from documents) then 'chunk' end, case when event_id not in (select vec_id from embeddings) then 'embed' end, case when event_id not in (select o_orderkey from orders) then 'extract' end], lambda x: x is not null), ',') as stages from events where event_id % 10 >= 8 or event_id not in (select doc_id from documents) or event_id not in (select vec_id from embeddings) or event_id not in (select o_orderkey from orders)")
def due_context_stages(s, d):
    ids = lambda df, c: df.select(F.col(c).alias("email_id"))
    coverage = {"chunk": ids(V.chunks(s, d).where("kind = 'body'"), "chunk_id"), "embed": ids(V.table(s, d, "embeddings"), "vec_id"), "extract": ids(V.table(s, d, "orders"), "o_orderkey")}
    return refresh.due_context_stages(V.messages(s, d), coverage).select("email_id", F.array_join("stages", ",").alias("stages"))


@query("select email_id, array_to_string(list_filter(stages, lambda x: x <> 'classify'), ',') as stages from (" + O._STAGES + ") where len(list_filter(stages, lambda x: x <> 'classify')) > 0", O._MSG, O._PROC)
def stage_skip(s, d):
    return refresh.skip_stages(maintain.due_stages(V.processed(s, d)), "classify").select("email_id", F.array_join("stages", ",").alias("stages"))


def _stages():
    """Stand-ins for three stages: they set what they are asked for; the outline only where a message may be answered."""
    false = lambda column: lambda df: df.withColumn(column, F.lit(False))
    may = maintain.eligible(F.col("is_no_reply"))
    return {"classify": false("is_no_reply"), "scheduling": false("is_scheduling"), "outline": lambda df: df.withColumn("outline_points", F.when(may, 2).otherwise(F.col("outline_points")))}


def _refreshed(some: str) -> list[str]:
    """Views of the messages of a refresh: after the stages, with corrections and scores."""
    new = "not processed"
    ran = f"""msg2 as (select * replace (case when {new} or is_no_reply is null then false else is_no_reply end as is_no_reply, case when {new} or is_scheduling is null then false else is_scheduling end as is_scheduling,
      case when {new} or ({O._DUE["outline"]}) then case when {new} or is_no_reply is null or not is_no_reply then 2 else outline_points end else outline_points end as outline_points) from proc where {some})"""
    return [O._MSG, O._PROC, ran, O._SIG.replace("from msg", "from msg2"), O._LOG, O._PRIORS, O._FED]


_SPREAD = f"select email_id, level, is_no_reply, coalesce(outline_points, -1) as outline_points, score, round({O._FLOOR} + 25.0::double * row_number() over (partition by level order by score, received_at, email_id) / (count(*) over (partition by level) + 1), 6) as spread from done"
_ROWS = lambda: ["email_id", "level", "is_no_reply", F.coalesce("outline_points", F.lit(-1)).alias("outline_points"), "score", "spread"]


@query(_SPREAD, *_refreshed("true"))
def refresh_job(s, d):
    """The messages after a whole refresh."""
    m = V.processed(s, d)
    todos = maintain.desired_todos(m.where("email_id % 2 = 0")).withColumn("status", F.lit("open"))
    return refresh.refresh(m, V.feedback_log(s, d), todos, _stages(), V.OWNER)["spread"].select(*_ROWS())


@query(_SPREAD, *_refreshed("email_id in (select o_orderkey from orders where o_orderkey % 7 = 0)"))
def refresh_subset(s, d):
    """The messages of some ids after a refresh of these alone."""
    m, ids = V.processed(s, d), V.table(s, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("email_id"))
    todos = maintain.desired_todos(m).withColumn("status", F.lit("open"))
    return refresh.refresh_subset(m, ids, V.feedback_log(s, d), todos, _stages(), V.OWNER)["spread"].select(*_ROWS())


@query("select level, is_no_reply, email_id, old from (select email_id, case when coalesce(is_no_reply, false) and level in ('high', 'urgent') then 'medium' else level end as old, 'urgent' as level, coalesce(prior_no_reply, is_no_reply) as is_no_reply, is_no_reply as old_no_reply from msg left join priors using (sender) where sender = 'u3@example.com') where old <> level or is_no_reply is distinct from old_no_reply", O._MSG, O._LOG, O._PRIORS)
def feedback_cycle(s, d):
    """The messages that a new correction of one sender changes."""
    log = V.feedback_log(s, d)
    one = s.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("U 3 <u3@example.com>").alias("sender"), F.lit("level").alias("kind"), F.lit("urgent").alias("value"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("created_at"))
    return refresh.feedback_cycle(V.messages(s, d), log, one, V.OWNER)["affected"].select("email_id", F.col("old_level").alias("old"), "level", "is_no_reply")


@query("select email_id, thread_id from (select *, max(received_at) over (partition by thread_id) as newest from msg) where outline_points is not null and received_at < newest", O._MSG)
def stream_stale(s, d):
    """Stale outlines as messages land, by the state of their threads."""
    e = streams.events(s, d)
    landing = e.select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("email_id"), F.col("ts").alias("received_at"), (F.col("event_id") % 6 != 0).alias("has_outline"))
    with streams.keyed_state(s):
        return streams.drain(streams.stale_outlines(landing), "append").select("email_id", "thread_id")


@query("select email_id, level, is_no_reply, (select count(*) from log where kind = 'level' and sender = 'u3@example.com') as cleared from (select *, is_no_reply is distinct from coalesce(prior_no_reply, is_no_reply) as marked from (select email_id, sender, case when coalesce(is_no_reply, false) and level in ('high', 'urgent') then 'medium' else level end as level, is_no_reply from msg where sender = 'u3@example.com') left join priors using (sender)) m where marked".replace("select email_id, level, is_no_reply, (", "select email_id, level, coalesce(prior_no_reply, is_no_reply) as is_no_reply, ("), O._MSG, O._LOG, O._PRIORS)
def feedback_cleared(s, d):
    """The messages of a sender that corrections still change once those of its level are cleared."""
    gone = s.createDataFrame([("U 3 <U3@example.com>",)], "sender string")
    made = refresh.feedback_cleared(V.messages(s, d), V.feedback_log(s, d), gone, V.OWNER, "level")
    cleared = F.broadcast(made["cleared"].agg(F.count("*").alias("cleared")))  # one row
    return made["affected"].crossJoin(cleared).select("email_id", "level", "is_no_reply", "cleared")
