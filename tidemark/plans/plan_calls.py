"""Catalog queries of resolution and of calendar decisions, each beside the SQL it must equal where there is one."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import calendars, chunking, graph, intervals, merge, resolution, serving
from tidemark.plans import oracles as O
from tidemark.plans.mail import _CASES, _SAL
from tidemark.plans.registry import registry
from tidemark.sources import views as V

query, QUERIES, ORACLE_SQL = registry()
_H = intervals.HOUR


def _proposals(s, d):
    """Each message proposes an hour or more on its thread's calendar, some days before or after the newest message."""
    m = V.messages(s, d)
    start = F.unix_micros("received_at") + (F.col("email_id") % 5) * intervals.DAY
    length = F.when(F.col("email_id") % 7 == 0, 30).otherwise(1) * _H
    title = F.when(F.col("email_id") % 3 == 0, F.concat(F.lit("Event  "), F.col("category"), F.lit("."))).otherwise(F.col("subject"))
    return m.select("email_id", F.col("thread_id").alias("calendar_id"), title.alias("title"), start.alias("start"), (start + length).alias("end"), F.when(F.col("email_id") % 11 == 0, "approved").otherwise("suggested").alias("status"))


def _events(s, d):
    e = V.busy(s, d).join(V.table(s, d, "events").select("event_id", "event_type"), "event_id")
    return e.select("event_id", "calendar_id", F.concat(F.lit("event "), "event_type").alias("title"), "start", "end", (F.col("event_id") % 10 == 0).alias("all_day"))


_PROP = f"""prop as (select email_id, thread_id as calendar_id, case when email_id % 3 = 0 then 'event ' || category else lower(subject) end as title, epoch_us(received_at) + (email_id % 5) * {intervals.DAY} as s,
  epoch_us(received_at) + (email_id % 5) * {intervals.DAY} + case when email_id % 7 = 0 then 30 else 1 end * {_H} as e, email_id % 11 <> 0 as suggested from msg),
 ev as (select event_id, calendar_id, 'event ' || event_type as title, s, e from busy join events using (event_id) where e > s and event_id % 10 <> 0),
 hit as (select email_id, arg_min(event_id, (case when p.title = ev.title then 0 else 1 end, ev.s, event_id)) as event_id, min(case when p.title = ev.title then 0 else 1 end) as rank
   from prop p join ev on ev.calendar_id = p.calendar_id and p.s < ev.e and ev.s < p.e group by email_id)"""


@query("select email_id, case rank when 0 then 'duplicate' when 1 then 'conflict' else 'clear' end as verdict, coalesce(hit.event_id, -1) as event_id from prop left join hit using (email_id)", O._MSG, O._BUSY, _PROP)
def check_slots(s, d):
    return calendars.check_slots(_proposals(s, d), _events(s, d)).withColumn("event_id", F.coalesce("event_id", F.lit(-1)))


_NOW = "(select epoch_us(max(received_at)) from msg)"


@query(f"select email_id, e - s as micros from prop where suggested and s >= {_NOW} and e - s <= {24 * _H}", O._MSG, O._BUSY, _PROP)
def plausible_events(s, d):
    now = F.broadcast(V.messages(s, d).agg(F.unix_micros(F.max("received_at")).alias("now")))  # one row
    return calendars.plausible(_proposals(s, d).crossJoin(now), F.col("now")).select("email_id", (F.col("end") - F.col("start")).alias("micros"))


@query(f"""select email_id, case when not (suggested and s >= {_NOW} and e - s <= {24 * _H} and email_id % 4 <> 0) then 'leave' when rank = 0 then 'adopt' when rank = 1 then 'leave' else 'create' end as decision,
  case when suggested and s >= {_NOW} and e - s <= {24 * _H} and email_id % 4 <> 0 and rank = 0 then hit.event_id else -1 end as event_id from prop left join hit using (email_id)""", O._MSG, O._BUSY, _PROP)
def auto_add(s, d):
    p = _proposals(s, d)
    now = V.messages(s, d).agg(F.unix_micros(F.max("received_at"))).first()[0] or 0
    contexts = p.select("email_id", (F.col("start") - _H).alias("range_start"), (F.col("end") - F.when(F.col("email_id") % 4 == 0, 1).otherwise(0)).alias("range_end"))
    return calendars.auto_add(p, contexts, _events(s, d), F.lit(now)).withColumn("event_id", F.coalesce("event_id", F.lit(-1)))


@query("select email_id, range_start from (select email_id, s - 3600000000 as range_start, e - case when email_id % 4 = 0 then 1 else 0 end as range_end, s, e from prop) where range_start <= s and e <= range_end", O._MSG, O._BUSY, _PROP)
def events_in_window(s, d):
    p = _proposals(s, d).drop("status")
    contexts = p.select("email_id", (F.col("start") - _H).alias("range_start"), (F.col("end") - F.when(F.col("email_id") % 4 == 0, 1).otherwise(0)).alias("range_end"))
    return calendars.covered(p, contexts).select("email_id", (F.col("start") - _H).alias("range_start"))


@query("""select email_id, case when email_id % 4 in (0, 1) then case when email_id % 2 = 0 then category else 'Meeting with ' || sender end end as title, case when email_id % 4 in (0, 1) then epoch_us(date_trunc('second', received_at)) else -1 end as start,
  case when email_id % 4 in (0, 1) then 'suggested' else 'none' end as status from msg""", O._MSG)
def proposals(s, d):
    e = F.col("email_id") % 4
    at = F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss")
    later = F.date_format(F.col("received_at") + F.expr("interval 1 hour"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    m = V.messages(s, d).select("email_id", "sender", F.when(e % 2 == 0, F.col("category")).otherwise(" ").alias("title"), at.alias("start"), F.when(e < 2, later).when(e == 2, at).otherwise("soon").alias("end"))
    return calendars.validate_proposals(m).select("email_id", "title", F.coalesce("start", F.lit(-1)).alias("start"), "status")


@query("select calendar_id, s - 600000000 as start, e + 600000000 as end_, (s + 899999999) // 900000000 * 900000000 as on_grid from busy where e > s", O._BUSY)
def padded_busy(s, d):
    b = V.busy(s, d).where("end > start").withColumn("on_grid", calendars.ceil_to(F.col("start"), 15, "UTC"))
    return calendars.pad(b, 10).select("calendar_id", "start", F.col("end").alias("end_"), "on_grid")


def _ranges(s, d):
    return V.busy(s, d).groupBy("calendar_id").agg(F.min("start").alias("from"), F.max("end").alias("to"))


_WD = f"""rng as (select calendar_id, min(s) as f, max(e) as t from busy group by calendar_id),
 days as (select calendar_id, f, t, unnest(generate_series(f // {intervals.DAY}, t // {intervals.DAY})) as day from rng),
 wd as (select calendar_id, greatest(f, day * {intervals.DAY} + 9 * {_H}) as f, least(t, day * {intervals.DAY} + 17 * {_H}) as t from days where (day + 3) % 7 < 5)"""


@query("select calendar_id, f as \"from\", t as \"to\" from wd where f < t", O._BUSY, _WD)
def working_hours(s, d):
    return intervals.working_windows(_ranges(s, d), "UTC")


_PADDED = O._MERGED.replace("from busy where e > s", "from (select calendar_id, s - 600000000 as s, e + 600000000 as e from busy) where e > s")
_SLOTS = f"""cut2 as (select w.calendar_id, f, t, s, e from wd w join merged m on m.calendar_id = w.calendar_id and s < t and e > f and f < t union all select calendar_id, f, t, t, t from wd where f < t),
 fr as (select calendar_id, greatest(coalesce(lag(e) over (partition by calendar_id, f, t order by s, e), f), f) as a, s as b from cut2),
 st as (select calendar_id, (greatest(a, (select min(s) from busy) + {_H}) + 899999999) // 900000000 * 900000000 as start, b from fr where a < b),
 dl as (select calendar_id, start // {intervals.DAY} as day, min(start) as start from st where start + 1800000000 <= b group by all)"""


@query("select calendar_id, row_number() over (partition by calendar_id order by day)::int as nth, start, start + 1800000000 as end_ from dl qualify nth <= 3", O._BUSY, _WD, _PADDED, _SLOTS)
def open_slots(s, d):
    now = V.busy(s, d).agg(F.min("start")).first()[0] or 0
    return calendars.suggest_slots(_ranges(s, d), V.busy(s, d), F.lit(now), padding=10).withColumnRenamed("end", "end_")


@query("select email_id, case email_id % 3 when 0 then 'America/Los_Angeles' else 'UTC' end as zone from msg", O._MSG)
def zones(s, d):
    known = s.createDataFrame([(z,) for z in sorted(zoneinfo.available_timezones())], "zone string")
    name = F.when(F.col("email_id") % 3 == 0, "America/Los_Angeles").when(F.col("email_id") % 3 == 1, "Mars/Base")
    return calendars.with_zone(V.messages(s, d).select("email_id", name.alias("zone")), "zone", known)


# resolution


@query("select id, entity_id, score from nr", O._NAMES)
def near_entities(s, d):
    """The pairs of names that are near enough, one in four names against the others."""
    n = V.names(s, d)
    return resolution.near(n.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "id"), n.where("vec_id % 4 != 0").withColumnRenamed("vec_id", "entity_id"))


@query()
def resolve_names(s, d):
    """Every name twice, the second time with an article, resolved against one in four that is known, in the order of their numbers."""
    n = V.names(s, d)
    entities = n.where("vec_id % 4 = 0").select(F.concat(F.lit("e"), "vec_id").alias("entity_id"), "kind", "key", "vec")
    aliases = n.where("vec_id % 12 = 1").select("kind", "key", F.concat(F.lit("e"), F.col("vec_id") - 1).alias("entity_id"))
    some = n.select("vec_id", "kind", "key", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    mentions = some.select("kind", "key", F.when(F.col("again") == 0, F.col("key")).otherwise(F.concat(F.lit("The "), "key")).alias("span"), (F.col("vec_id") * 2 + F.col("again") * 101).alias("place"))
    return resolution.resolve(mentions, entities, aliases, n.select("kind", "key", "vec"))


@query("select kind, entity_id, min(email_id) as first_email from men where kind = 'project' group by kind, entity_id", O._MEN)
def texts_to_embed(s, d):
    m = V.mentions(s, d).select("kind", F.col("entity_id").alias("key"), F.col("email_id").cast("string").alias("span"), F.col("email_id").alias("place"))
    return resolution.texts_to_embed(m.where("kind != 'org'")).select("kind", F.col("key").alias("entity_id"), F.col("text").cast("long").alias("first_email"))


@query("select rung, sum(n)::bigint as n from (select case when k % 2 = 0 then 'exact' when k % 3 = 0 then 'alias' else 'new' end as rung, case when k % 2 = 0 or k % 3 = 0 then n else 1 end as n from (select substr(entity_id, 6)::bigint as k, count(*) as n from men where kind = 'case' group by entity_id) union all select 'exact', n - 1 from (select substr(entity_id, 6)::bigint as k, count(*) as n from men where kind = 'case' group by entity_id) where k % 2 <> 0 and k % 3 <> 0) where n > 0 group by rung", O._MEN)
def rung_counts(s, d):
    """How the mentions of cases resolve where even ones are known and every third has an alias: the others are new once."""
    m = V.mentions(s, d).where("kind = 'case'").select("kind", F.col("entity_id").alias("key"), F.col("entity_id").alias("span"), F.monotonically_increasing_id().alias("place"))
    number = F.substring_index("key", ":", -1).cast("long")
    one = m.select("kind", "key").distinct()
    entities = one.where(number % 2 == 0).select(F.col("key").alias("entity_id"), "kind", "key", F.array().cast("array<float>").alias("vec"))
    aliases = one.where(number % 3 == 0).select("kind", "key", F.lit("case:0").alias("entity_id"))
    return resolution.rung_counts(resolution.resolve(m, entities, aliases, one.withColumn("vec", F.array().cast("array<float>"))))


# days and listings


@query(f"""select case when event_id % 10 = 0 then make_timestamp(s)::date else make_timestamp(s - 5 * {_H})::date end as day,
  date_trunc('week', case when event_id % 10 = 0 then make_timestamp(s)::date else make_timestamp(s - 5 * {_H})::date end)::date as week, count(*) as n from busy group by all""", O._BUSY)
def events_by_local_day(s, d):
    return serving.events_by_day(_events(s, d), "Etc/GMT+5").select("day", "week", "n")


@query(f"""select make_timestamp(start)::date as day, start, kind, title, count(*) filter (kind = 'event') over (partition by make_timestamp(start)::date) as confirmed, count(*) filter (kind = 'proposal') over (partition by make_timestamp(start)::date) as proposed
  from (select 'event' as kind, 'event ' || event_type as title, s as start from busy join events using (event_id) union all select 'proposal', case when email_id % 3 = 0 then 'Event  ' || category || '.' else subject end,
    epoch_us(received_at) + (email_id % 5) * {intervals.DAY} from msg where email_id % 11 <> 0) where start >= {_NOW} - 2 * {intervals.DAY} and start <= {_NOW} + {intervals.DAY}""", O._MSG, O._BUSY)
def agenda_with_proposals(s, d):
    now = V.messages(s, d).agg(F.unix_micros(F.max("received_at"))).first()[0] or 0
    return serving.agenda(_events(s, d), _proposals(s, d), F.lit(now - 2 * intervals.DAY), F.lit(now + intervals.DAY))


@query("""select entity_id, salience, mentions, coalesce(aliases, '') as aliases, (select count(*) from sal where kind = 'case') as total, (select count(*) > 25 from sal where kind = 'case') as truncated
  from sal left join (select 'case:' || s_suppkey as entity_id, s_name as aliases from supplier where s_suppkey % 2 = 0) using (entity_id) where kind = 'case' order by salience desc, mentions desc, entity_id limit 25""", O._MEN, _CASES, _SAL)
def list_entities(s, d):
    m = V.mentions(s, d).where("kind in ('case', 'project')")
    per = graph.salience(m, "kind")
    names = V.table(s, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("case:"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("alias"))
    return serving.listing(per, names, "case").withColumn("aliases", F.array_join("aliases", ","))


_SENDER = "case when e % 9 = 0 then 'No-Reply <noreply@example.com>' when e % 9 = 1 then 'alerts@example.com' else sender end"


@query(f"""select e as email_id, case when e % 9 = 0 then 'sender local-part matches no-reply pattern (noreply@...)' when e % 8 = 0 then 'Precedence header indicates bulk mail (Precedence: bulk)'
  when e % 6 = 0 and e % 12 <> 0 then 'List-Unsubscribe present with no distinct reply-to address' when e % 9 = 1 and e % 6 = 0 then 'sender matches automated pattern (alerts@...) corroborated by bulk headers'
  when e % 9 <> 1 and e % 6 <> 0 and e % 7 <> 0 then 'personal sender, no bulk headers' end as reason from (select email_id as e from msg)""", O._MSG)
def no_reply_reasons(s, d):
    e = F.col("email_id")
    sender = F.when(e % 9 == 0, "No-Reply <noreply@example.com>").when(e % 9 == 1, "alerts@example.com").otherwise(F.col("sender"))
    reason = T.no_reply_reason(sender, F.when(e % 8 == 0, "bulk"), e % 6 == 0, F.when(e % 7 == 0, "auto-generated"), F.when(e % 12 == 0, "Desk <desk@example.com>"))
    return V.messages(s, d).select("email_id", reason.alias("reason"))


@query("select level, count(*) as n, floor(100.0::double * count(*) / greatest((select count(*) from msg), 1) + 0.5)::bigint as percent, floor(100.0::double * (select count(*) from msg where is_no_reply) / greatest((select count(*) from msg), 1) + 0.5)::bigint as no_reply_percent from msg group by level", O._MSG)
def level_and_no_reply_share(s, d):
    m = V.messages(s, d)
    all_ = F.broadcast(m.agg(F.count("*").alias("total"), F.count_if(F.coalesce("is_no_reply", F.lit(False))).alias("none")))  # one row
    percent = lambda x: F.floor(100.0 * F.col(x) / F.greatest("total", F.lit(1)) + 0.5).cast("long")
    return m.groupBy("level").agg(F.count("*").alias("n")).crossJoin(all_).select("level", "n", percent("n").alias("percent"), percent("none").alias("no_reply_percent"))


_ADDR = "list_distinct(list_filter([sender, case when contains(coalesce(to_line, ''), 'owner@') then 'owner@example.com' end, case when contains(coalesce(to_line, ''), 'team@') then 'team@example.com' end, case when contains(lower(coalesce(cc_line, '')), 'owner@') then 'owner@example.com' end, case when contains(coalesce(cc_line, ''), 'other@') then 'other@example.com' end], lambda x: x is not null))"


@query(f"""select email_id, 'person' as kind, unnest({_ADDR}) as key from msg union all select email_id, 'org', 'example' from msg
  union all select email_id, 'person', 'ops@example.org' from msg where contains(subject, 'ops@example.org')
  union all select email_id, case when string_split(span, '-')[1] = 'CS' or span like '#%' then 'case' else 'document' end, upper(regexp_replace(span, '[^A-Za-z0-9_]+', '', 'g'))
   from (select email_id, unnest(list_filter([nullif(regexp_extract(subject, '\\b([A-Z]{{2,10}}-\\d{{1,6}}(-\\d{{1,6}})?)\\b', 1), ''), nullif(regexp_extract(subject, '(#\\d{{3,}})', 1), '')], lambda x: x is not null)) as span from msg)""", O._MSG)
def header_mentions(s, d):
    return chunking.header_mentions(V.messages(s, d)).select("email_id", "kind", "key")


@query("select vec_id, label from embeddings where vec_id in (select doc_id from documents where doc_id % 3 <> 0)")
def cascade(s, d):
    """The vectors of the chunks that are left once one in three is replaced by nothing."""
    return merge.cascade(V.table(s, d, "embeddings").withColumn("chunk_id", F.col("vec_id")), V.chunks(s, d).where("chunk_id % 3 != 0"), "chunk_id").select("vec_id", "label")


@query("select o_custkey as entity_id, count(distinct o_orderpriority) as n from orders where o_custkey % 5 <> 0 group by o_custkey")
def insert_aliases(s, d):
    o = V.table(s, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.when(F.col("o_custkey") % 5 != 0, F.lower("o_orderpriority")).otherwise(" ").alias("normalized_alias"), F.col("o_orderpriority").alias("alias"))
    old = merge.latest(o.where("entity_id % 5 != 0 and entity_id % 2 = 0"), ["entity_id", "normalized_alias"], F.col("alias"))
    return merge.insert_aliases(old, o).groupBy("entity_id").agg(F.count("*").alias("n"))


_BODY_IDS = "unnest(list_distinct(list_concat(regexp_extract_all(text, '\\b([A-Z]{2,10}-\\d{1,6}(?:-\\d{1,6})?)\\b', 1), regexp_extract_all(text, '(#\\d{3,})', 1))))"
_KIND = "case when split_part(span, '-', 1) in (" + ", ".join(map(O._lit, T.CASE_PREFIXES)) + ") or span like '#%' then 'case' else 'document' end"
_KEY = "upper(regexp_replace(span, '[^A-Za-z0-9_]+', '', 'g'))"


@query(f"""select email_id, -1 as chunk, kind, key from (select email_id, 'person' as kind, unnest(list_distinct(list_concat({_ADDR}, case when email_id % 4 = 0 then ['boss@acme.io'] else [] end))) as key from msg union all select email_id, 'org', unnest(list_distinct(list_concat(['example'], case when email_id % 4 = 0 then ['acme'] else [] end))) from msg)
  union all select email_id, -1, 'person', 'ops@example.org' from msg where contains(subject, 'ops@example.org')
  union all select distinct email_id, -1, {_KIND}, {_KEY} from (select email_id, {_BODY_IDS.replace("text", "subject")} as span from msg)
  union all select distinct doc_id // 2, doc_id, {_KIND}, {_KEY} from (select doc_id, {_BODY_IDS} as span from documents where doc_id % 10 < 8)""", O._MSG)
def deterministic_mentions(s, d):
    """All mentions that rules find in messages, with a header that names one person more in every fourth, and in the chunks of documents."""
    e = F.col("email_id")
    headers = F.map_filter(F.create_map(F.lit("TO"), F.col("to_line"), F.lit("cc"), F.col("cc_line"), F.lit("reply-to"), F.when(e % 4 == 0, "The Boss <Boss@Acme.io>")), lambda k, v: v.isNotNull())
    m = V.messages(s, d).select("email_id", "sender", F.array("sender").alias("recipients"), headers.alias("headers"), "subject")
    found = chunking.extract_deterministic(m, V.chunks(s, d))
    return found.select("email_id", F.coalesce(F.col("chunk_id").cast("long"), F.lit(-1)).alias("chunk"), "kind", "key")
