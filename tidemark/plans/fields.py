"""Catalog queries of the functions of message fields, each beside the SQL it must equal. Derived fields follow the message's number, so that every case occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import mail as M
from tidemark.functions import text as T
from tidemark.operators import graph
from tidemark.plans import oracles as O
from tidemark.plans.mail import ntz, scored
from tidemark.plans.registry import registry
from tidemark.sources import views as V

query, QUERIES, ORACLE_SQL = registry()


def _pick(*values):
    """One of the values in turn, by the message's number."""
    at = (F.col("email_id") % len(values) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), at)


def _sql(*values) -> str:
    return f"([{', '.join('null' if v is None else O._lit(v) for v in values)}])[email_id % {len(values)} + 1]"


_SENDERS = ('"Ann Lee" <ann@acme.com>', "bob@gmail.com", "Desk  <desk@Ops.org>", "<x@y.io>", "plain name", None, "'Q' Team <q@z.co>")
_DECORATED = "regexp_matches(trim(x), '<.*>$')"


@query(f"""select email_id, case when {_DECORATED} then nullif(trim(trim(trim(string_split(trim(x), '<')[1]), '"')), '') end as shown,
  case when {_DECORATED} then coalesce(nullif(trim(regexp_replace(string_split(x, '<')[1], '["'']', '', 'g')), ''), regexp_extract(x, '<(.+)>', 1)) else string_split(x, '@')[1] end as name,
  case when {_DECORATED} then trim(regexp_extract(x, '<(.+)>', 1)) else x end as email from (select email_id, {_sql(*_SENDERS)} as x from msg)""", O._MSG)
def display_names(s, d):
    x = V.messages(s, d).select("email_id", _pick(*_SENDERS).alias("x")).withColumn("n", M.sender_name(F.col("x")))
    return x.select("email_id", M.display_name(F.col("x")).alias("shown"), "n.name", "n.email")


@query("select email_id, category || ':' || sender as id, category as kind, sender as key from msg", O._MSG)
def provisional_ids(s, d):
    ids = V.messages(s, d).select("email_id", M.provisional_id(F.col("category"), F.col("sender")).alias("id"))
    return ids.withColumn("p", M.parse_provisional(F.col("id"))).select("email_id", "id", "p.kind", "p.key")


@query("select email_id, substr(sha1(sender || '|' || subject), 1, 16) as id16, substr(sha1(sender || '|' || subject), 1, 20) as id20, substr(sha1(sender || '|' || subject), 1, 24) as id24 from msg", O._MSG)
def content_ids(s, d):
    return V.messages(s, d).select("email_id", *[M.content_id(n, F.col("sender"), F.col("subject")).alias(f"id{n}") for n in (16, 20, 24)])


_PLAIN = ("<p>Hello&nbsp;there</p><br>next", "h1 { color: red }", "a &amp; b​  c", None, "x\r\n\r\n\r\n\r\ny ", "1 < 2 > 0")
_CLEAN = ("Hello there\n\nnext", "h1 { color: red }", "a & b c", "", "x\n\ny", "1 < 2 > 0")


@query(f"select email_id, {_sql('1', '1', '0', None, '0', '0')} = '1' as html, {_sql('Hello there' + chr(10) + chr(10) + 'next', '', 'a & b c', '', 'x' + chr(10) + chr(10) + 'y', '1 < 2 > 0')} as said from msg", O._MSG)
def plain_parts(s, d):
    return V.messages(s, d).select("email_id", M.looks_like_html(_pick(*_PLAIN)).alias("html"), M.clean_plain(_pick(*_PLAIN)).alias("said"))


@query("select email_id, is_vip, is_direct, coalesce(len(regexp_extract_all(lower(subject), 'urgent|asap')), 0)::int as hits, read_status = 'unread' as unread from sig", O._MSG, O._SIG)
def signals(s, d):
    from tidemark.operators import queue

    m = queue.with_signals(V.messages(s, d), V.OWNER)
    hits = F.size(F.filter(T.urgency_hits(F.col("subject")), lambda w: w.isin("urgent", "asap")))
    return m.select("email_id", "is_vip", "is_direct", hits.alias("hits"), (F.col("read_status") == "unread").alias("unread"))


_SUMMARIES = ("One. Two is cut of", "No end here", "Done!", "  ", "。x", "A? B", None)
_TRIMMED = ("One.", "No end here", "Done!", "", "。x", "A?", None)


@query(f"select email_id, {_sql(*_TRIMMED)} as trimmed, {_sql('One.', 'No end here', 'Done!', '', '', '', '')} as bullets, length(trim(coalesce(subject, ''))) >= 6 and regexp_matches(trim(subject), '^[\\p{{L}}\\p{{N}}]') and regexp_matches(subject, '[A-Za-z]{{2}}') as meaningful from msg", O._MSG)
def summaries(s, d):
    x = _pick(*_SUMMARIES)
    return V.messages(s, d).select("email_id", M.trim_to_sentence(x).alias("trimmed"), M.join_bullets(F.array_compact(F.array(x, F.lit("..")))).alias("bullets"), M.is_meaningful(F.col("subject")).alias("meaningful"))


_SHORT, _LONG = ("lot 22b", "api", "ab", "ship to", "lot 22b", ""), ("anshun lot 22b", "rapidly done", "ab cd", "to ship", "lot 22b", "a b")


@query(f"select email_id, {_sql('1', '0', '0', '0', '0', '0')} = '1' as nested from msg", O._MSG)
def contained_names(s, d):
    return V.messages(s, d).select("email_id", M.contains_tokens(_pick(*_SHORT), _pick(*_LONG)).alias("nested"))


@query("select email_id, case when email_id % 5 = 0 then 0.5 else least(1.0::double, greatest(0.0::double, value / 50.0 - 0.2)) end as share, least(4, email_id % 9)::int as kept from msg", O._MSG)
def clamped(s, d):
    m = V.messages(s, d)
    many = F.slice(F.array(*[F.lit(str(i)) for i in range(9)]), 1, (F.col("email_id") % 9).cast("int"))
    return m.select("email_id", M.clamp(F.when(F.col("email_id") % 5 != 0, F.col("value") / 50.0 - 0.2), 0.5).alias("share"), F.size(M.capped(many, "projects")).alias("kept"))


_QUERIES = ("lot 22b", 'say "hi"', "", None, " CS-40350  case ")
_FTS = ('"lot" "22b"', '"say" """hi"""', "", "", '"CS-40350" "case"')


@query(f"select email_id, {_sql(*_FTS)} as terms from msg", O._MSG)
def fts_terms(s, d):
    return V.messages(s, d).select("email_id", M.search_terms(_pick(*_QUERIES)).alias("terms"))


@query(f"select email_id, {O._lit(M.FROM)} || sender || coalesce(chr(10) || {O._lit(M.TO)} || to_line, '') || chr(10) || 'Subject: ' || subject as prompt from msg", O._MSG)
def prompts(s, d):
    return V.messages(s, d).select("email_id", M.prompt_block(F.col("sender"), F.col("to_line"), F.col("subject")).alias("prompt"))


@query("select email_id, array_to_string(case email_id % 3 when 0 then ['a@b.co', 'z@y.org', sender] when 1 then [sender] else ['z@y.org', sender] end, ',') as attendees from msg", O._MSG)
def attendees(s, d):
    e = F.col("email_id") % 3
    said = F.when(e == 0, F.array(F.lit("Ann <A@b.co>"), F.lit("a@b.co, z@y.org"))).when(e == 1, F.array(F.lit("Ronith"))).otherwise(F.array(F.lit("z@y.org"), F.col("sender")))
    return V.messages(s, d).select("email_id", F.array_join(M.clean_attendees(said, F.col("sender")), ",").alias("attendees"))


@query("select email_id, case when email_id % 2 = 0 then 'PRECEDENCE=bulk' else '' end as hints, case when email_id % 3 = 0 then 'x' end as found from msg", O._MSG)
def hint_headers(s, d):
    e = F.col("email_id")
    headers = F.map_from_arrays(F.array(F.when(e % 2 == 0, "PRECEDENCE").otherwise("Date"), F.when(e % 3 == 0, "x-Mailer").otherwise("To")), F.array(F.lit("bulk"), F.lit("x")))
    m = V.messages(s, d).select("email_id", headers.alias("h"))
    return m.select("email_id", F.array_join(F.transform(F.map_entries(M.hint_headers(F.col("h"))), lambda x: F.concat_ws("=", x.key, x.value)), ",").alias("hints"), T.header(F.col("h"), "X-Mailer").alias("found"))


_DRAFTS = ("]} Hi", "Hi [there]", "``{ x", "  ok ", None)


@query(f"select email_id, {_sql('Hi', 'Hi [there]', 'x', 'ok', None)} as draft, 'Reply to \"' || subject || '\"' as label from msg", O._MSG)
def drafts(s, d):
    return V.messages(s, d).select("email_id", M.clean_draft(_pick(*_DRAFTS)).alias("draft"), M.reply_text(F.col("subject")).alias("label"))


@query("""select email_id, case when secs < 60 then 'Just now' when secs < 3600 then (secs // 60) || 'm ago' when secs < 86400 then (secs // 3600) || 'h ago' when secs < 604800 then (secs // 86400) || 'd ago'
  else strftime(received_at, '%b %-d') end as age, strftime(received_at, '%Y-%m-%dT%H:%M:%SZ') as said from (select *, (epoch_us((select max(received_at) from msg)) - epoch_us(received_at)) // 1000000 as secs from msg)""", O._MSG)
def age_labels(s, d):
    m = V.messages(s, d)
    now = F.broadcast(m.agg(F.max("received_at").alias("now")))  # one row
    secs = F.floor((F.unix_micros("now") - F.unix_micros("received_at")) / 1_000_000)
    return m.crossJoin(now).select("email_id", M.age_label(secs, F.col("received_at")).alias("age"), F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("said"))


_TITLES = ("  Lot 22B   Review. ", "ABC –", None, "x:")


@query(f"select email_id, {_sql('lot 22b review', 'abc', '', 'x')} as title from msg", O._MSG)
def titles(s, d):
    return V.messages(s, d).select("email_id", M.normalized_title(_pick(*_TITLES)).alias("title"))


@query(f"""select email_id, case when coalesce(is_scheduling, false) then case when email_id % 5 = 0 then {O._lit(M.NO_CALENDAR)} when email_id % 5 = 1 then {O._lit(M.NONE_FREE)}
  else {O._lit(M.OFFER)} || strftime(received_at, '%a %d %b %H:%M') || '-' || case when (received_at + interval 30 minute)::date = received_at::date then strftime(received_at + interval 30 minute, '%H:%M') else strftime(received_at + interval 30 minute, '%a %d %b %H:%M') end end end as bullet from msg""", O._MSG)
def availability(s, d):
    slot = F.array(M.format_slot(F.col("received_at"), F.col("received_at") + F.expr("interval 30 minutes")))
    slots = F.when(F.col("email_id") % 5 > 1, slot).otherwise(F.array().cast("array<string>"))
    return V.messages(s, d).select("email_id", M.availability(F.col("is_scheduling"), F.col("email_id") % 5 != 0, slots).alias("bullet"))


@query("select doc_id, md5(left(array_to_string(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))[1:5], chr(10)), 500)) as head, length(case when length(text) > 80 then left(text, 80) || '…' else text end) as n from documents")
def truncated_bodies(s, d):
    return V.table(s, d, "documents").select("doc_id", F.md5(M.first_lines(F.col("text"))).alias("head"), F.length(M.truncate(F.col("text"), 80)).cast("long").alias("n"))


@query("select thread_id, round(sum(value), 4) as total, count(*) filter (age <= 24.0) as fresh from (select *, round_even((epoch_us((select max(received_at) from msg)) - epoch_us(received_at)) / 3600000000.0, 1) as age from msg) group by thread_id", O._MSG)
def age_hours(s, d):
    m = V.messages(s, d)
    now = F.broadcast(m.agg(F.max("received_at").alias("now")))  # one row
    age = F.bround((F.unix_micros("now") - F.unix_micros("received_at")) / 3_600_000_000, 1)
    return m.crossJoin(now).groupBy("thread_id").agg(F.round(F.sum("value"), 4).alias("total"), F.count_if(age <= 24.0).alias("fresh"))


_EXPORT = """exp as (select *, case when email_id % 4 = 0 then 'Jö Ü' || email_id else 'Ann' end as name, 'Body ' || subject || ' ä€ ' || email_id as said from msg)"""


def exported(s, d):
    """Messages as the JSON of a mail export: (raw). Names are encoded words, bodies lie two levels deep in the tree, some as HTML only, some are attached, and one in 23 can't be read."""
    e = F.col("email_id")
    m = V.messages(s, d)
    name = F.when(e % 8 == 0, F.concat(F.lit("=?UTF-8?B?"), F.base64(F.encode(F.concat(F.lit("Jö Ü"), e.cast("string")), "UTF-8")), F.lit("?= "))).when(e % 4 == 0, F.concat(F.lit("=?utf-8?q?J=C3=B6_=C3=9C?= =?utf-8?q?"), e.cast("string"), F.lit("?= "))).otherwise("Ann ")
    head = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    headers = F.array(head("FROM", F.concat(name, F.lit("<"), "sender", F.lit(">"))), head("to", F.coalesce("to_line", F.lit(""))), head("Cc", F.coalesce("cc_line", F.lit(""))), head("Subject", F.col("subject")), head("subject", F.lit("later")), head("X-Other", F.lit("n")))
    said = F.concat(F.lit("Body "), "subject", F.lit(" ä€ "), e.cast("string"))
    data = lambda text: F.rtrim(F.translate(F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", ""), "+/", "-_"), F.lit("="))
    part = lambda kind, text, file="": F.struct(kind.alias("mimeType"), F.lit(file).alias("filename"), F.struct(data(text).alias("data")).alias("body"))
    inner = F.array(part(F.lit("text/html"), F.concat(F.lit("<p>"), said, F.lit("</p><script>x</script>"))), part(F.when(e % 3 == 0, "text/enriched").otherwise("text/plain"), F.concat(F.lit(" "), said, F.lit("\n"))))
    both = F.array(F.struct(F.lit("multipart/alternative").alias("mimeType"), inner.alias("parts"), F.lit(None).cast("string").alias("filename"), F.lit(None).cast("struct<data:string>").alias("body")))
    file = part(F.lit("text/plain"), F.lit("attached"), "a.txt")
    attached = F.array(F.struct(file.mimeType.alias("mimeType"), F.lit(None).cast(both_type(m, inner)).alias("parts"), file.filename.alias("filename"), file.body.alias("body")))
    parts = F.when(e % 5 == 0, F.concat(both, attached)).otherwise(both)
    one = F.struct(e.cast("string").alias("id"), F.col("thread_id").cast("string").alias("threadId"), F.unix_millis("received_at").cast("string").alias("internalDate"), F.when(F.col("read_status") == "unread", F.array(F.lit("INBOX"), F.lit("UNREAD"))).alias("labelIds"), F.struct(F.lit("multipart/mixed").alias("mimeType"), headers.alias("headers"), parts.alias("parts")).alias("payload"))
    return m.select(F.when(e % 23 == 7, F.lit("{broken")).otherwise(F.to_json(one)).alias("raw"))


def both_type(m, inner):
    return m.select(inner.alias("x")).schema["x"].dataType


@query("""select email_id::varchar as email_id, thread_id::varchar as thread_id, name || ' <' || sender || '>' as sender, subject, said as body, read_status, email_id % 5 = 0 as attached, epoch_us(received_at) // 1000 as ms,
  array_to_string(list_filter(list_transform(string_split(concat_ws(',', coalesce(to_line, ''), coalesce(cc_line, '')), ','), lambda x: trim(x)), lambda x: x <> ''), '|') as recipients, 'Cc,From,Subject,To' as headers from exp where email_id % 23 <> 7
  union all select null, null, null, null, null, null, null, -1, null, 'not JSON' from exp where email_id % 23 = 7""", O._MSG, _EXPORT)
def parsed_messages(s, d):
    from tidemark.sources.messages import parse_messages

    p = parse_messages(exported(s, d))
    names = F.coalesce("error", F.array_join(F.array_sort(F.map_keys("headers")), ","))
    return p.select("email_id", "thread_id", "sender", "subject", "body", "read_status", F.col("has_attachments").alias("attached"), F.coalesce(F.unix_millis("received_at"), F.lit(-1)).alias("ms"), F.array_join("recipients", "|").alias("recipients"), names.alias("headers"))


_TIMES = ("2026-08-24T09:00:00Z", "2026-08-24T09:00:00.123456789-07:00", "2026-08-24", " 2026-08-24T09:00:00 ", "soon", "2026-13-01T00:00:00Z", None)
_READ = ("2026-08-24T09:00:00+00:00", "2026-08-24T16:00:00.123456+00:00", "2026-08-24T07:00:00+00:00", "2026-08-24T16:00:00+00:00", None, None, None)


@query(f"select email_id, {_sql(*_READ)} as at, {_sql(*[x and x.replace('-24T', '-31T') for x in _READ])} as until from msg", O._MSG)
def times(s, d):
    from tidemark.operators.serving import iso

    at = T.parse_rfc3339(_pick(*_TIMES), "America/Los_Angeles")
    return V.messages(s, d).select("email_id", at.alias("at")).select("email_id", iso(F.col("at")).alias("at"), iso(T.default_range(F.col("at")).end).alias("until"))


@query("select email_id::varchar as email_id, row_number() over (order by epoch_us(received_at) // 1000 desc, email_id::varchar)::int as place from msg where email_id % 23 <> 7 qualify place <= 50", O._MSG)
def read_newest(s, d):
    """The fifty newest messages of an export that was written as lines of JSON, some of which can't be read."""
    import uuid

    from pyspark.sql import Window

    from tidemark.sources.messages import parse_messages, read_messages
    from tidemark.sources.tables import shared_dir

    path = f"{shared_dir(s)}/export-{uuid.uuid4().hex}"
    exported(s, d).select(F.col("raw").alias("value")).write.text(path)
    read = parse_messages(read_messages(s, path, 50))
    place = F.row_number().over(Window.orderBy(F.desc("received_at"), "email_id"))  # fifty rows
    return read.select("email_id", place.alias("place"))
