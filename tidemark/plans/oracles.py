"""DuckDB SQL for the catalog queries; the views are those of ``tidemark.sources.views`` in SQL."""

from __future__ import annotations

from tidemark.functions import text as T
from tidemark.sources.views import SUBJECTS


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_MSG = f"""msg as (
  select event_id as email_id, user_id as thread_id, 'u' || (user_id % 40) || '@example.com' as sender, ts as received_at,
    case event_type when 'purchase' then 'urgent' when 'error' then 'high' when 'click' then 'medium' else 'low' end as level,
    case when event_id % 3 <> 0 then 'read' else 'unread' end as read_status,
    case when event_id % 11 <> 0 then event_id % 5 = 0 end as is_no_reply, event_type as category,
    case when event_id % 7 <> 0 then event_id % 4 = 0 end as is_scheduling,
    case when event_id % 6 <> 0 then (event_id % 6 - 1)::int end as outline_points,
    ([{", ".join(map(_lit, SUBJECTS))}])[event_id % {len(SUBJECTS)} + 1] as subject, value,
    case event_id % 4 when 0 then 'Owner <owner@example.com>, team@example.com' when 1 then 'team@example.com' when 3 then 'owner@example.com' end as to_line,
    case event_id % 8 when 1 then 'Owner <OWNER@example.com>' when 5 then 'other@example.com' end as cc_line
  from events)"""
_SIG = """counts as (select sender, count(distinct email_id) as n from msg group by sender),
 bar as (select list_sort(list(n))[round_even(0.9::double * (count(*) - 1), 0)::int + 1] as least from counts),
 vips as (select sender from counts, bar where n >= least and sender <> 'owner@example.com'),
 sig as (select *, sender in (select sender from vips) as is_vip,
   to_line is null or contains(lower(to_line), 'owner@example.com') or not coalesce(contains(lower(cc_line), 'owner@example.com'), false) as is_direct from msg)"""
_FLOOR = "case level when 'urgent' then 75.0::double when 'high' then 50.0 when 'medium' then 25.0 else 0.0 end"
_CAPPED = "case when coalesce(is_no_reply, false) and level in ('high', 'urgent') then 'medium' else level end"
_HITS = " + ".join(f"(contains(lower(subject), {_lit(w)}))::int" for w in T.URGENCY)


_WEIGHED = f"""weighed as (select *, least(is_vip::int * 0.30::double + is_direct::int * 0.20::double + least({_HITS}, 3) / 3.0::double * 0.30
    + coalesce(least(case when read_status = 'unread' then age end, 72.0) / 72.0::double, 0.0) * 0.15 + greatest(0.0, 1.0 - least(age, 168.0) / 168.0::double) * 0.05, 1.0::double) as w
   from (select *, round_even((epoch_us((select max(received_at) from sig)) - epoch_us(received_at)) / 3600000000.0, 1)::double as age from sig))"""


def _points(level: str, no_reply: str) -> str:
    """The score at a level, by the weight of the signals."""
    floor = _FLOOR.replace("case level", f"case {level}", 1)
    return f"case when coalesce({no_reply}, false) then {floor} else round_even(case when {level} = 'urgent' then {floor} + 25.0::double * w else least({floor} + 25.0::double * w, {floor} + 24.9) end, 1) end"


_SCORED = f"scored as (select *, {_points('level', 'is_no_reply')} as score from (select * replace ({_CAPPED} as level) from weighed))"
_LOG = """log as (
  select email_id as id, sender, case when email_id % 100 = 0 then 'level' else 'no_reply' end as kind,
    case when email_id % 100 = 0 then (['low', 'medium', 'high', 'urgent'])[(email_id // 100) % 4 + 1]
         else case when (email_id // 50) % 4 = 1 then 'true' else 'false' end end as value, received_at as created_at
  from msg where email_id % 50 = 0)"""
_PRIORS = """priors as (
  select sender, max_by(value, (created_at, id)) filter (kind = 'level') as prior_level, max_by(value, (created_at, id)) filter (kind = 'no_reply') = 'true' as prior_no_reply
  from log group by sender)"""
_MARKED, _PINNED = "(prior_no_reply is not null and is_no_reply is distinct from prior_no_reply)", "(prior_level is not null and level <> prior_level)"


def _fed(gone: str = "false") -> str:
    """Views that end in ``done``: scored messages with corrections; those of which ``gone`` holds are at their band's floor."""
    new = _points("prior_level", "coalesce(prior_no_reply, is_no_reply)")
    floor = _FLOOR.replace("case level", "case prior_level", 1)
    return f"""{_WEIGHED}, {_SCORED},
 fed as (select * exclude (score), score as old_score, {_MARKED} as marked, {_PINNED} as pinned, case when {_PINNED} then case when {gone} then {floor} else {new} end else score end as score from scored left join priors using (sender)),
 done as (select * replace (coalesce(prior_level, level) as level, coalesce(prior_no_reply, is_no_reply) as is_no_reply, case when not (marked and prior_no_reply) then outline_points end as outline_points), level as old_level, is_no_reply as old_no_reply, marked or pinned as changed from fed)"""


_FED = _fed()
_MEN = """men as (
  select l_orderkey as email_id, m.kind || ':' || m.key as entity_id, m.kind as kind, case when l_discount < 0.03 then 0.4::double else 1.0::double end as confidence
  from (select l_orderkey, l_discount, unnest([{'kind': 'person', 'key': o_custkey::varchar}, {'kind': 'case', 'key': l_suppkey::varchar}, {'kind': 'project', 'key': p_brand}, {'kind': 'org', 'key': l_linestatus}]) as m
        from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey))"""
_PAIRS = "pairs as (select email_id, entity_id, kind, max(confidence) as confidence from men group by all)"
_IDF = """idf as (select entity_id, kind, count(*) as df, ln(1 + n / count(*)) / ln(1 + n) as idf, n >= 20 and count(*) / n > 0.5 as ubiquitous
  from pairs, (select count(distinct email_id)::double as n from pairs) group by entity_id, kind, n)"""
_OLD = "old as (select o_orderkey, o_custkey, o_orderstatus, epoch_us(o_orderdate) as at_ from orders where o_orderkey % 3 <> 0), new as (select o_orderkey, o_custkey, 'N' as o_orderstatus, epoch_us(o_orderdate) as at_ from orders where o_orderkey % 2 = 0)"
_EDGES = """e as (select src, dst, round(n / (n + 10.0::double), 6) as weight from (
   select a.entity_id as src, b.entity_id as dst, count(*)::double as n from (select distinct email_id, entity_id from men where kind = 'case') a join (select distinct email_id, entity_id from men where kind = 'project') b using (email_id) group by all) where n >= 2),
 step as (select src, dst, max(weight) as weight from (select * from e union all select dst, src, weight from e) group by all)"""
_BUSY = "busy as (select user_id as calendar_id, event_id, epoch_us(ts) as s, epoch_us(ts) + floor(value * 600)::bigint * 1000000 as e from events)"
_MERGED = """merged as (select calendar_id, min(s) as s, max(e) as e from (
   select *, sum(fresh) over (partition by calendar_id order by s, e rows unbounded preceding) as island from (
     select *, case when s <= max(e) over (partition by calendar_id order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from busy where e > s)) group by calendar_id, island)"""
_DAY = 86_400_000_000
_FREE = f"""win as (select distinct calendar_id, (s // {_DAY}) * {_DAY} + 32400000000 as f, (s // {_DAY}) * {_DAY} + 61200000000 as t from busy),
 cut as (select w.calendar_id, f, t, s, e from win w join merged m on m.calendar_id = w.calendar_id and s < t and e > f union all select calendar_id, f, t, t, t from win),
 free as (select calendar_id, greatest(coalesce(lag(e) over (partition by calendar_id, f, t order by s, e), f), f) as free_from, s as free_to from cut)"""
_TERMS = r"""words as (select doc_id as chunk_id, case when doc_id % 10 = 8 then 'quoted' when doc_id % 10 = 9 then 'signature' else 'body' end as kind,
    list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') as ws from documents),
 terms as (select chunk_id, term, count(*) as tf, any_value(dl) as dl from (select chunk_id, len(ws) as dl, unnest(ws) as term from words) group by chunk_id, term),
 top as (select chunk_id, max(term) filter (nth = 1) as one, max(term) filter (nth = 2) as two from (select *, row_number() over (partition by chunk_id order by tf desc, term) as nth from terms where chunk_id % 50 = 0 and length(term) between 5 and 8) group by chunk_id),
 asked as (select chunk_id as query_id, concat_ws(' ', one, case when chunk_id % 100 = 0 then two else case when len(ws) >= 2 then ws[1] || '-' || ws[2] end end) as query from words left join top using (chunk_id) where chunk_id % 50 = 0),
 phr as (select query_id, ts, count(*) as times from (select query_id, list_filter(string_split_regex(lower(t), '[^\p{L}\p{N}]+'), lambda w: w <> '') as ts from (select query_id, unnest(string_split_regex(trim(query), '\s+')) as t from asked)) where len(ts) > 0 group by all),
 wanted as (select query_id, count(*) as n from phr group by query_id),
 size as (select count(*)::double as n, avg(len(ws)) as avgdl from words),
 pos as (select chunk_id, unnest(ws) as term, generate_subscripts(ws, 1) as at from words),
 ph as (select distinct ts from phr),
 hit as (select ts, chunk_id, tf from ph join terms on len(ts) = 1 and term = ts[1] union all
   select ts, a.chunk_id, count(*) from ph join pos a on len(ts) = 2 and a.term = ts[1] join pos b on b.chunk_id = a.chunk_id and b.at = a.at + 1 and b.term = ts[2] group by all),
 dfs as (select ts, count(*)::double as df from hit group by ts),
 bm as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from (
   select query_id, hit.chunk_id, round(sum(times * greatest(ln((size.n - df + 0.5) / (df + 0.5)), 1e-6::double) * tf * 2.2::double / (tf + 1.2::double * (1 - 0.75::double + 0.75::double * len(ws) / avgdl))), 6) as score
   from hit join phr using (ts) join dfs using (ts) join words w on w.chunk_id = hit.chunk_id and w.kind = 'body' join wanted using (query_id), size
   group by query_id, hit.chunk_id having count(*) = any_value(wanted.n)) qualify rank <= 10)"""
_BODY = "vb as (select query_id, row_number() over (partition by query_id order by rank)::int as rank, vec_id as chunk_id, score from vec where vec_id in (select doc_id from documents where doc_id % 10 < 8))"
_FIRST = "fc as (select doc_id // 2 as email_id, arg_min(doc_id, (doc_id % 2, doc_id)) as chunk_id from documents where doc_id % 10 < 8 group by doc_id // 2)"
_NAMES = """nm as (select e.vec_id, (['topic', 'org', 'case'])[(e.vec_id // 5) % 3 + 1] as kind, case e.vec_id % 5 when 0 then 'lot ' || (e.vec_id // 5) when 1 then 'anshun lot ' || (e.vec_id // 5) when 2 then 'lot ' || (e.vec_id // 5) || ' dock' else 'item ' || e.vec_id end as key,
   list_transform(generate_series(1, len(e.embedding)), lambda i: b.embedding[i]::double + (0.25::double + 0.1::double * (e.vec_id % 5)) * e.embedding[i]::double) as x
   from embeddings e join embeddings b on b.vec_id = e.vec_id - e.vec_id % 5),
 sc_ as (select i.vec_id as id, e.vec_id as entity_id, round(list_dot_product(i.x, e.x) / sqrt(list_dot_product(i.x, i.x) * list_dot_product(e.x, e.x)), 6) as score,
   (len(string_split(i.key, ' ')) < len(string_split(e.key, ' ')) and contains(' ' || e.key || ' ', ' ' || i.key || ' ')) or (len(string_split(e.key, ' ')) < len(string_split(i.key, ' ')) and contains(' ' || i.key || ' ', ' ' || e.key || ' ')) as nested
   from nm i join nm e on i.kind = e.kind and i.kind <> 'case' and i.vec_id % 4 = 0 and e.vec_id % 4 <> 0),
 nr as (select id, entity_id, score from sc_ where score >= case when nested then 0.65 else 0.86 end)"""
_VEC = """vec as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from (
   select q.vec_id as query_id, v.vec_id, round(list_dot_product(v.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))), 6) as score
   from embeddings v join embeddings q on q.vec_id <> v.vec_id where %s) qualify rank <= 10)"""
_PROC = """proc as (select *, email_id % 17 <> 0 as processed, email_id % 12 <> 0 as context, email_id % 13 <> 0 as scored, email_id % 14 <> 0 as summarized, email_id % 9 <> 0 as dated, email_id % 10 <> 3 as listed, email_id % 3 <> 0 as seen,
   case when email_id % 2 = 0 then 'none' else 'suggested' end as proposal, email_id % 5 <> 1 as drafted, email_id % 15 = 1 as sent, [subject, 'Review the ' || category || ' report'] as items from msg)"""
_REPLY = "coalesce(not is_no_reply, false) and read_status = 'read' and not sent"
_TODO = """todo as (select substr(sha1(email_id || '|' || kind || '|' || text), 1, 24) as todo_id, email_id, kind, text from (
   select email_id, 'action_item' as kind, trim(text) as text from (select *, unnest(items) as text, generate_subscripts(items, 1) as place from {0} where listed)
     where length(trim(text)) >= 6 and regexp_matches(trim(text), '^[\\p{{L}}\\p{{N}}]') and regexp_matches(text, '[A-Za-z]{{2}}')
     qualify row_number() over (partition by thread_id, lower(trim(text)) order by received_at, email_id, place) = 1
   union all select email_id, 'needs_reply', 'Reply to "' || subject || '"' from {0} where """ + _REPLY + """))"""
_DUE = {
    "chunk": "not context", "embed": "not context", "extract": "not context", "classify": "is_no_reply is null", "score": "not scored", "summarize": "not summarized or not dated", "action_items": "not listed", "categorize": "category is null",
    "scheduling": "is_scheduling is null", "calendar": "is_scheduling is null or (is_scheduling and not seen)", "propose_event": "is_scheduling is null or (is_scheduling and (not seen or proposal = 'none'))",
    "outline": "coalesce(not is_no_reply, false) and coalesce(outline_points, 0) = 0", "expand": "coalesce(not is_no_reply, false) and (coalesce(outline_points, 0) = 0 or not drafted)",
}
_STAGES = "select email_id, list_filter([" + ", ".join(f"case when not processed or {test} then '{stage}' end" for stage, test in _DUE.items()) + "], lambda x: x is not null) as stages from proc"
_BARE = r"trim(regexp_replace(subject, '^\s*(?:(?:re|fwd|fw|aw|sv)\s*:\s*)+', '', 'i'))"
_SIGNALS = lambda patterns, whys: "list_filter([" + ", ".join(f"case when regexp_matches(said, {_lit('(?i)' + p)}) then {_lit(w)} end" for p, w in zip(patterns, whys)) + "], lambda x: x is not null)"
_LANE = "sum(('0x' || substr(md5(email_id::varchar), {0}, 15))::bigint::hugeint)::varchar"
_FP = "select entity_id, count(*)::int as emails, substr(sha1(" + _LANE.format(1) + " || ':' || " + _LANE.format(17) + "), 1, 20) as hash from (select distinct entity_id, email_id from men where {0}) group by entity_id"


def _with(*views: str) -> str:
    return "with " + ", ".join(views) + " "


def _page_text(html: str) -> str:
    """The visible text of a page without numbered characters."""
    steps = [*((rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "") for tag in T.SKIP_TAGS), ("(?s)<!--.*?-->", ""), (rf"(?i)</?(?:{'|'.join(T.BLOCK_TAGS)})\b[^>]*>", "\n"), (r"</?[A-Za-z!][^>]*>", "")]
    told = lambda t, some: t if not some else told(f"regexp_replace({t}, {_lit(some[0][0])}, {_lit(some[0][1])}, 'g')", some[1:])
    t = told(f"coalesce({html}, '')", steps)
    for name, shown in T.ENTITIES.items():
        t = f"replace({t}, {_lit(f'&{name};')}, {_lit(shown)})"
    chars = lambda x: x.encode().decode("unicode_escape")
    return told(t, [(r"\r\n?", "\n"), (chars(T.INVISIBLE), ""), (chars(T.SPACES), " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^[ \n]+|[ \n]+$", "")])


def _graph(anchors: str, targets: str) -> list[str]:
    """Views that end in ``gs``: the messages near the anchors, by two hops of the graph."""
    return [
        _MEN, _EDGES, "m as (select distinct email_id, entity_id from men where kind in ('case', 'project'))",
        "per as (select entity_id, count(distinct email_id) as emails, count(*) as mentions from men where kind in ('case', 'project') group by entity_id)",
        "sal as (select entity_id, case when s = 0 then 0.5::double else s end as salience from (select entity_id, round(least(1.0::double, 0.75::double * ln(1 + emails) / ln(1 + (select max(emails) from per)) + 0.25::double * least(1.0::double, ln(1 + mentions) / ln(51::double))), 4) as s from per))",
        f"anchor as (select email_id as anchor, entity_id from m where {anchors})",
        "h1 as (select start, dst as node, max(weight) as score from (select distinct entity_id as start from anchor) join step on src = start where dst <> start group by all)",
        "h2 as (select start, dst as node, max(score * weight / 2) as score from h1 join step on src = node where dst <> start group by all)",
        "near as (select *, 1 as hop from h1 union all select *, 2 from h2 where not exists (from h1 where h1.start = h2.start and h1.node = h2.node))",
        f"hits as (select anchor, m.email_id, max(salience * score / hop) as score from anchor join sal using (entity_id) join near on start = anchor.entity_id join m on m.entity_id = node and m.email_id <> anchor where m.{targets} group by all)" if targets != "true" else "hits as (select anchor, m.email_id, max(salience * score / hop) as score from anchor join sal using (entity_id) join near on start = anchor.entity_id join m on m.entity_id = node and m.email_id <> anchor group by all)",
        "gs as (select anchor, row_number() over (partition by anchor order by round(score, 6) desc, email_id)::int as rank, email_id, round(score, 6) as score from hits qualify rank <= 10)",
    ]


ORACLE_SQL: dict[str, str] = {
    "review_queue": _with(_MSG, _SIG, _LOG, _PRIORS, _FED) + f"select email_id, sender, level, score, round({_FLOOR} + 25.0::double * row_number() over (partition by level order by score, received_at, email_id) / (count(*) over (partition by level) + 1), 6) as spread from done order by spread desc, received_at desc, email_id limit 20",
    "score_messages": _with(_MSG, _SIG, _WEIGHED, _SCORED) + "select email_id, level, score from scored",
    "filter_queue": _with(_MSG) + "select email_id, sender, subject from msg where read_status = 'unread' and is_no_reply is false and not coalesce(is_scheduling, false) and contains(lower(concat_ws(chr(10), subject, sender, case when email_id % 14 <> 0 then subject end)), 're') and outline_points > 0",
    "filter_review": _with(_MSG) + "select email_id from msg where not coalesce(is_no_reply, false) and coalesce(is_scheduling, false)",
    "urgent_unread": _with(_MSG) + "select email_id, sender from msg where level = 'urgent' and read_status = 'unread'",
    "page_queue": _with(_MSG) + "select email_id, value, (select count(*) from msg where category = 'click') as total from msg where category = 'click' order by value desc, email_id limit 20 offset 20",
    "queue_stats": _with(_MSG) + "select count(*) as total, count(*) filter (read_status = 'unread') as unread, count(*) filter (is_no_reply) as no_reply, count(*) filter (is_scheduling) as scheduling, count(*) filter (outline_points > 0) as with_outline, count(*) filter (level = 'low') as low, count(*) filter (level = 'medium') as medium, count(*) filter (level = 'high') as high, count(*) filter (level = 'urgent') as urgent from msg",
    "level_share": _with(_MSG) + "select level, count(*) as n, floor(100.0::double * count(*) / sum(count(*)) over () + 0.5)::bigint as percent from msg group by level",
    "top_categories": _with(_MSG) + "select category, count(*) as n from msg group by category order by n desc, category limit 12",
    "stale_outlines": _with(_MSG) + "select email_id, thread_id from (select *, max(received_at) over (partition by thread_id) as newest from msg) where outline_points is not null and received_at < newest",
    "thread_sizes": _with(_MSG) + "select thread_id, count(*) as n from msg group by thread_id having count(*) > 1",
    "thread_representative": _with(_MSG) + "select thread_id, email_id, value from msg qualify row_number() over (partition by thread_id order by value desc nulls last, received_at desc, email_id) = 1",
    "last_n_turns": "select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3",
    "conversation_heads": "select conv_id, max(turn) as last_turn, count(*) as turns from conversations group by conv_id",
    "sender_priors": _with(_MSG, _LOG, _PRIORS) + "select * from priors",
    "spread_scores": _with(_MSG, _SIG, _LOG, _PRIORS, _FED) + f"select email_id, level, round({_FLOOR} + 25.0::double * row_number() over (partition by level order by score, received_at, email_id) / (count(*) over (partition by level) + 1), 6) as spread from done",
    "apply_feedback": _with(_MSG, _SIG, _LOG, _PRIORS, _fed("email_id % 9 = 2"))
    + """select email_id, level, is_no_reply, score, coalesce(outline_points, -1) as outline_points, case when marked and prior_no_reply then 'not_applicable' when marked and st = 'not_applicable' then 'none' else st end as outline_status,
      case when pinned then 'Pinned to ' || level || ' by your feedback on this sender.' when prior_no_reply then 'your feedback: sender marked automated' else 'your feedback: sender marked as a real correspondent' end as why
      from (select *, case when email_id % 15 = 1 then 'sent' when old_no_reply then 'not_applicable' else 'suggested' end as st from done) where changed""",
    "clear_priors": _with(_MSG, _SIG, _LOG) + "select kind, count(*) as n, (select count(*) from log where kind = 'level' and sender in (select sender from vips)) as cleared from log where kind <> 'level' or sender not in (select sender from vips) group by kind",
    "vip_senders": _with(_MEN, "c as (select entity_id, count(distinct email_id) as emails from men where kind = 'person' group by entity_id), r as (select emails, row_number() over (order by emails) as nth, count(*) over () as n from c)") + "select entity_id, emails from c where emails >= (select min(emails) from r where nth >= round_even(0.9::double * (n - 1), 0) + 1)",
    "score_spread_stats": _with(_MSG) + "select level, count(value) as n, min(value) as least, max(value) as most, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as stdev, count(distinct value) as \"values\" from msg group by level",
    "majority_dim": "with v as (select len(embedding)::int as dim, label from embeddings) select dim, label, count(*) as n from v where dim = (select dim from v group by dim order by count(*) desc, dim limit 1) group by dim, label",
    "merge_latest": _with(_OLD) + "select o_orderkey, o_orderstatus from old where o_orderkey not in (select o_orderkey from new) union all select o_orderkey, o_orderstatus from new",
    "replace_by_parent": _with(_OLD) + "select o_orderkey, o_custkey, o_orderstatus from old where o_custkey not in (select o_custkey from new where o_custkey % 5 = 0) union all select o_orderkey, o_custkey, o_orderstatus from new where o_custkey % 5 = 0",
    "merge_entities": _with(_OLD, "a as (select o_custkey, min(at_) as f, max(at_) as l, count(*) as n from old group by 1), b as (select o_custkey, min(at_) as f, max(at_) as l, count(*) as n from new group by 1)") + "select o_custkey, least(a.f, b.f) as first_seen, greatest(a.l, b.l) as last_seen, coalesce(b.n, a.n) as n from a full join b using (o_custkey)",
    "insert_ignore": _with(_OLD, "o as (select * from old qualify row_number() over (partition by o_custkey order by o_orderkey) = 1)") + "select o_custkey, o_orderkey, o_orderstatus from o union all (select o_custkey, o_orderkey, o_orderstatus from new where o_custkey not in (select o_custkey from o) qualify row_number() over (partition by o_custkey order by o_orderkey) = 1)",
    "apply_updates": _with(_MSG, "ed as (select email_id - email_id % 8 as id, max_by('edited ' || email_id, (received_at, 'edited ' || email_id)) as v from msg where email_id % 4 = 0 group by 1)") + "select email_id, case when read_status = 'unread' and v is not null then v else category end as category, read_status from msg left join ed on id = email_id",
    "remap_keys": _with(_MEN) + "select case when regexp_matches(entity_id, '[02468]$') then 'merged:' || right(entity_id, 1) else entity_id end as entity_id, count(*) as n from men where kind = 'case' group by 1",
    "entity_counts": _with(_MEN) + "select kind, count(distinct entity_id) as entities, count(*) as mentions from men group by kind",
    "email_counts": _with(_MEN) + "select entity_id, count(distinct email_id) as emails from men group by entity_id",
    "email_counts_sketched": _with(_MEN) + "select entity_id, count(distinct email_id) as emails, true as near from men group by entity_id",
    "cooccurrence": _with(_MEN, _PAIRS) + "select * from pairs",
    "entity_idf": _with(_MEN, _PAIRS, _IDF) + "select * replace (round(idf, 6) as idf) from idf",
    "salience": _with(_MEN, "per as (select entity_id, count(distinct email_id) as emails, count(*) as mentions from men group by entity_id)") + "select entity_id, emails, mentions, round(least(1.0::double, 0.75::double * ln(1 + emails) / ln(1 + (select max(emails) from per)) + 0.25::double * least(1.0::double, ln(1 + mentions) / ln(51::double))), 4) as salience from per",
    "relations": _with(_MEN, _PAIRS, _IDF, "k as (select email_id, entity_id, p.kind, confidence, idf from pairs p join idf using (entity_id) where not ubiquitous)")
    + """select src, dst, rel, round(sum(w), 4) as weight, count(*) as evidence from (
      select a.entity_id as src, b.entity_id as dst, a.email_id,
        case when a.kind = 'person' and b.kind in ('case', 'project') then 'participant_in' when a.kind = 'case' and b.kind = 'project' then 'belongs_to'
             when (b.kind = 'person' and a.kind in ('case', 'project')) or (a.kind = 'project' and b.kind = 'case') then null when a.entity_id < b.entity_id then 'mentions' end as rel,
        (case when a.kind = 'person' and b.kind in ('case', 'project') then b.confidence when a.kind = 'case' and b.kind = 'project' then a.confidence else 0.5::double end) * a.idf * b.idf as w
      from k a join k b on a.email_id = b.email_id and a.entity_id <> b.entity_id) where rel is not null
      group by src, dst, rel having rel <> 'belongs_to' or count(*) >= 2""",
    "fragmentation": _with(_MEN) + "select kind, case when kind in ('case', 'document', 'person') then 'exact' else 'name' end as keyed, count(*) as nodes, count(*) filter (emails <= 1) as one_email, round(100.0::double * count(*) filter (emails <= 1) / count(*), 4) as percent from (select kind, entity_id, count(distinct email_id) filter (email_id % 2 = 0) as emails from men group by all) group by kind",
    "neighbors_weighted": _with(_MEN, _EDGES, "s as (select distinct src as start from e), h1 as (select start, dst as node, max(weight) as score from s join step on src = start group by all), h2 as (select start, dst as node, max(score * weight) as score from h1 join step on src = node group by all)")
    + "select start, node, round(raw, 6) as score, hop from (select start, node, max(score) as raw, arg_max(hop, (score, -hop))::int as hop from (select *, 1 as hop from h1 union all select *, 2 from h2) where node <> start group by start, node)",
    "neighbors_decayed": _with(_MEN, _EDGES, "s as (select distinct src as start from e), h1 as (select start, dst as node, max(weight) as score from s join step on src = start where dst <> start group by all), h2 as (select start, dst as node, max(score * weight * 0.5::double) as score from h1 join step on src = node where dst <> start group by all)")
    + "select start, node, round(raw, 6) as score, hop from (select start, node, score as raw, 1 as hop from h1 union all select start, node, score, 2 from h2 where not exists (from h1 where h1.start = h2.start and h1.node = h2.node))",
    "evidence_fingerprint": _with(_MEN) + _FP.format("true"),
    "dirty_briefs": _with(_MEN, f"a as ({_FP.format('kind = ' + _lit('case') + ' and email_id % 1000 <> 1')}), b as ({_FP.format('kind = ' + _lit('case'))})") + "select b.entity_id, b.emails, b.hash from b left join a using (entity_id) where b.hash is distinct from a.hash",
    "bm25_search": _with(_TERMS) + "select query_id, rank, chunk_id, score from bm",
    "vector_search": _with(_VEC % "q.vec_id % 50 = 0") + "select query_id, rank, vec_id, score from vec",
    "body_vectors": _with(_VEC % "q.vec_id % 50 = 0", _BODY) + "select query_id, rank, chunk_id, score from vb",
    "first_chunk": _with(_FIRST) + "select email_id, chunk_id from fc",
    "hybrid_search": _with(_TERMS, _VEC % "q.vec_id % 50 = 0", _BODY, _FIRST, *_graph("email_id in (select doc_id // 2 from documents where doc_id % 50 = 0)", "email_id in (select email_id from fc)"), "ask as (select doc_id as query_id, doc_id // 2 as anchor from documents where doc_id % 50 = 0)",
        "ch as (select query_id, chunk_id, rank, 'bm25' as channel from bm union all select query_id, chunk_id, rank, 'vector' from vb union all select query_id, chunk_id, rank, 'graph' from gs join fc using (email_id) join ask using (anchor))")
    + "select query_id, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank, chunk_id, score, channel from (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 6) as score, string_agg(distinct channel, '+' order by channel) as channel from ch group by all) qualify rank <= 10",
    "build_pack": "select conv_id as anchor, turn as priority, length(cut)::int as chars, md5(cut) as digest from (select conv_id, turn, left(text, (1500 - before)::int) as cut from (select *, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as before from conversations) where before < 1500)",
    "find_addresses": r"select doc_id, array_to_string(list_distinct_ordered, ',') as addresses from (select doc_id, list_reduce(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+'), lambda x: [lower(x)]), lambda a, b: case when list_contains(a, b[1]) then a else list_concat(a, b) end) as list_distinct_ordered from documents where regexp_matches(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+'))",
    "normalize_topic": r"""select conv_id, turn, coalesce(nullif(array_to_string((string_split_regex(trim(regexp_replace(lower(text), '["''.]', '', 'g')), '\s+'))[1:3], ' '), ''), 'other') as topic from conversations""",
    "reply_subjects": _with(_MSG) + rf"select email_id, {_BARE} as bare, nullif(regexp_extract(subject, '(?i)^((?:\s*(?:re|fwd|fw)\s*:\s*)*)\[\s*([^\]\s@]+@[^\]\s@]+\.[^\]\s@]+)\s*\]', 2), '') as relayed, regexp_replace(subject, '(?i)^((?:\s*(?:re|fwd|fw)\s*:\s*)*)\[\s*[^\]\s@]+@[^\]\s@]+\.[^\]\s@]+\s*\]\s*', '\1') as rest from msg",
    "message_ids": _with(_MSG) + rf"""select email_id, id, case when split_part(id, '-', 1) in ({", ".join(map(_lit, T.CASE_PREFIXES))}) or starts_with(id, '#') then 'case' else 'document' end as kind, upper(regexp_replace(id, '[^\w]+', '', 'g')) as key
      from (select email_id, unnest(list_concat(regexp_extract_all(subject, '\b([A-Z]{{2,10}}-\d{{1,6}}(?:-\d{{1,6}})?)\b', 1), regexp_extract_all(subject, '(#\d{{3,}})', 1))) as id from msg)""",
    "urgency_hits": _with(_MSG) + f"select email_id, array_to_string(list_filter([{', '.join(map(_lit, T.URGENCY))}], lambda w: contains(lower(subject), w)), ',') as hits from msg where hits <> ''",
    "scheduling_signals": _with(_MSG, "t as (select email_id, subject || chr(10) || left(repeat('x ', 990) || category || ' let us find some time', 2000) as said, email_id % 13 in (0, 1, 2) as invite, email_id % 5 = 0 as bulk from msg)",
        f"f as (select *, {_SIGNALS(T.STRONG, T.STRONG_WHY)} as strong, {_SIGNALS(T.WEAK, T.WEAK_WHY)} as weak from t)")
    + f"select email_id, points, array_to_string(list_concat(case when invite then [{_lit(T.INVITE_WHY)}] else [] end, strong, weak, case when void then [{_lit(T.BULK_WHY)}] else [] end), ';') as reasons, invite or points >= 2 as related from (select *, case when void then 0 else 2 * len(strong) + len(weak) end::int as points from (select *, bulk and len(strong) = 0 and not invite as void from f))",
    "no_reply_rules": _with(_MSG, "h as (select email_id, case when email_id % 9 = 0 then 'noreply@example.com' when email_id % 9 = 1 then 'alerts@example.com' else sender end as a, email_id % 8 = 0 as bulk, email_id % 6 = 0 as uns, email_id % 7 = 0 as auto, email_id % 12 = 0 as rt from msg)")
    + "select email_id, case when starts_with(a, 'noreply') or bulk or (uns and not rt) or (starts_with(a, 'alerts') and uns) then true when not starts_with(a, 'alerts') and not uns and not auto and not bulk then false end as verdict from h",
    "reply_effort": _with(_MSG) + "select email_id, case when outline_points > 0 then case when outline_points + coalesce(is_scheduling, false)::int <= 2 then 'quick' when outline_points + coalesce(is_scheduling, false)::int <= 4 then 'moderate' else 'involved' end end as effort from msg",
    "html_to_text": f"select page_id, {_page_text('html')} as text from pages",
    "model_stage": "select doc_id, array_to_string(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0b]+'), lambda w: w <> '')[1:3], ' ') as value, null::varchar as error from documents",
    "merge_intervals": _with(_BUSY, _MERGED) + 'select calendar_id, s as start, e as "end" from merged',
    "free_windows": _with(_BUSY, _MERGED, _FREE) + "select calendar_id, free_from, free_to from free where free_from < free_to",
    "suggest_slots": _with(_BUSY, _MERGED, _FREE) + f"select calendar_id, row_number() over (partition by calendar_id order by slot)::int as nth, slot from (select calendar_id, free_from // {_DAY} as day, min(free_from) as slot from free where free_to - free_from >= 1800000000 group by all) qualify nth <= 3",
    "slot_conflicts": _with(_BUSY) + "select a.event_id as slot_id, count(distinct b.event_id) as conflicts from busy a left join busy b on b.calendar_id = a.calendar_id and b.e > b.s and a.s < b.e and b.s < a.s + 3600000000 where a.event_id % 10 = 0 group by a.event_id",
    "events_by_day": "select ts::date as day, event_type, count(*) as n from events group by all",
    "due_stages": _with(_MSG, _PROC) + f"select email_id, array_to_string(stages, ',') as stages from ({_STAGES}) where len(stages) > 0",
    "plan_summary": _with(_MSG, _PROC) + f"select stage, count(*) as n from (select unnest(stages) as stage from ({_STAGES})) group by stage",
    "desired_todos": _with(_MSG, _PROC, _TODO.format("proc")) + "select * from todo",
    "sync_todos": _with(_MSG, _PROC, "batch as (select * from proc where email_id % 7 <> 0)", _TODO.format("batch"), "half as (select * from proc where email_id % 2 = 0)", _TODO.format("half").replace("todo as", "had as", 1), "st as (select *, case when email_id % 3 = 0 then 'done' else 'open' end as status from had)")
    + "select todo_id, email_id, kind, text, case when status = 'open' and email_id % 7 <> 0 and todo_id not in (select todo_id from todo) then 'done' else status end as status from st union all select *, 'open' from todo where todo_id not in (select todo_id from st)",
    "stream_stats": "select date_trunc('day', ts) as window_start, event_type, count(*) as n from events group by all",
    "stream_dedupe": "select event_id, user_id from events",
    "stream_latest": "select user_id, event_type, max_by(value, (ts, event_id)) as value from events group by all",
    "stream_sessions": "select user_id, min(ts) as session_start, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (select *, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minutes then 0 else 1 end as fresh from events)) group by user_id, s",
    "graph_search": _with(*_graph("email_id % 50 = 0", "true"))
    + "select anchor, rank, email_id, score from gs",
    "related_context": _with(*_graph("email_id % 50 = 0", "true")[:6], "sl as (select entity_id, round(least(1.0::double, 0.75::double * ln(1 + emails) / ln(1 + (select max(emails) from per)) + 0.25::double * least(1.0::double, ln(1 + mentions) / ln(51::double))), 4) as salience from per)",
        "tp as (select anchor, entity_id, row_number() over (partition by anchor order by salience desc, entity_id)::int as nth from anchor join sl using (entity_id) qualify nth <= 10)")
    + "select anchor as email_id, 'entity' as what, nth, entity_id as id from tp union all select anchor, 'message', row_number() over (partition by anchor order by email_id)::int as nth, email_id::varchar from (select distinct anchor, m.email_id from tp join m using (entity_id) where m.email_id <> anchor) qualify nth <= 10",
    "project_rollup": _with(_MEN, _EDGES, "per as (select entity_id, count(distinct email_id) as emails, count(*) as mentions from men where kind in ('case', 'project') group by entity_id)",
        "tp as (select entity_id as start, row_number() over (order by salience desc, entity_id)::int as place from (select entity_id, round(least(1.0::double, 0.75::double * ln(1 + emails) / ln(1 + (select max(emails) from per)) + 0.25::double * least(1.0::double, ln(1 + mentions) / ln(51::double))), 4) as salience from per where entity_id like 'project:%') qualify place <= 20)",
        "h1 as (select start, dst as node, max(weight) as score from tp join step on src = start group by all), h2 as (select start, dst as node, max(score * weight) as score from h1 join step on src = node group by all)",
        "best as (select start, node, max(score) as score, arg_max(hop, (score, -hop))::int as hop from (select *, 1 as hop from h1 union all select *, 2 from h2) where node <> start group by start, node)",
        "rk as (select *, split_part(node, ':', 1) as kind, row_number() over (partition by start, split_part(node, ':', 1) order by hop, score desc, node)::int as nth, count(*) over (partition by start, split_part(node, ':', 1)) as n from best)")
    + "select start as project, place, kind, nth, node, round(score, 6) as score, hop, greatest(n - 12, 0) as more from rk join tp using (start) where nth <= 12",
    "entity_listing": _with(_MEN, "per as (select entity_id, count(distinct email_id) as emails, count(*) as mentions from men group by entity_id)", "sal as (select entity_id, mentions, round(least(1.0::double, 0.75::double * ln(1 + emails) / ln(1 + (select max(emails) from per)) + 0.25::double * least(1.0::double, ln(1 + mentions) / ln(51::double))), 4) as salience from per)")
    + "select entity_id, salience, mentions, (select count(*) from sal) as total from sal order by salience desc, mentions desc, entity_id limit 25",
    "batch_rows": _with(_MSG) + "select sender, batch, count(*) as n, min(email_id) as least from (select *, (row_number() over (partition by sender order by received_at, email_id) - 1) // 20 as batch from msg) group by all",
    "sort_by_effort": _with(_MSG) + "select email_id, effort, value from (select *, case when outline_points > 0 then case when outline_points + coalesce(is_scheduling, false)::int <= 2 then 0 when outline_points + coalesce(is_scheduling, false)::int <= 4 then 1 else 2 end end as effort from msg) order by effort nulls last, value desc, email_id limit 50",
    "agenda": _with(_BUSY) + f"select s // {_DAY} as day, calendar_id, count(*) as n, sum(e - s)::bigint as micros from busy where s >= (select max(s) - 3 * {_DAY} from busy) group by all",
    "sender_counts": _with(_MSG) + "select split_part(sender, '@', 1) as local, 'example' as org, count(*) as n, count(*) filter (read_status = 'unread') as unread from msg group by all",
    "first_claimant": "select lower(o_orderpriority) as name, 'ent_' || substr(sha1('person:' || arg_min(o_custkey, o_orderkey)), 1, 16) as entity_id, min(o_orderkey) as place from (select *, regexp_replace(o_orderpriority, '[^A-Za-z0-9 @.+-]+', ' ') as x from orders) group by o_orderpriority",
    "normalize_name": "select p_partkey, lower(p_name) || ' projects' as name from part",
    "table_counts": _with(_MSG, _LOG, _MEN) + "select 'messages' as name, count(*) as n from msg union all select 'mentions', count(*) from men union all select 'chunks', count(*) from documents union all select 'feedback', count(*) from log",
    "match_vector": _with(_NAMES) + "select id, entity_id, score from nr qualify row_number() over (partition by id order by score desc, entity_id) = 1",
}
