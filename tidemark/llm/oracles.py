"""DuckDB SQL for the queries that SQL can express on whole tables; the others are tested against brute force."""

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'
)
select conv_id,
       count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1
           + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::bigint as formatted_chars
from t group by conv_id
""",
    "op4_top_k": r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e
  from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 10
""",
    "op9_url_filter": r"""
with host as (
  select page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)', 1)), '\.$', '') as host,
         make_timestamp(((1704067200 + (page_id * 7919) % 31536000) * 1000000)::bigint) as at
  from pages
), listed as (
  select distinct host as key, ('0x' || substr(md5(host), 1, 8))::bigint as h from host where host <> ''
), e as (
  select key, h from listed where h % 3 = 0
), held as (
  select key, case when h % 2 = 0 then 'spam' else 'adult' end as list, false as allow, h % 100 as a, h % 90 + 120 as b from e
  union all
  select key, case when h % 2 = 0 then 'spam' else 'adult' end, false, h % 60 + 240, null from e
  union all
  select key || '/en/', 'allowed', true, h % 50, null from e where h % 9 = 0
), span as (
  select key, list, allow, timestamp '2024-01-01' + to_days(a::int) as since, timestamp '2024-01-01' + to_days(b::int) as until from held
), hit as (
  select page_id, url, s.key, s.list, s.allow, s.since
  from host p join span s
    on (s.key = p.host or ends_with(p.host, '.' || s.key) or (ends_with(s.key, '/') and starts_with(p.host || regexp_extract(url, '^[^:]+://[^/?#]*(/[^?#]*)', 1), s.key)))
   and s.since <= p.at and (s.until is null or p.at < s.until)
  qualify row_number() over (partition by page_id order by length(s.key) desc, s.allow desc, s.list desc, s.key desc, s.since desc) = 1
)
select p.page_id, p.url, coalesce(not h.allow, false) as blocked, h.key, h.list, h.since
from host p left join hit h using (page_id)
""",
}
