"""What the queries must return, in SQL for DuckDB, where SQL can express it."""

from __future__ import annotations

from math import ceil

from .license_scan import PHRASES, TEMPLATES
from .url_filter import HOST_RULES, PATTERN_RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEXT = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Components by the smallest label, over links (a, b) in both directions.
_COMPONENTS = """comps(id, c) using key (id) as (select id, id from nodes
 union select l.b, min(s.c) from comps s join links l on l.a = s.id join recurring.comps r on r.id = l.b where s.c < r.c group by 1)"""

NGRAM_JOIN = f"""
with recursive ws as (select doc_id, regexp_extract_all({_TEXT}, '{_SPACED}') as w from documents),
sets as (select doc_id as id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from ws),
nodes as (select id, len(s) as n from sets),
tokens as (select id, unnest(s) as t from sets),
pairs as (select a.id as a, b.id as b, count(*) as k from tokens a join tokens b on a.t = b.t and a.id <> b.id group by 1, 2),
links as (select a, b from pairs join nodes x on x.id = a join nodes y on y.id = b where 100 * k >= 85 * (x.n + y.n - k)),
{_COMPONENTS}
select nodes.id as doc_id, n::bigint as n_shingles, c as component_id from nodes join comps on comps.id = nodes.id"""

EMBEDDING_DEDUP = f"""
with recursive usable as (select vec_id as id, label, embedding::double[] as v from embeddings where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
nodes as (select vec_id as id from embeddings),
links as (select a.id as a, b.id as b from usable a join usable b on a.label = b.label and a.id <> b.id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.93),
{_COMPONENTS}
select nodes.id as vec_id, (select count(*) from links where a = nodes.id) as n_links, c as component_id, nodes.id = c as kept from nodes join comps on comps.id = nodes.id"""


def _fits(r) -> str:
    return f"((host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}'))"


def _url_filter() -> str:
    rules = sorted(HOST_RULES, key=lambda r: -len(r.name))
    first = sorted(PATTERN_RULES, key=lambda r: (r.action != "allow", r.name))
    rule = " ".join(f"when {_fits(r)} then '{r.name}'" for r in rules)
    verdict = " ".join(f"when rule = '{r.name}' then '{r.action}'" for r in rules) + " " + " ".join(f"when pattern = '{r.name}' then '{r.action}'" for r in first)
    pattern = " ".join(f"when regexp_matches(lower(url), '{r.regex}') then '{r.name}'" for r in first)
    return f"""
with parts as (select page_id, url, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
ruled as (select *, case {rule} end as rule from parts),
found as (select *, case when rule is not null then null {pattern} end as pattern from ruled)
select page_id, host, path, rule, case {verdict} else 'allow' end as verdict, pattern from found"""


CHAT_FORMAT = """
with recursive asked as (select conv_id, turn, text, length(text) as n, conv_id || ':' || turn as call_id from conversations where role = 'user'),
deps as (select conv_id, turn, turn - 2 as dep from asked where n % 4 <> 0 union select conv_id, turn, turn - 4 from asked where n % 3 = 0),
depths(conv_id, turn, level) as (select conv_id, turn, 0 from asked union select d.conv_id, d.turn, l.level + 1 from depths l join deps d on d.conv_id = l.conv_id and d.dep = l.turn),
calls as (select a.*, max(level) as level from asked a join depths using (conv_id, turn) group by all),
results as (select conv_id, turn as r_turn, text as content, conv_id || ':' || (turn - 1) as call_id from conversations where role = 'assistant'),
whole as (
 select c.conv_id, c.turn, c.call_id, c.level, case when r.call_id is null then 'open' else 'linked' end as state, r.content, case n % 5 when 2 then 'count' when 3 then 'translate' else 'search' end as name,
  case n % 5 when 0 then '{"limit":' || (n % 7) || ',"query":' || to_json(c.text) || '}' when 1 then '{"query":' || to_json(c.text) || '}' when 2 then '{"chars":"' || n || '"}' when 3 then '{"text":' || to_json(c.text) || '}' else 'null' end as arguments,
  case n % 5 when 0 then '' when 1 then 'missing limit' when 2 then 'chars is no integer' when 3 then 'unknown tool' else 'malformed' end as problems
 from calls c left join results r on r.conv_id = c.conv_id and r.call_id = c.call_id
 union all
 select r.conv_id, r.r_turn, r.call_id, 2147483647, 'orphan', r.content, null, 'null', '' from results r where not exists (select 1 from calls c where c.conv_id = r.conv_id and c.call_id = r.call_id)
 union all
 select conv_id, turn, null, -1, 'other', text, role, 'null', '' from conversations where role is null or role not in ('user', 'assistant'))
select conv_id, row_number() over (partition by conv_id order by level, turn, call_id) - 1 as position, turn, call_id, level::int as level, state, problems,
 '{"arguments":' || arguments || ',"call_id":' || coalesce(to_json(call_id)::varchar, 'null') || ',"content":' || coalesce(to_json(content)::varchar, 'null') || ',"name":' || coalesce(to_json(name)::varchar, 'null') || ',"problems":' || case problems when '' then '[]' else '["' || problems || '"]' end || ',"state":' || to_json(state) || ',"turn":' || turn || '}' as json from whole"""

DECONTAMINATION = f"""
with docs as (select doc_id, regexp_extract_all({_TEXT}, '{_ALNUM}') as w from documents),
items as (select item_id, regexp_extract_all({_TEXT}, '{_ALNUM}') as w from benchmark),
wins as (select distinct item_id, len(w[p:p + 9]) as size, array_to_string(w[p:p + 9], ' ') as t from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from items where len(w) > 0)),
sizes as (select distinct size from wins),
spots as (select doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') as t from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as p from docs, sizes)),
found as (select doc_id, item_id, p, s.size from spots s join wins using (size, t)),
hits as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + size)) as q from found) group by 1),
held as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list_distinct(list(item_id::varchar))), ',') as ids from found group by 1)
select docs.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from docs left join hits using (doc_id) left join held using (doc_id)"""


def _license_scan(threshold: float = 0.8) -> str:
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"({k}, '{label}', {sorted(set(t.split()))}, {max(1, ceil(threshold * len(set(t.split())) - 1e-9))})" for k, (t, label) in enumerate(TEMPLATES))
    return f"""
with docs as (select doc_id, {_TEXT} as t, regexp_extract_all({_TEXT}, '{_ALNUM}') as w from documents),
phrases(p, label) as (values {phrases}),
spots as (select doc_id, label, i - 1 as place from (select doc_id, label, w, string_split(p, ' ') as q, unnest(range(1, len(w) - len(string_split(p, ' ')) + 2)) as i from docs, phrases where contains(t, string_split(p, ' ')[1])) where w[i:i + len(q) - 1] = q),
base as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, array_to_string(list_sort(list_distinct(list(label))), ',') as base_labels from spots group by 1),
templates(k, label, words, need) as (values {templates}),
blocks as (select doc_id, b, list_distinct(regexp_extract_all(line, '{_ALNUM}')) as ws from (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as b from docs)),
met as (select doc_id, b, k, label, words, list_intersect(words, ws) as own, len(list_intersect(words, ws)) / len(words) as share from blocks, templates where len(list_intersect(words, ws)) >= need),
kept as (select * from met m where not exists (select 1 from met o where o.doc_id = m.doc_id and o.b = m.b and o.share > m.share and list_has_all(o.words, m.own))),
named as (select doc_id, label, 1.0::double as share from spots union all select doc_id, label, share from kept),
labels as (select doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') as labels, max(share) as score from named group by 1)
select docs.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score from docs left join base using (doc_id) left join labels using (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": NGRAM_JOIN,
    "op3_embedding_dedup": EMBEDDING_DEDUP,
    "op4_url_filter": _url_filter(),
    "op6_chat_format": CHAT_FORMAT,
    "op8_decontamination": DECONTAMINATION,
    "op9_license_scan": _license_scan(),
}
