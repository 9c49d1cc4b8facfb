"""DuckDB twins of the operator queries that SQL can express."""

from __future__ import annotations

_SHRINK_LEVEL = """
least(greatest(case when {v} > {b} and {q} > 0 then {q} / ({v} - {b}) - 1 else 200.0 end, 2.0), 200.0)"""


def _strength(n: str, k: str, m: str) -> str:
    v, b, q = (f"sum(pow({k} - {n} * {m}, 2))", f"sum({n} * {m} * (1 - {m}))", f"sum({n} * ({n} - 1) * {m} * (1 - {m}))")
    return "coalesce(" + _SHRINK_LEVEL.format(v=v, b=b, q=q) + ", 200.0)"


OP1 = f"""
with u as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest,
 try_cast(nullif(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1), '') as bigint) as doc_id from pages),
p as (select page_id, doc_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
l as (select doc_id, min(case when quality is not null and toxic is not null then (quality = 1 and toxic = 0)::int end) as good from labels group by doc_id),
h0 as (select host, count(good)::double as n, coalesce(sum(good), 0)::double as k from p left join l using (doc_id) group by host),
h1 as (select *, split_part(host, '.', -1) as suffix,
 case when strpos(host, '.') > 0 then concat_ws('.', split_part(host, '.', -2), split_part(host, '.', -1)) else host end as domain from h0),
d0 as (select domain, suffix, sum(n) as n, sum(k) as k from h1 group by all),
t0 as (select suffix, sum(n) as n, sum(k) as k from d0 group by suffix),
base as (select (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) as m from t0),
ts as (select {_strength('n', 'k', 'm')} as s from t0, base),
t1 as (select suffix, (k + s * m) / (n + s) as m from t0, base, ts),
d1 as (select d0.*, t1.m from d0 join t1 using (suffix)),
ds as (select {_strength('n', 'k', 'm')} as s from d1),
d2 as (select domain, suffix, (k + s * m) / (n + s) as m from d1, ds),
h2 as (select h1.*, d2.m from h1 join d2 using (domain, suffix)),
hs as (select {_strength('n', 'k', 'm')} as s from h2),
h3 as (select host, (k + s * m) / (n + s) as g, n, s from h2, hs),
r as (select host, round(least(g + 2.0 * sqrt(g * (1 - g) / (n + s + 1)), 1.0), 6) as high from h3),
f as (select page_id, host, path, case
 when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
 when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
 when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
 when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule,
 high from (select page_id, coalesce(host, '') as host, coalesce(path, '') as path from p) left join r using (host))
select page_id, host, path, rule, case rule when 'net/' then 'block' when 'example.net/en/' then 'allow'
 when 'example.com/de/' then 'block' when 'org/fr/' then 'allow'
 else case when high < 0.5 then 'block' else 'allow' end end as verdict from f
"""

OP4 = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest from p),
k as (select payload_digest, max(page_id) as keeper from d where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, payload_digest,
 case when keeper is null or page_id = keeper then 'response' else 'revisit' end as record_type,
 case when page_id <> keeper then keeper end as refers_to
from d left join k using (payload_digest)
"""

OP12 = """
with r as (select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as l,
 [floor(256 * x::double) for x in embedding] as q from embeddings
 where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select a.rid as arid, a.vec_id as aid, a.l as al, r.rid, r.vec_id, r.l, list_inner_product(a.q, r.q)::bigint as score
 from r a join r on len(a.q) = len(r.q) and a.rid <> r.rid where a.vec_id % 100 = 0),
p as (select *, row_number() over (partition by arid order by score desc, vec_id nulls last, rid) as pr from s where l = al qualify pr <= 5),
n as (select p.aid, p.vec_id as pid, p.score as ps, s.vec_id as nid, s.score as ns,
 row_number() over (partition by p.arid, p.pr order by s.score desc, s.vec_id nulls last, s.rid) as rank
 from p join s on s.arid = p.arid and s.l <> s.al and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score qualify rank <= 10)
select aid as anchor_id, pid as positive_id, rank::int as rank, nid as negative_id, ps as positive_score, ns as negative_score from n
"""

OP13 = r"""
with t as (select coalesce(lang, 'und') as lang,
 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws
 from (select lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) as piece from t)),
g as (select lang, k, ws[i:i + k - 1] as p
 from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (values (1), (2), (3), (4)) v(k))),
f as (select lang, k, p, count(*)::bigint as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select * from f where k > 1 and f >= 30),
inner_ as (select lang, p[i:i + s - 1] as p, max(f) as longer
 from (select lang, p, f, s, unnest(range(1, k - s + 2)) as i from c, (values (2), (3)) v(s) where s < k) group by all),
kept as (select c.* from c left join inner_ using (lang, p) where longer is null or 100 * longer::hugeint < 80 * c.f::hugeint),
cuts as (select lang, k, p, f, unnest(range(1, k)) as cut from kept),
scored as (select cuts.lang, cuts.p, cuts.f as a, l.f as l, r.f as r, ((2000000::hugeint * cuts.f) // (l.f + r.f))::bigint as score, cut
 from cuts join f l on l.lang = cuts.lang and l.p = cuts.p[1:cut] join f r on r.lang = cuts.lang and r.p = cuts.p[cut + 1:cuts.k]),
best as (select * from scored qualify row_number() over (partition by lang, p order by score, cut) = 1),
ranked as (select lang, array_to_string(p, ' ') as phrase, a, l, r, n, score,
 row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) as rank from best join n using (lang))
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""

ORACLE = {"op1_url_filter": OP1, "op4_warc": OP4, "op12_hard_negatives": OP12, "op13_collocations": OP13}
