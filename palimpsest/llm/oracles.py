"""DuckDB SQL for the operators that SQL can express.

op2: rules, and the beta posteriors with the same moments; op5: windows by list slices.
Learnt scores (op1, op9, op10), token ids, fingerprints, html, near-duplicate components
and mixing thresholds have no SQL form that is fast enough on whole tables or equal to the
last bit; tests hold them against brute force.
"""

OP2 = r"""
with p as (
  select page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
s as (select *, string_split(host, '.') as l from p),
k as (select *, case when len(l) >= 3 and length(l[-1]) = 2 and l[-2] in ('co', 'com', 'org', 'net', 'ac', 'gov', 'edu') then 3 else 2 end as n from s),
d as (select *, case when len(l) <= n then host else array_to_string(l[len(l) - n + 1 :], '.') end as domain from k),
x as (select *, case when contains(domain, '.') then regexp_replace(domain, '^[^.]*\.', '') else domain end as suffix from d),
lab as (select doc_id, min(case when quality = 1 and toxic = 0 then 1 else 0 end) as good from labels group by doc_id),
o as (select x.host, x.domain, x.suffix, good from x join lab on lab.doc_id = try_cast(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]{1,18})', 1) as bigint) where good is not null),
h as (select host, domain, suffix, count(*)::double as n, sum(good)::double as g from o group by all),
dm as (select domain, suffix, sum(n) as n, sum(g) as g from h group by all),
sx as (select suffix, sum(n) as n, sum(g) as g from dm group by all),
root as (select (coalesce(sum(g), 0) + 1) / (coalesce(sum(n), 0) + 2) as m0 from sx),
sk as (select sum(n) as big, sum(n * pow(g / n - m0, 2)) / sum(n) as spread, sum(n) - sum(n * n) / sum(n) as scale, count(*) as c, max(m0 * (1 - m0)) as v from sx, root),
st as (select coalesce(least(400, greatest(4, case when scale > 0 and (spread * big - (c - 1) * v) / scale > 0 then v / ((spread * big - (c - 1) * v) / scale) - 1 else 400 end)), 400) as k from sk),
sp as (select suffix, (g + k * m0) / (n + k) as m_s, n + k as w_s from sx, root, st),
dk as (select suffix, sum(n) as big, sum(n * pow(g / n - m_s, 2)) / sum(n) as spread, sum(n) - sum(n * n) / sum(n) as scale, count(*) as c, max(m_s * (1 - m_s)) as v from dm join sp using (suffix) group by suffix),
dt as (select suffix, coalesce(least(400, greatest(4, case when scale > 0 and (spread * big - (c - 1) * v) / scale > 0 then v / ((spread * big - (c - 1) * v) / scale) - 1 else 400 end)), 400) as k from dk),
dp as (select domain, (g + k * m_s) / (n + k) as m_d from dm join sp using (suffix) join dt using (suffix)),
hk as (select domain, sum(n) as big, sum(n * pow(g / n - m_d, 2)) / sum(n) as spread, sum(n) - sum(n * n) / sum(n) as scale, count(*) as c, max(m_d * (1 - m_d)) as v from h join dp using (domain) group by domain),
ht as (select domain, coalesce(least(400, greatest(4, case when scale > 0 and (spread * big - (c - 1) * v) / scale > 0 then v / ((spread * big - (c - 1) * v) / scale) - 1 else 400 end)), 400) as k from hk),
hp as (select host, (g + k * m_d) / (n + k) as m_h, n + k as w_h, n as n_h from h join dp using (domain) join ht using (domain)),
j as (select x.*, coalesce(m_h, m_d, m_s, m0) as mean, case when m_h is not null then w_h else 4 end as weight, coalesce(n_h, 0) as n_o
  from x left join hp using (host) left join dp using (domain) left join sp using (suffix), root),
r as (select *, mean + 1.96 * sqrt(mean * (1 - mean) / (weight + 1)) as bound,
  case when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
       when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
       when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
       when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
       when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from j)
select page_id, host, path, rule,
  case when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null then 'block' when bound < 0.5 then 'block' else 'allow' end as verdict,
  round(mean, 9) as good_mean, round(bound, 9) as good_upper, cast(n_o as bigint) as n_outcomes from r
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = rf"""
with b as (select distinct cast(item_id as varchar) as item, {_WORDS} as w from benchmark where item_id is not null and text is not null),
win as (select distinct item, array_to_string(w[i : least(i + 7, len(w))], ' ') as g, least(8, len(w)) as k from b, unnest(range(1, greatest(2, len(w) - 6))) as t(i) where len(w) > 0),
d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
sizes as (select distinct k from win),
s as (select r, i, sizes.k, array_to_string(w[i : i + sizes.k - 1], ' ') as g from d, sizes, unnest(range(1, len(w) - sizes.k + 2)) as t(i)),
hit as (select s.r, s.i, s.k, win.item from s join win on s.g = win.g and s.k = win.k),
hw as (select r, count(distinct j) as n_hit from hit, unnest(range(i, i + k)) as t(j) group by r),
it as (select r, count(*) as n, string_agg(item, ',' order by item) as ids from (select distinct r, item from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n, 0) >= 2 as contaminated
from d left join hw using (r) left join it using (r)
"""

ORACLES: dict[str, str] = {"op2_url_filters": OP2, "op5_decontamination": OP5}
