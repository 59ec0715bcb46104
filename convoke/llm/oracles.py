"""DuckDB SQL for the queries that SQL can express (exact dedup's stands with its operator)."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2_SQL = rf"""
with d as (select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
i as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50),
g as (select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as g from i),
f as (select g, min(doc_id) as first from g group by g),
c as (select distinct doc_id, unnest(range(i, i + 50)) as k from g join f using (g) where first < doc_id),
n as (select doc_id, count(*) as gone, list(k) as ks from c group by doc_id),
x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from d),
kept as (select x.doc_id, string_agg(word, ' ' order by x.k) as text from x anti join c on x.doc_id = c.doc_id and x.k = c.k group by x.doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(gone, 0)::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join n using (doc_id) left join kept using (doc_id)
"""

OP10_SQL = rf"""
with recursive d as (select doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (g) where a.doc_id <> b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
reach as (select doc_id as x, doc_id as y from documents union select r.x, l.y from reach r join l on r.y = l.x)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(reach.y) as component_id
from d left join n using (doc_id) join reach on reach.x = d.doc_id group by d.doc_id
"""
