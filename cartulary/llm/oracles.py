"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations


def lloyd(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """Lloyd's rounds unrolled, every distance computed."""
    steps = [
        f"""kept as materialized (select row_number() over (order by vec_id) - 1 as rid, vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"part as materialized (select rid, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] as x from kept, range({parts}) as t(p))",
        f"c0 as materialized (select p, rid as e, x as c from part where rid < {entries})",
    ]
    for i in range(rounds + 1):
        distance = "cast(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
        steps.append(f"a{i} as materialized (select rid, p, min({distance} * {entries} + e) as k from part join c{i} using (p) group by rid, p)")
        if i < rounds:
            steps.append(f"""s{i} as (select p, k % {entries} as e, pos, cast(sum(x[pos]) as bigint) as s, count(*) as n from a{i} join part using (rid, p), (select unnest(range(1, (select max(len(x)) from part) + 1)) as pos) group by all)""")
            steps.append(f"m{i} as (select p, e, list((s - ((s % n) + n) % n) // n order by pos) as c from s{i} group by p, e)")
            steps.append(f"c{i + 1} as materialized (select c{i}.p, c{i}.e, coalesce(m{i}.c, c{i}.c) as c from c{i} left join m{i} on c{i}.p = m{i}.p and c{i}.e = m{i}.e)")
    return f"""with {", ".join(steps)},
coded as (select rid, string_agg(printf('%02x', cast(k % {entries} as integer)), '' order by p) as code, cast(sum(k // {entries}) as bigint) as error from a{rounds} group by rid),
book as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as h from c{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from kept join coded using (rid), book"""


DIVERGENCE = r"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') as words from documents),
w as (select rid, lang, source, unnest(words) as term from d),
per as (select rid, lang, source, term, count(*) as n from w group by all),
kept as materialized (select lang, term from per group by lang, term having count(*) >= 3),
c as materialized (select lang, source, term, cast(sum(n) as hugeint) as n from per join kept using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v from kept group by lang),
t as (select lang, source, sum(n) as total from c group by lang, source),
p as materialized (select g.lang, g.source, kept.term, coalesce(c.n, 0) as n, cast(1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + v.v) as bigint) as p
  from g join kept using (lang) join v using (lang) left join t on t.lang = g.lang and t.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
q as (select lang, term, cast(1 + (1000000000 * (sum(n) + 1)) // (any_value(w.total) + any_value(v.v)) as bigint) as q
  from c join (select lang, sum(n) as total from c group by lang) w using (lang) join v using (lang) group by lang, term),
pair as (select a.lang, a.source, b.source as item, sum(cast((a.p - b.p) as hugeint) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
allpairs as (select a.lang, a.source, b.source as item, cast(coalesce(pair.value, 0) as bigint) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source),
term as (select p.lang, p.source, p.term as item, (p.p - q.q) * (p.p - q.q) // q.q as value from p join q using (lang, term) where p.n > 0 and p.p > q.q)
select lang, source, 'pair' as part, item, value, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from allpairs
union all
select * from (select lang, source, 'term' as part, item, value, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from term) where rank <= 200
"""
