"""For each query of the catalogue the same result as DuckDB SQL."""

from __future__ import annotations

from cartulary.functions import fixed
from cartulary.plans import values as v

LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
STOP = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)
VPATH = "source || '/' || lang || '/doc_' || lpad(cast(doc_id as varchar), 8, '0') || case when doc_id % 10 = 0 then '.pdf' when doc_id % 10 = 1 then '.docx' when doc_id % 10 in (2, 3, 4) then '.rs' else '.md' end"
VADAPTER = "case when doc_id % 10 = 0 then 'pdf' when doc_id % 10 = 1 then 'docx' when doc_id % 10 in (2, 3, 4) then 'code' else 'markdown' end"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
QUESTION = "'Which license and token does the Apache release mention'"


def ALL(name: str) -> str:
    """The cases and rows of that name over DuckDB's table."""
    return getattr(v, f"ALL_{name}").replace(v.DOCUMENTS, "documents")


def low(text: str) -> str:
    return LOW.format(text)


def stem(w: str) -> str:
    cases = " ".join(f"when {w} like '%{s}' and length({w}) >= {len(s) + 3} then left({w}, length({w}) - {len(s)})" for s in fixed.SUFFIXES)
    return f"case {cases} else {w} end"


def terms(text: str) -> str:
    """List of distinct stems, in no particular order."""
    words = f"list_filter(regexp_extract_all({low(text)}, '[a-z0-9_]{{3,}}'), lambda w: w not in ({STOP}))"
    return f"list_distinct(list_transform({words}, lambda w: {stem('w')}))"


def lines_of(source: str, key: str = "doc_id", text: str = "text") -> str:
    """Subquery (key, l): the lines as a list."""
    return f"(select {key}, case when l[len(l)] = '' then l[:len(l) - 1] else l end as l from (select {key}, string_split_regex({text}, '\\r?\\n') as l from {source}))"


def each_line(source: str, key: str = "doc_id", text: str = "text") -> str:
    return f"(select {key}, unnest(l) as line, generate_subscripts(l, 1) as line_no from {lines_of(source, key, text)})"


HEADED = f"(select doc_id, line_no, case when line_no % 5 = 0 then '## ' || line else line end as line from {each_line('documents')})"
SNAPSHOTS = """
now_ as (select doc_id, cast(doc_id as varchar) as path, sha256(text) as hash from documents),
old_ as (select doc_id, cast(doc_id as varchar) as path, sha256(case when doc_id % 15 = 1 then text || 'x' else text end) as hash, 'role ' || (doc_id % 3) as role from documents where doc_id % 10 <> 0
  union all select doc_id + 100000000, 'gone ' || doc_id, sha256(text), 'role ' || (doc_id % 3) from documents where doc_id % 100 = 7)"""
MAPPED = f"""(select doc_id, text, case doc_id % 11 when 0 then 'conf/doc_' || doc_id || '.env' when 1 then 'img/doc_' || doc_id || '.png' when 2 then 'node_modules/doc_' || doc_id || '.md'
  when 3 then '.aws/doc_' || doc_id else {VPATH} end as path,
  case when doc_id % 11 in (0, 1, 3) then 'code' when doc_id % 11 = 2 then 'markdown' else {VADAPTER} end as adapter,
  strlen(text) * case when doc_id % 11 = 4 then 100 else 1 end as size from documents)"""
REASON = "when doc_id % 11 in (0, 3) then 'sensitive' when doc_id % 11 = 1 then 'binary_or_unsupported' when adapter not in ('pdf', 'docx') and size > 300000 then 'too_large'"
IDF_CTE = f"""
q as (select unnest({terms(QUESTION)}) as term),
f as (select path, unnest({terms('t')}) as term from (select {VPATH} as path, ({VPATH}) || ' ' || ({VADAPTER}) || ' file ' || ' ' || left(text, 20000) as t from documents)),
hits as (select f.path, f.term from f join q on f.term = q.term),
df as (select term, count(*) as df from hits group by term),
cand as (select path, round(sum(1.0 / df), 6) as score from hits join df using (term) group by path order by score desc, path limit 20)"""
TENTHS = f"""(select doc_id, min(line_no) as first_line, count(*) as n_lines, string_agg(line_no || '| ' || line, chr(10) order by line_no) as body from {each_line('documents')} group by doc_id, (line_no - 1) // 10)"""


def score_cte(source: str, out: str) -> str:
    """CTE: chunks of ``source`` with their score by the question's terms."""
    count = f"(length({low('body')}) - length(replace({low('body')}, term, ''))) / length(term)"
    return f"{out} as (select {source}.*, (select coalesce(sum(case when {count} > 0 then 2 + {count} else 0 end), 0) from q) as found from {source})"


FIFTHS = f"""
fifths as (select doc_id, path, score, min(line_no) as first_line, string_agg(line_no || '| ' || line, chr(10) order by line_no) as body
  from {each_line('documents')} join (select doc_id, {VPATH} as path from documents) using (doc_id) join cand using (path) group by doc_id, path, score, (line_no - 1) // 5)"""
RANKED = f"""with {IDF_CTE}, {FIFTHS}, {score_cte('fifths', 'scored')},
best as (select *, score + found as total, row_number() over (partition by path order by score + found desc, first_line) = 1 as is_best from scored),
ranked as (select * from best order by is_best desc, total desc, path, first_line limit 24)"""
SQUEEZED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
FINDINGS = f"""
parts as (select doc_id, l, doc_id % len(l) as k, doc_id % 5 as variant from {lines_of('documents')} where len(l) > 0),
found as (select doc_id, l, k + 1 + case variant when 1 then 3 when 2 then 9 else 0 end as line, variant,
  case variant when 3 then 'never said ' || doc_id when 4 then '*' || l[k + 1] else l[k + 1] end as quote, {VADAPTER} as adapter from parts),
norms as (select *, list_transform(l, lambda s: {SQUEEZED.format('s')}) as plain, list_transform(l, lambda s: {SQUEEZED.format("translate(s, '*_`~', '')")}) as bare,
  {SQUEEZED.format('quote')} as q1, {SQUEEZED.format("translate(quote, '*_`~', '')")} as q2 from found),
places as (select *, strpos(list_aggregate(plain, 'string_agg', ' '), q1) as p1, strpos(list_aggregate(bare, 'string_agg', ' '), q2) as p2 from norms),
starts as (select doc_id, i, sum(coalesce(n1, 0) + 1) over (partition by doc_id order by i) - coalesce(n1, 0) as s1, sum(n2 + 1) over (partition by doc_id order by i) - n2 as s2
  from (select doc_id, generate_subscripts(plain, 1) as i, length(unnest(plain)) as n1, length(unnest(bare)) as n2 from norms)),
lines_at as (select p.doc_id, p.line, p.adapter, p.q1, count(*) filter (where p1 > 0 and s1 <= p1) as l1, count(*) filter (where p2 > 0 and s2 <= p2) as l2 from places p join starts s on p.doc_id = s.doc_id group by all),
verdicts as (select doc_id, line, case when q1 = '' then 'empty' when l1 > 0 and abs(l1 - line) <= 5 then 'exact'
  when adapter = 'markdown' and l2 > 0 and abs(l2 - line) <= 5 then 'markdown_normalized' when adapter = 'markdown' and l2 > 0 then 'line_mismatch:' || l2
  when l1 > 0 then 'line_mismatch:' || l1 else 'quote_not_in_file' end as verdict from lines_at)"""
SYMBOL = r"^\s*(?:pub\s+)?(?:async\s+)?(?:fn|def|class|struct|enum|trait|impl|function|const)\s+([A-Za-z_][A-Za-z0-9_]*)"
IMPORT = r"^\s*(?:use\s+[^;]+;|mod\s+\w+;|import\s+.+|from\s+\S+\s+import\s+.+|#include\s+.+)"
HARMLESS = r"regexp_full_match(token, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}') or regexp_full_match(token, '[0-9a-fA-F]{40}')"
TOKENS = "greatest(1, length({0}) // 4)"
FENCED = r"regexp_replace(trim(regexp_replace(trim(raw), '^```[a-zA-Z]*\n?', '')), '\n?```$', '')"
COUNTER = " or ".join(f"contains(low_fact, '{c.replace(chr(39), chr(39) * 2)}')" for c in fixed.COUNTER)
RESTRICT = "(contains(lower({0}), 'limited to') or contains(lower({0}), 'no more than') or list_has_any({1}, ['only', 'solely', 'merely', 'exclusively', 'just']))"

# Texts of an older snapshot: longer, of the same length but other letters, or the same at another time.
THEN = "case doc_id % 15 when 1 then text || 'x' when 3 then translate(text, 'e', 'x') else text end"

ORACLES = {
    "terms": f"select doc_id, cast(len(t) as bigint) as n_terms, coalesce(list_aggregate(list_sort(t), 'string_agg', ' '), '') as sorted_terms from (select doc_id, {terms('text')} as t from documents)",
    "lines": f"select doc_id, line_no, line from {each_line('documents')}",
    "token_estimate": "select doc_id, greatest(1, length(text) // 4) as tokens from documents",
    "content_hash": "select doc_id, sha256(text) as hash from documents",
    "adapter_mix": f"select {VADAPTER} as adapter, count(*) as n from documents group by 1",
    "sensitive_paths": f"""
with p as (select path from {v.PATHS} union select regexp_replace(url, '^[a-z]+://', '') from pages),
s as (select path, string_split(lower(path), '/') as parts from p), n as (select *, parts[len(parts)] as name, parts[:len(parts) - 1] as above from s)
select path, list_has_any(parts, ['.ssh', '.aws', '.kube', '.docker', '.gnupg', '.azure']) or contains('/' || lower(path) || '/', '/.config/gcloud/')
  or len(list_filter(above, lambda x: starts_with(x, '.env'))) > 0 or starts_with(name, '.env') or ends_with(name, '.env')
  or name in ('.netrc', '.npmrc', '.pypirc', '.pgpass', '.htpasswd') or (regexp_matches(name, '^(id_rsa|id_ed25519|id_ecdsa|id_dsa)') and not ends_with(name, '.pub'))
  or contains(name, 'credentials') or regexp_matches(name, '\\.(pem|key|p12|crt|cer|pfx|jks|keystore|ppk|asc|gpg)$') as sensitive from n""",
    "walk_filter": f"select path, case {REASON} end as skip_reason from {MAPPED} where doc_id % 11 <> 2",
    "coverage_counts": f"with r as (select path, adapter, case when adapter <> 'markdown' then 'unsupported_markdown_gate' {REASON} end as reason from {MAPPED}) select adapter, count(*) as n from r where reason like 'unsupported%' or reason = 'binary_or_unsupported' group by adapter",
    "outline": f"select doc_id, line_no as line, cast(2 as bigint) as level, trim(substr(line, 4)) as text from {HEADED} where starts_with(line, '## ')",
    "symbols": rf"""
with c as {each_line(ALL('CODE'), 'path')}
select path, regexp_extract(line, '{SYMBOL}', 1) as name, regexp_extract(line, '^\s*(\S+)', 1) as kind, line_no as line from c where path not like '%.md' and regexp_matches(line, '{SYMBOL}') qualify row_number() over (partition by path order by line_no) <= 200
union all select path, trim(regexp_extract(line, '^\s*#{{1,6}} (.*)$', 1)), 'heading', line_no from c where path like '%.md' and regexp_matches(line, '^\s*#{{1,6}} ') qualify row_number() over (partition by path order by line_no) <= 200""",
    "imports": f"select path, left(trim(line), 240) as \"import\" from {each_line(ALL('CODE'), 'path')} where regexp_matches(line, '{IMPORT}') qualify row_number() over (partition by path order by line_no) <= 200",
    "defined_terms": r"select doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '(?m)^\s*(?:\*\*)?([A-Z][A-Za-z0-9 _/-]{2,40})(?:\*\*)?\s*[:—-]', 1), lambda x: trim(x)))) as term from documents",
    "roles": f"""
select {VPATH} as path, case when doc_id % 10 in (2, 3, 4) or h is null then case when doc_id % 10 in (2, 3, 4) and h is not null then left(h, 120) else ({VADAPTER}) || ' file' end else left(h, 120) end as role
from documents left join (select doc_id, trim(substr(line, 4)) as h from {HEADED} where line_no = 5) using (doc_id)""",
    "entropy_tokens": f"""
with t as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{{32,}}')) as token from documents union all select doc_id, token from {v.RUNS})
select doc_id, token, not ({HARMLESS}) and length(token) >= 32 and length(token) - length(replace(token, '/', '')) < 2
  and (len(list_distinct(string_split(regexp_replace(token, '=+$', ''), ''))) > 20 or (regexp_matches(token, '[a-z]') and regexp_matches(token, '[A-Z]') and regexp_matches(token, '[0-9]'))) as is_secret from t""",
    "email_counts": f"select doc_id, cast(len(regexp_extract_all(text, '{EMAIL}')) as bigint) as emails from documents",
    "redact": f"select doc_id, cast(len(regexp_extract_all(text, '{EMAIL}')) as bigint) as n_redactions from documents",
    "parse_jsonish": rf"""
with s as (select id, replace(case when trim(raw) like '```%' then {FENCED} else trim(raw) end, chr(1), '') as j from {ALL('ANSWERS')}),
e as (select id, unnest(cast(json_extract(j, '$[*]') as json[])) as f from s)
select id, json_extract_string(f, '$.fact') as fact, cast(json_extract_string(f, '$.line') as bigint) as line from e where json_extract_string(f, '$.fact') is not null and json_extract_string(f, '$.line') is not null""",
    "typo_hint": f"""
with c as (select * from (values {', '.join(f"({i}, '{c}')" for i, c in enumerate(fixed.COMMANDS))}) as c(i, cmd))
select token, (select cmd from c where levenshtein(token, cmd) = 1 and not regexp_matches(token, '\\s') order by i limit 1) as hint from (select distinct token from {ALL('TOKENS')})""",
    "churn": "select user_id, count(*) as churn from events where ts >= (select max(ts) from events) - interval 14 days group by user_id",
    "reuse_join": f"with {SNAPSHOTS} select n.doc_id, o.path is not null as reused, o.role from now_ n left join old_ o on n.path = o.path and n.hash = o.hash",
    "work_set": f"with {SNAPSHOTS} select n.doc_id from now_ n where not exists (select 1 from old_ o where o.path = n.path and o.hash = n.hash)",
    "staleness_diff": f"with {SNAPSHOTS} select case when o.path is null then 'added' when n.path is null then 'removed' when n.hash = o.hash then 'unchanged' else 'changed' end as change_kind, count(*) as n from now_ n full join old_ o on n.path = o.path group by 1",
    "idf_candidates": f"with {IDF_CTE} select path, score from cand",
    "candidate_union": f"""
with {IDF_CTE}, u as (select path, case when router_rank = 0 then 999 else router_rank end as r, 0.0 as s, look_for as h from {v.ROUTER} union all select path, null, score, null from cand),
g as (select path, min(r) as router_rank, max(s) as score, min(nullif(h, '')) as look_for from u group by path)
select path, cast(router_rank as bigint) as router_rank, cast(score as double) as score, look_for, row_number() over (order by router_rank nulls last, score desc, path) as ord from g""",
    "chunks_fixed": f"select doc_id, first_line, n_lines, sha256(body) as body_hash from {TENTHS}",
    "chunks_boundary": f"""
with n as (select doc_id, max(line_no) as n from {HEADED} group by doc_id),
s as (select doc_id, 0 as a from n union select doc_id, line_no - 1 from {HEADED} where starts_with(line, '## ') and line_no > 1 and doc_id % 10 not in (2, 3, 4)),
p as (select doc_id, a, n, lead(a, 1, n) over (partition by doc_id order by a) as b from s join n using (doc_id))
select doc_id, a + 1 as first_line, least(least(b, a + 10) + 2, n) as last_line from p where b > a""",
    "chunk_score": f"with q as (select unnest({terms(QUESTION)}) as term), t as (select * from {TENTHS}), {score_cte('t', 's')} select doc_id, first_line, cast(found as double) as score from s",
    "rank_chunks": f"{RANKED} select doc_id, first_line, round(total, 6) as score from ranked",
    "lexical_topk": rf"""
with q as (select unnest({terms(QUESTION)}) as term), t as (select t.*, {VPATH} as path from {TENTHS} t join documents using (doc_id)),
h as (select doc_id, path, first_line, term, len(regexp_extract_all(lower(body), '(?:^|[^\p{{L}}\p{{N}}_])' || term)) as n from t, q),
s as (select doc_id, path, first_line, count(*) filter (where n > 0) as distinct_hits, cast(sum(n) as bigint) as total_hits from h group by all)
select doc_id, first_line, distinct_hits, total_hits from s where distinct_hits > 0 order by distinct_hits desc, total_hits desc, path, first_line limit 12""",
    "quote_verify": f"with {FINDINGS} select doc_id, line, verdict from verdicts",
    "drop_counts": f"with {FINDINGS} select verdict as reason, count(*) as n from verdicts where verdict not in ('exact', 'markdown_normalized') group by 1",
    "exact_claim": rf"""
with c as (select id, quote, trim(regexp_replace(trim(query), '[?.!]+$', '')) as bare from {ALL('CLAIMS')}),
n as (select *, list_filter({terms(f'substr(bare, {len(fixed.CLAIM_PREFIX) + 1})')}, lambda t: t not in ({', '.join(f"'{w}'" for w in fixed.CLAIM_WORDS)})) as need, starts_with(lower(bare), '{fixed.CLAIM_PREFIX}') as asks from c)
select id, not (asks and len(need) >= 3) or len(list_filter(need, lambda t: not list_contains({terms('quote')}, t))) = 0 as kept from n""",
    "finding_order": f"""select query_id, row_number() over (partition by query_id order by router_rank nulls last, score desc, path, line, quote) as ord, path as file, cast(line as bigint) as line
from (select distinct query_id, path, line, quote, router_rank, score from {ALL('FINDINGS')})""",
    "weak_signal": f"with {IDF_CTE} select (select count(*) from {v.FINDINGS}) > 0 and (select max(cast(score as double)) from {v.FINDINGS}) < coalesce((select max(score) from cand), 0) * 0.4 as weak",
    "query_state": f"""
with r as (select *, case when reasons = '' then []::varchar[] else string_split(reasons, ';') end as rs from {ALL('RUNS')}),
c as (select *, len(list_filter(rs, lambda x: starts_with(x, 'provider_error'))) as p, len(list_filter(rs, lambda x: starts_with(x, 'budget_hit'))) as b from r),
s as (select run_id, case when budget_hit then 'budget_hit' when chunks > 0 and findings = 0 and len(rs) > 0 and p = len(rs) then 'provider_error' when p + b > 0 then 'partial' when findings = 0 then 'unanswered' else 'ok' end as state from c)
select run_id, state, cast(case state {' '.join(f"when '{k}' then {n}" for k, n in fixed.STATES.items())} else 1 end as bigint) as exit_code from s""",
    "budget_admission": f"{RANKED} select doc_id, first_line, round(sum({TOKENS.format('body')} / 1e6 * 2.15 + 0.006) over (order by path, first_line), 9) <= 0.08 as admitted from ranked",
    "budget_pack": f"""
with recursive t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as i, {TOKENS.format('text')} as f, {TOKENS.format('left(text, 40)')} as r from conversations),
w as (select conv_id, cast(0 as bigint) as i, cast(200 as bigint) as used, cast(null as bigint) as turn, false as omitted from (select distinct conv_id from t)
  union all select t.conv_id, t.i, case when w.used + f <= 300 then w.used + f else w.used + r end, t.turn, w.used + f > 300 from w join t on t.conv_id = w.conv_id and t.i = w.i + 1)
select conv_id, turn, omitted from w where i > 0""",
    "index_cost": "select count(*) as n, round(sum(greatest(1, length(left(text, 16000)) // 4) + 700) / 1e6 * 2.15 + count(*) * 0.001, 6) as usd from documents",
    "chunk_cost": f"select count(*) as n, round(sum({TOKENS.format('body')} + 700) / 1e6 * 2.15 + count(*) * 0.006, 6) as usd from {TENTHS}",
    "spend_rollup": "select role, cast(sum(greatest(1, length(text) // 4)) as bigint) as in_tok, cast(sum(turn) as bigint) as out_tok, count(*) as calls, round(sum(greatest(1, length(text) // 4)) / 1e6 * 2.15 + sum(turn) / 1e6 * 2.70, 6) as usd from conversations group by role",
    "module_map": rf"""
with l as (select doc_id, line, {VADAPTER} as adapter from {each_line('documents')} join documents using (doc_id)),
n as (select doc_id, count(*) as loc, least(8, count(*) filter (where case when adapter = 'code' then regexp_matches(line, '{SYMBOL}') else regexp_matches(line, '^\s*#{{1,6}} ') end)) as symbols from l group by doc_id)
select source || '/' || lang as dir, count(*) as n_files, string_agg({VPATH}, ',' order by {VPATH}) as paths, cast(sum(coalesce(loc, 0)) as bigint) as loc, cast(sum(coalesce(symbols, 0)) as bigint) as n_symbols
from documents left join n using (doc_id) group by 1""",
    "entry_points": f"""
with i as (select doc_id, least(200, count(*)) as n from {each_line('documents')} where regexp_matches(line, '{IMPORT}') group by doc_id),
s as (select {VPATH} as path, coalesce(n, 0) + doc_id % 17 as score from documents left join i using (doc_id))
select row_number() over (order by score desc, path) as ord, path, score from s order by score desc, path limit 20""",
    "retention": f"""
with g as (select *, coalesce(try_cast(regexp_extract(name, '^gen-(\\d+)$', 1) as bigint), 0) as stamp from {ALL('GENERATIONS')})
select store, name, name = current or row_number() over (partition by store order by name = current, stamp desc, name desc) <= 2 as keep from g""",
    "eval_recall": f"""
with c as (select distinct query_id, file, 1 as hit from {ALL('EVAL_FINDINGS')}), g as (select distinct query_id, file from {ALL('GOLDENS')})
select query_id, cast(coalesce(sum(hit), 0) as bigint) as found, count(*) as total from g left join c using (query_id, file) group by query_id""",
    "eval_coverage": f"""
with g as (select *, {terms('fact')} as want from {ALL('GOLDENS')}), f as (select *, {terms('fact')} as has from {ALL('EVAL_FINDINGS')})
select query_id, id, exists (select 1 from f where f.query_id = g.query_id and f.file = g.file and (abs(f.line - g.line) <= 5 or (len(want) > 0 and len(list_intersect(want, has)) / len(want) > 0.5))) as covered from g""",
    "eval_poison": rf"""
with p as (select *, {terms('poison')} as want, {terms('query')} as asked,
  list_distinct(list_transform(list_filter(regexp_extract_all(poison, '\b[A-Z][A-Za-z0-9_-]*\b'), lambda w: w not in ({', '.join(f"'{w}'" for w in fixed.GENERIC)})), lambda w: {stem('lower(w)')})) as need from {ALL('POISON')}),
o as (select *, list_filter(want, lambda t: not list_contains(asked, t) and not list_contains(need, t) and t not in ({', '.join(f"'{w}'" for w in fixed.POISON_WORDS)})) as own from p),
f as (select query_id, fact, lower(fact) as low_fact, {terms('fact')} as has from {ALL('EVAL_FINDINGS')}),
j as (select o.query_id, o.id, coalesce(len(want) > 0 and not (({COUNTER}) and not contains(lower(poison), 'not')) and len(list_filter(need, lambda t: not list_contains(has, t))) = 0
  and (not {RESTRICT.format('poison', 'want')} or {RESTRICT.format('fact', 'has')}) and (len(own) = 0 or len(list_intersect(own, has)) >= least(len(own), 2)) and len(list_intersect(want, has)) / len(want) > 0.6, false) as hit
  from o left join f on f.query_id = o.query_id)
select query_id, id, bool_or(hit) as survives from j group by query_id, id""",
    "eval_gates": f"""
with t as (select case when sum(recall_total) = 0 then 100.0 else sum(recall_found) / sum(recall_total) * 100.0 end as recall_pct, case when sum(facts) = 0 then 100.0 else sum(covered) / sum(facts) * 100.0 end as coverage_pct,
  cast(sum(poison) as bigint) as poison, bool_and(not negative or findings = 0) as negatives_clean, round(sum(usd) / count(*), 6) as avg_usd, bool_and(complete) as complete from {ALL('TOTALS')})
select round(recall_pct, 6) as recall_pct, round(coverage_pct, 6) as coverage_pct, poison, negatives_clean, avg_usd, complete,
  recall_pct >= 100 and coverage_pct >= 71.4 and poison = 0 and negatives_clean and avg_usd < 0.15 and complete as green from t""",
    "indexed_candidates": f"with {IDF_CTE} select path, score from cand",
    "postings_after_changes": f"select term, count(*) as df from (select doc_id, unnest({terms('text')}) as term from documents) group by term",
    "staleness_sights": f"""
with o as (select cast(doc_id as varchar) as path, sha256({THEN}) as hash from documents where doc_id % 10 <> 9 union all select 'gone ' || doc_id, sha256(text) from documents where doc_id % 50 = 8),
n as (select cast(doc_id as varchar) as path, sha256(text) as hash from documents)
select coalesce(n.path, o.path) as path, case when o.path is null then 'added' when n.path is null then 'removed' when n.hash = o.hash then 'unchanged' else 'changed' end as change from n full join o on n.path = o.path""",
    "redacted_text": rf"""
with p as (select doc_id, regexp_replace(text, '/(?:Users|home)/[A-Za-z0-9._-]+/', '~/', 'g') as t from documents),
h as (select doc_id, regexp_extract_all(t, '{EMAIL}') as hits, string_split_regex(t, '{EMAIL}') as parts from p),
r as (select doc_id, list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce('[REDACTED_EMAIL_' || len(list_distinct(hits[1 : list_position(hits, hits[i])])) || ']', '')) as out from h)
select doc_id, sha256(array_to_string(out, '')) as text_hash from r""",
}
