"""Inputs of queries whose operators no table feeds as it is: small cases inline, and rows that
a rule makes of every row of ``documents``.  The same text runs in Spark and in the oracle's SQL."""

#: Stands for the table in a rule's text.
DOCUMENTS = "@documents"


def table(name: str, columns: str, *rows: str) -> str:
    return f"(VALUES {', '.join(f'({r})' for r in rows)}) AS {name}({columns})"


def text(*lines: str) -> str:
    """A string of several lines without escapes."""
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in lines)


PATHS = table("paths", "path", *[f"'{p}'" for p in (
    "src/walk.rs", ".env", "app/.env.local", "prod.env", ".env.d/settings.md", "home/.ssh/config", ".aws/credentials", "a/.kube/x", ".docker/config.json",
    ".gnupg/ring", ".azure/a", ".config/gcloud/token", "x/.config/other", "deploy/id_rsa", "deploy/id_rsa.pub", "id_ed25519_backup", "keys/server.PEM",
    "certs/site.crt", "a.cer", "b.pfx", "c.jks", "d.keystore", "e.ppk", "f.asc", "g.gpg", ".netrc", "pkg/.npmrc", ".pypirc", ".pgpass", ".htpasswd",
    "my_credentials.txt", "docs/keyboard.md", "environment.md", "tokens/readme.md")])

CODE = table("code", "path, text",
    "'lib/a.rs', " + text("use std::io;", "pub fn open(path: Path) {", "    let x = 1;", "}", "struct Card {", "mod inner;", "pub async fn load() {", "enum Kind {"),
    "'lib/b.py', " + text("import os", "from pathlib import Path", "class Walker:", "    def walk(self):", "        return 1", "async def later():", "x = 'class no'"),
    "'lib/c.js', " + text("import x from 'y'", "function go() {", "const LIMIT = 3", "trait T", "impl Go"),
    "'lib/d.c', " + text("#include <stdio.h>", "int main() {"),
    "'notes.md', " + text("# Title", "text", "## Part one", "####### seven", "#none", "  ### Indented  "))

RUNS = table("runs", "doc_id, token",
    "-1, 'abcdefghijklmnopqrstuvwxyz0123456789'", "-2, 'aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa'", "-3, 'aaaaaaaaaaaaaaaaAAAAAAAAAAAAAAAA1111'",
    "-4, '0123456789abcdef0123456789abcdef01234567'", "-5, 'usr/local/share/aAbBcCdDeEfFgGhHiIjJ1'", "-6, 'abcdefghijklmnopqrstuvwxyz012345===='")

ANSWERS = table("answers", "id, raw",
    """1, '[{"fact":"a","line":1,"quote":"q"},{"fact":"b","line":2}]'""",
    "2, " + text("```json", '[{"fact":"c","line":3,"quote":"q"}]', "```"),
    """3, '  [{"fact":"d"},{"line":5},{"fact":"e","line":6}] '""", "4, '[]'",
    """5, '[{"fact":"f' || chr(1) || 'g","line":7}]'""")

TOKENS = table("tokens", "token", *[f"'{t}'" for t in ("indx", "index", "brif", "breif", "schem", "helpp", "doctr", "evals", "capabilites", "where is it", "eva", "zzz")])

ROUTER = table("router", "path, router_rank, look_for",
    "'src3/en/doc_00000003.rs', 1, 'license text'", "'src7/en/doc_00000007.md', 0, ''", "'none/such.md', 2, 'a'", "'src9/en/doc_00000009.md', 2, 'b'")

CLAIMS = table("claims", "id, query, quote",
    "1, 'Where does the corpus say that caches expire hourly?', 'The caches expire hourly by default'",
    "2, 'Where does the corpus say that caches expire hourly?', 'The caches expire daily'",
    "3, 'Where does the corpus say caches expire?', 'nothing of it'", "4, 'How do caches expire', 'nothing of it'",
    "5, 'where does the corpus say who describes walking and cards!', 'walks describe card'", "6, 'Where does the corpus say that indexes includes retries twice.', 'indexes retry twice'")

FINDINGS = table("findings", "path, line, quote, router_rank, score",
    "'b.md', 4, 'x', 2, 0.5", "'b.md', 4, 'x', 2, 0.5", "'a.md', 9, 'y', 1, 0.1", "'a.md', 2, 'z', 1, 0.1", "'c.md', 1, 'w', NULL, 0.2", "'d.md', 1, 'v', NULL, 0.02", "'e.md', 7, 'u', 2, 0.3")

RUNS_DONE = table("runs_done", "run_id, budget_hit, chunks, findings, reasons",
    "1, true, 3, 1, ''", "2, false, 2, 0, 'provider_error: a;provider_error: b'", "3, false, 2, 0, 'provider_error: a;empty'", "4, false, 2, 2, 'budget_hit_before_chunk'",
    "5, false, 2, 0, 'quote_not_in_file'", "6, false, 2, 3, 'line_mismatch:4;unparseable: x'", "7, false, 0, 0, ''", "8, false, 0, 0, 'provider_error: a'")

GENERATIONS = table("generations", "name", *[f"'{n}'" for n in ("gen-100", "gen-200", "gen-300", "gen-400", "gen-500", "gen-x", "gen-50")])

GOLDENS = table("goldens", "query_id, id, file, line, fact",
    "'q1', 'm1', 'a.md', 10, 'The index keeps two old generations'", "'q1', 'm2', 'a.md', 90, 'Stale locks expire after fifteen minutes'", "'q1', 'm3', 'b.md', 5, 'Router failures leave deterministic candidates'",
    "'q2', 'm4', 'c.md', 7, 'Quotes are checked mechanically'", "'q2', 'm5', 'd.md', 1, 'of the and'")

EVAL_FINDINGS = table("eval_findings", "query_id, file, line, fact",
    "'q1', 'a.md', 14, 'Something else'", "'q1', 'a.md', 200, 'Locks go stale and expire after some minutes'", "'q1', 'b.md', 50, 'Router answers are ranked'", "'q2', 'c.md', 1, 'Quotes may be checked'",
    "'q3', 'e.md', 3, 'Cards never call the model'", "'q3', 'e.md', 4, 'Only Redis stores cards and sessions'", "'q3', 'e.md', 9, 'Kafka streams cards into the queue'")

POISON = table("poison", "query_id, id, query, poison",
    "'q3', 'p1', 'where are cards stored', 'Cards call the model'", "'q3', 'p2', 'where are cards stored', 'Redis stores cards and sessions'", "'q3', 'p3', 'where are cards stored', 'Only Redis stores cards'",
    "'q3', 'p4', 'where are cards stored', 'Kafka streams only cards into a queue'", "'q3', 'p5', 'where are cards stored', 'Postgres stores cards and sessions'", "'q1', 'p6', 'locks', 'Locks expire after an hour'", "'q4', 'p7', 'x', 'Nothing here is said'")

RUN_TOTALS = table("run_totals", "recall_found, recall_total, covered, facts, poison, negative, findings, usd, complete",
    "3, 3, 4, 5, 0, false, 6, cast(0.08 as double), true", "2, 2, 2, 3, 0, false, 2, cast(0.11 as double), true", "0, 0, 0, 0, 0, true, 0, cast(0.07 as double), true")


def with_rows(inline: str, columns: str, rule: str) -> str:
    """The inline cases and what the rule makes of ``documents``."""
    return f"(SELECT {columns} FROM {inline} UNION ALL SELECT {columns} FROM (SELECT {rule} FROM {DOCUMENTS}) AS made) AS given"


def part(n: int) -> str:
    """Number of the run of ``n`` ids that a row belongs to."""
    return f"cast((doc_id - doc_id % {n}) / {n} as bigint)"


# Sentences become definitions, what follows a comma an import; prose gets headings.
ALL_CODE = with_rows(CODE, "path, text", """'c' || doc_id || case doc_id % 3 when 0 then '.rs' when 1 then '.py' else '.md' end as path,
  case doc_id % 3 when 2 then replace(text, '. ', chr(10) || '## ') else 'use std::' || lang || ';' || chr(10) || replace(replace(text, '. ', chr(10) || 'def '), ', ', chr(10) || 'import ') end as text""")
JSON = """'[{"fact":"' || source || ' ' || doc_id || '","line":' || (doc_id % 40) || ',"quote":"q"},{"fact":"' || lang || '"}]'"""
ALL_ANSWERS = with_rows(ANSWERS, "id, raw", f"doc_id + 100 as id, case doc_id % 3 when 0 then {JSON} when 1 then '```json' || chr(10) || {JSON} || chr(10) || '```' else '  ' || {JSON} || ' ' end as raw")
NAMED = "case doc_id % 7 when 0 then 'index' when 1 then 'brief' when 2 then 'capabilities' when 3 then 'schema' when 4 then 'doctor' when 5 then 'eval' else 'help' end"
AT = "cast(doc_id % 5 as int)"
ALL_TOKENS = with_rows(TOKENS, "token", f"""case doc_id % 4 when 0 then substr({NAMED}, 1, {AT}) || substr({NAMED}, {AT} + 2) when 1 then substr({NAMED}, 1, {AT}) || 'q' || substr({NAMED}, {AT} + 1)
  when 2 then substr({NAMED}, 1, {AT}) || lang || substr({NAMED}, {AT} + 2) else {NAMED} || case when doc_id % 8 = 3 then ' ' else '' end end as token""")
ALL_CLAIMS = with_rows(CLAIMS, "id, query, quote", "doc_id + 100 as id, 'Where does the corpus say ' || left(text, 60) || '?' as query, case doc_id % 3 when 0 then left(text, 90) when 1 then left(text, 25) else source end as quote")
TOLD = f"""{part(40)} as query_id, 'f' || (doc_id % 7) || '.md' as path, doc_id % 9 as line, 'q' || doc_id as quote,
  case when doc_id % 5 = 0 then null else doc_id % 7 end as router_rank, cast((doc_id % 11) / 10.0 as double) as score"""
ALL_FINDINGS = f"""(SELECT -1 as query_id, path, line, quote, router_rank, cast(score as double) as score FROM {FINDINGS} UNION ALL SELECT {TOLD} FROM {DOCUMENTS}
  UNION ALL SELECT {TOLD} FROM {DOCUMENTS} WHERE doc_id % 10 = 0) AS given"""
ALL_RUNS = with_rows(RUNS_DONE, "run_id, budget_hit, chunks, findings, reasons", """doc_id + 100 as run_id, doc_id % 13 = 0 as budget_hit, doc_id % 4 as chunks, doc_id % 3 as findings,
  case doc_id % 6 when 0 then '' when 1 then 'provider_error: a;provider_error: b' when 2 then 'provider_error: a;empty' when 3 then 'budget_hit_before_chunk' when 4 then 'quote_not_in_file;line_mismatch:4' else 'unparseable: x' end as reasons""")
ALL_GENERATIONS = f"""(SELECT -1 as store, name, 'gen-300' as current FROM {GENERATIONS} UNION ALL
  SELECT {part(25)} as store, 'gen-' || case when doc_id % 10 = 9 then 'x' else '' end || (doc_id * 37 % 1000) as name, 'gen-' || ((doc_id - doc_id % 25 + 3) * 37 % 1000) as current FROM {DOCUMENTS}) AS given"""
ASKED = f"'d' || {part(20)} as query_id"
ALL_GOLDENS = with_rows(GOLDENS, "query_id, id, file, line, fact", f"{ASKED}, 'm' || doc_id as id, 'f' || (doc_id % 5) || '.md' as file, doc_id % 30 as line, left(text, 70) as fact")
# The oracle's word borders know ASCII alone.
PLAIN = "translate(text, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöüàáúÀÁÚ', 'ACEEEINOOUsaceeeinoouaauAAU')"
ALL_EVAL_FINDINGS = f"""(SELECT query_id, file, line, fact FROM {EVAL_FINDINGS} UNION ALL
  SELECT {ASKED}, 'f' || (doc_id % 5) || '.md' as file, doc_id * 7 % 30 as line, left({PLAIN}, 45) as fact FROM {DOCUMENTS} WHERE doc_id % 4 <> 1) AS found"""
ALL_POISON = with_rows(POISON, "query_id, id, query, poison", f"""{ASKED}, 'p' || doc_id as id, source as query,
  case doc_id % 3 when 0 then left({PLAIN}, 60) when 1 then 'Only ' || left({PLAIN}, 60) else 'Redis says ' || left({PLAIN}, 40) end as poison""")
ALL_TOTALS = with_rows(RUN_TOTALS, "recall_found, recall_total, covered, facts, poison, negative, findings, usd, complete", """2 + doc_id % 2 as recall_found, 3 as recall_total, doc_id % 5 as covered, 5 as facts,
  case when doc_id % 50 = 7 then 1 else 0 end as poison, doc_id % 4 = 0 as negative, doc_id % 3 as findings, cast((doc_id % 10) / 100.0 as double) as usd, doc_id % 97 <> 5 as complete""")
