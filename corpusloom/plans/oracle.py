"""The same queries as SQL for DuckDB, from the same fixed values: no code is shared with the operators.

Regular expressions there know no lookahead and ASCII classes only, so classes are spelled out, and what must not follow the
last match is looked for in the rest of the line.
"""

from __future__ import annotations

import re

from corpusloom.functions import context as c
from corpusloom.functions.flows import CHAINS, DIRECT_USES, ROUNDS, SANITIZERS, SINKS, SOURCES
from corpusloom.functions.rules import RISK_LEVELS, SEVERITIES, built_in
from corpusloom.functions.text import DEEP_LANGUAGES, SCAN_LANGUAGES, TAINT_LANGUAGES
from corpusloom.operators.risk import COMBINATIONS, TAIL
from corpusloom.sources.corpus import SNIPPETS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def spelled(pattern: str) -> str:
    """With Unicode letters and digits for \\w."""
    inside, out, i = False, "", 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\w":
            out += r"\p{L}\p{N}_" if inside else r"[\p{L}\p{N}_]"
            i += 2
        elif two == r"\W":
            out += r"[^\p{L}\p{N}_]"
            i += 2
        elif two[0] == "\\":
            out += two
            i += 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out += two[0]
            i += 1
    return out


def has(text: str, pattern: str, ignore_case: bool = False) -> str:
    flag = "(?i)" if ignore_case else ""
    if m := re.fullmatch(r"(.*)\(\?!\.\*(.*)\)", pattern):
        head = m[1] if m[1].startswith(("(", r"\b")) else m[1]
        rest = f"regexp_extract({text}, {q(flag + '.*' + spelled(head) + '(.*)')}, 1)"
        return f"(regexp_matches({text}, {q(flag + spelled(head))}) AND NOT regexp_matches({rest}, {q(flag + spelled(m[2]))}))"
    return f"regexp_matches({text}, {q(flag + spelled(pattern))})"


def contains(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def starts(text: str, *heads: str) -> str:
    return "(" + " OR ".join(f"starts_with({text}, {q(h)})" for h in heads) + ")"


def case(*pairs: tuple[str, str | None], otherwise: str | None = None) -> str:
    value = lambda v: "NULL" if v is None else q(v)
    return "CASE " + " ".join(f"WHEN {k} THEN {value(v)}" for k, v in pairs) + f" ELSE {value(otherwise)} END"


LOW, STRIPPED = "lower(line)", strip("line")
RUN = f"regexp_extract(line, {q(spelled(c.LONG_RUN))})"
WORD = has("line", c.PASSWORD, True)
NOTES = {
    "POI-001": case((f"{contains(LOW, c.SAFE_HOSTS)} OR {has(LOW, c.API_PATH)}", None), otherwise="external request"),
    "POI-002": case((starts(STRIPPED, "#", "//"), None), (contains("line", c.DYNAMIC), "dynamic command"), (has("line", c.EVALUATES), "dynamic code"), otherwise="command"),
    "POI-003": case((" OR ".join(has("line", p, True) for p in c.SENSITIVE_PATHS), "sensitive path"), (f"{has('line', c.ENVIRONMENT)} AND NOT {has('line', c.ENVIRONMENT_ITEM)}", "whole environment")),
    "POI-004": case((f"{has('line', c.BASE64, True)} AND {has('line', c.EXECUTES)}", "base64 executed"), (f"{RUN} <> '' AND list_entropy(string_split({RUN}, '')) >= {c.LONG_RUN_ENTROPY}", "long high-entropy text"), (f"{has('line', c.HEX)} AND {has('line', c.EXECUTES)}", "hex executed")),
    "POI-005": case((has("line", c.PIP_URL), "package from a URL (pip)"), (has("line", c.NPM_URL), "package from a URL (npm)"), (has("line", c.PIPED), "download piped to an interpreter")),
    "POI-006": case((has("line", c.CRON), "cron"), (has("line", c.REGISTRY, True), "registry"), (has("line", c.SYSTEMD), "service"), (has("line", c.AUTOSTART), "autostart"), (f"{has('line', c.SUDO)} AND {has('line', c.RAISES)}", "privilege")),
    "SEC-001": case((f"{starts(STRIPPED, '#', '//', chr(34) * 3, chr(39) * 3)} OR {' OR '.join(f'ends_with(path, {q(e)})' for e in c.EXAMPLE_FILES)} OR {contains(f'lower({STRIPPED})', c.PLACEHOLDERS)}", None), otherwise="hard-coded credential"),
    "SEC-002": case((f"{has('line', c.SQL_VERB, True)} AND {contains('line', c.SQL_JOINED)}", "query from strings")),
    "SEC-003": case((f"NOT {has('line', c.SHELL_TRUE)}", None), (contains("line", c.SHELL_JOINED), "dynamic shell"), otherwise="shell"),
    "SEC-004": case((f"{has('line', c.MD5)} AND {WORD}", "md5 of a password"), (f"{has('line', c.SHA1)} AND {WORD}", "sha1 of a password"), otherwise="weak algorithm"),
    "SEC-005": case((f"{has('line', c.FILE_CALL)} AND ({has('line', c.PATH_INPUT)} OR contains(line, '+'))", "path from input")),
    "SEC-006": case((has("line", c.PICKLE), "pickle"), (has("line", c.YAML), "yaml"), (has("line", c.MARSHAL), "marshal"), (f"{has('line', c.JSON_PARSE)} AND {has('line', c.FOREIGN, True)}", "json of a user"), otherwise="unsafe loader"),
    "SEC-007": case((f"{has('line', c.DOM)} AND {has('line', c.DOM_INPUT)}", "user data in HTML"), (has("line", c.DOM), "unsafe HTML"), (f"{has('line', c.RETURNED_HTML)} AND (NOT contains(line, 'return') OR {has('line', c.REQUEST)} OR contains(string_split(line, 'return')[-1], '{{'))", "embedded in HTML")),
    "SEC-008": case((f"{has('line', c.PYTHON_RANDOM)} AND {contains(LOW, c.PYTHON_RANDOM_WORDS)}", "security from random"), (f"{has('line', c.JS_RANDOM)} AND {contains(LOW, c.JS_RANDOM_WORDS)}", "security from Math.random"), otherwise="not cryptographic"),
}

CLEAN = "replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
CODE = "snippets(k, extension, mark, code) AS (VALUES " + ", ".join(f"({i}, {q(e)}, {q(m)}, {q(s)})" for i, (e, m, s) in enumerate(SNIPPETS)) + f"""),
files AS (SELECT 'src/' || coalesce(doc_id::VARCHAR, 'null-' || md5(coalesce(text, ''))) || extension AS path, code || mark || ' ' || replace({CLEAN.format("coalesce(text, '')")}, chr(10), chr(10) || mark || ' ') AS content
          FROM documents JOIN snippets ON coalesce(doc_id, 0) % {len(SNIPPETS)} = k)"""
TEXT = f"""files AS (SELECT path, {CLEAN.format("content")} AS content FROM (
    SELECT 'documents/' || doc_id || '.txt' AS path, text AS content FROM documents
    UNION ALL SELECT 'conversations/' || conv_id || '-' || turn || '.txt', text FROM conversations
    UNION ALL SELECT 'pages/' || page_id || '.html', html FROM pages) WHERE content IS NOT NULL)"""
EXTENSION = r"regexp_extract(lower(path), '(\.[^./]*)$', 1)"


def _language(table: dict[str, list[str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {EXTENSION} IN ({', '.join(map(q, e))}) THEN {q(lang)}" for lang, e in table.items()) + f" ELSE {otherwise} END"


LANGUAGE, DEEP = _language(SCAN_LANGUAGES, "'unknown'"), _language(DEEP_LANGUAGES, "NULL")
LINES = f"""parts AS (SELECT path, {LANGUAGE} AS language, {DEEP} AS deep_language, string_split(content, chr(10)) AS p FROM files),
numbered AS (SELECT path, language, deep_language, p, unnest(range(1, len(p) + 1)) AS line_number FROM parts),
lines AS (SELECT path, language, deep_language, line_number::INTEGER AS line_number, p[line_number] || CASE WHEN line_number < len(p) THEN chr(10) ELSE '' END AS line
          FROM numbered WHERE line_number < len(p) OR p[line_number] <> '')"""


def _hits(rule) -> str:
    match = " OR ".join(has("line", p, True) for p in dict.fromkeys(rule.patterns))
    applies = "TRUE" if "all" in rule.languages else f"language IN ({', '.join(map(q, rule.languages))})"
    return f"SELECT {q(rule.id)} AS rule_id, {q(rule.severity)} AS severity, {q(rule.category)} AS category, path, line_number, substr({STRIPPED}, 1, 200) AS matched_line, {NOTES[rule.id]} AS context_note FROM lines WHERE {applies} AND ({match})"


RULES = built_in()


def findings(files: str = CODE, rules=RULES) -> str:
    return f"WITH {files}, {LINES}, findings AS (SELECT * FROM ({' UNION ALL '.join(map(_hits, rules))}) WHERE context_note IS NOT NULL)"


RANK = "CASE severity " + " ".join(f"WHEN {q(s)} THEN {n}" for n, s in enumerate(SEVERITIES)) + " END"
WEIGHT = "CASE severity " + " ".join(f"WHEN {q(s)} THEN {n}" for s, n in SEVERITIES.items()) + " ELSE 1 END"


def _has_rule(rule: str) -> str:
    return f"coalesce(bool_or(category = 'poisoning' AND rule_id = {q(rule)}), FALSE)"


FLAGS = [f"CASE WHEN {_has_rule(a)} AND {_has_rule(b)} THEN {q(name)} END" for name, a, b in COMBINATIONS]
FLAGS.append(f"CASE WHEN count(*) FILTER (WHERE severity IN ('critical', 'high') AND n_lines > 0 AND line_number >= greatest(1, n_lines - n_lines // 4)) >= 2 THEN {q(TAIL)} END")
RISK = f"""{findings()}, counts AS (SELECT path, count(*) AS n_lines FROM lines GROUP BY path),
risk AS (SELECT path, sum({WEIGHT})::BIGINT AS total_score, coalesce(sum({WEIGHT}) FILTER (WHERE category = 'poisoning'), 0)::BIGINT AS poisoning_score,
                coalesce(sum({WEIGHT}) FILTER (WHERE category <> 'poisoning'), 0)::BIGINT AS security_score, count(*) AS findings_count,
                list_filter([{', '.join(FLAGS)}], lambda x: x IS NOT NULL) AS flags
         FROM findings LEFT JOIN counts USING (path) GROUP BY path)"""
LEVEL = "CASE " + " ".join(f"WHEN poisoning_score + security_score >= {n} THEN {q(name)}" for n, name in reversed(RISK_LEVELS)) + " END"
PROJECT = f"""{RISK}, total AS (SELECT coalesce(sum(poisoning_score), 0)::BIGINT AS poisoning_score, coalesce(sum(security_score), 0)::BIGINT AS security_score,
{', '.join(f"count(*) FILTER (WHERE list_contains(flags, {q(n)})) AS {n.replace(' ', '_')}" for n in [*(x[0] for x in COMBINATIONS), TAIL])} FROM risk)
SELECT poisoning_score + security_score AS overall_score, {LEVEL} AS risk_level, * FROM total"""

PLAIN = "SELECT rule_id, severity, category, path, line_number, matched_line, context_note FROM findings"
TAINT_LANGUAGE = "CASE deep_language " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in TAINT_LANGUAGES.items()) + " ELSE 'python' END"


def _dimension(name: str, table: dict[str, list[tuple[str, str]]]) -> str:
    return f"{name}(lang, pattern, kind) AS (VALUES " + ", ".join(f"({q(lang)}, {q(p)}, {q(k)})" for lang, rows in table.items() for p, k in rows) + ")"


LEFT = strip("split_part(s, '=', 1)")
UNDECLARED = f"CASE WHEN regexp_matches({LEFT}, '^(const|let|var) ') THEN {strip(f'regexp_replace({LEFT}, {q("^(const|let|var) ")}, {q("")})')} ELSE {LEFT} END"
FIRST = strip(f"split_part({strip(f'split_part({UNDECLARED}, {q(",")}, 1)')}, ':', 1)")
ROUND = """t{n} AS (SELECT path, name FROM t{m} UNION SELECT s.path, s.var FROM steps s JOIN t{m} t ON s.path = t.path AND list_contains(s.words, t.name))"""
FLOWS = f"""WITH {CODE}, {LINES}, {_dimension('sources', SOURCES)}, {_dimension('sinks', SINKS)},
code AS (SELECT path, line_number, rtrim(line, chr(10)) AS text, {TAINT_LANGUAGE} AS lang, {STRIPPED} AS s FROM lines WHERE deep_language IS NOT NULL),
named AS (SELECT *, CASE WHEN contains(s, '=') AND NOT regexp_matches(s, '^(if|for|while)') AND regexp_matches({FIRST}, {q(spelled('^[_' + chr(92) + 'p{L}]' + chr(92) + 'w*$'))}) THEN {FIRST} END AS var
          FROM code WHERE NOT {starts('s', '#', chr(34) * 3)}),
pending AS (SELECT path, var, kind, line_number AS line FROM named JOIN sources USING (lang) WHERE var IS NOT NULL AND contains(text, pattern)),
steps AS (SELECT path, var, regexp_split_to_array(substr(text, instr(text, '=') + 1), {q('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')}) AS words FROM named WHERE var IS NOT NULL),
t0 AS (SELECT DISTINCT path, var AS name FROM pending),
{', '.join(ROUND.format(n=n, m=n - 1) for n in range(1, ROUNDS + 1))},
hot AS (SELECT n.path, n.line_number AS line, k.kind FROM named n JOIN sinks k USING (lang) WHERE contains(text, pattern) AND ({contains('text', DIRECT_USES)}
        OR EXISTS (SELECT 1 FROM t{ROUNDS} t WHERE t.path = n.path AND list_contains(regexp_split_to_array(n.text, {q('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')}), t.name)))),
safe AS (SELECT path, line_number AS line FROM code WHERE {contains('lower(text)', SANITIZERS)}),
paths AS (SELECT p.path, p.var AS source_var, p.kind AS source_kind, p.line AS source_line, h.kind AS sink_name, h.kind AS sink_kind, h.line AS sink_line,
          CASE WHEN EXISTS (SELECT 1 FROM safe WHERE safe.path = p.path AND safe.line > p.line AND safe.line < h.line) THEN 0.3::DOUBLE ELSE 0.85::DOUBLE END AS confidence
          FROM pending p JOIN hot h USING (path))"""


def _chain(n: int) -> str:
    name, severity, kinds, source_words, words, sink_kinds, sink_words = CHAINS[n]
    some = lambda column, ws: [contains(column, [w.lower() for w in ws])] if ws else []
    tests = [f"sink_kind IN ({', '.join(map(q, sink_kinds))})", *([f"source_kind IN ({', '.join(map(q, kinds))})"] if kinds else [])]
    tests += some("first", source_words) + some("last", sink_words)
    if words:
        tests.append(f"EXISTS (SELECT 1 FROM code c WHERE c.path = j.path AND c.line_number > j.source_line AND c.line_number < j.sink_line AND {contains('lower(c.text)', [w.lower() for w in words])})")
    return f"SELECT {q(name)} AS chain_name, {q(severity)} AS severity, path, source_line, sink_line, source_kind, sink_kind, source_var, sink_name, confidence FROM judged j WHERE {' AND '.join(tests)}"


MATCHED = f"""judged AS (SELECT p.*, lower(a.text) AS first, lower(b.text) AS last FROM {{0}} p
    JOIN code a ON a.path = p.path AND a.line_number = p.source_line JOIN code b ON b.path = p.path AND b.line_number = p.sink_line),
matched AS ({' UNION ALL '.join(_chain(n) for n in range(len(CHAINS)))})"""
CHAIN_PATHS = f"{FLOWS}, {MATCHED.format('paths')}"
CHAINS_OF_FILES = """ranked AS (SELECT *, row_number() OVER (PARTITION BY path, chain_name ORDER BY source_line, sink_line, source_var, sink_name) AS place FROM matched),
grouped AS (SELECT path, chain_name, severity, count(*) AS n_paths, least(1.0, (0.6 + CASE WHEN count(*) >= 2 THEN 0.15 ELSE 0 END + max(confidence)) / 2)::DOUBLE AS confidence,
    string_agg('line ' || source_line || ' -> line ' || sink_line, chr(10) ORDER BY place) FILTER (WHERE place <= 3) AS shown FROM ranked GROUP BY path, chain_name, severity),
chains AS (SELECT path, chain_name, severity, n_paths, confidence, '[' || upper(severity) || '] ' || chain_name || ' (' || floor(round(confidence * 100, 6))::INTEGER || '%)' || chr(10) || shown AS summary FROM grouped)"""
CHAIN_TEXT = f"{CHAIN_PATHS}, {CHAINS_OF_FILES} SELECT path, chain_name, severity, n_paths, round(confidence, 6) AS confidence, summary FROM chains"

# What the syntax of each Python snippet holds, read off by hand: the documents' own lines are comments there.
FACTS = """snippet(path, k) AS (SELECT path, regexp_extract(path, '([0-9]+)', 1)::BIGINT % {n} FROM files),
fn(k, name, line_start, line_end) AS (VALUES (1, 'run', 2, 6), (2, 'fetch', 2, 5), (2, 'main', 6, 7), (3, 'safe', 1, 6), (6, 'first', 1, 2), (6, 'second', 3, 4), (6, 'third', 5, 7)),
call(k, caller, callee, line) AS (VALUES (1, 'run', 'input', 3), (1, 'run', 'subprocess.run', 5), (2, 'fetch', 'requests.get', 3), (2, 'fetch', 'base64.b64decode', 4), (2, 'fetch', 'exec', 5), (2, 'main', 'fetch', 7),
    (3, 'safe', 'input', 2), (3, 'safe', 'name.isalnum', 3), (3, 'safe', 'os.system', 5), (6, 'first', 'second', 2), (6, 'second', 'third', 4), (6, 'third', 'first', 6), (6, 'third', 'print', 7)),
imported(k, name) AS (VALUES (0, 'os'), (0, 'requests'), (1, 'subprocess'), (2, 'requests'), (2, 'base64'), (4, 'hashlib'), (4, 'random')),
source(k, name, kind, line) AS (VALUES (1, 'cmd', 'stdin', 3), (2, 'page', 'network_recv', 3), (3, 'name', 'stdin', 2), (5, 'data', 'file_read', 2)),
derived(k, name, source_var) AS (VALUES (1, 'full', 'cmd'), (2, 'code', 'page')),
flow(k, source_var, sink_name, sink_kind, sink_line, confidence) AS (VALUES (1, 'cmd', 'subprocess.run', 'command_exec', 5, 0.85::DOUBLE), (2, 'page', 'exec', 'code_exec', 5, 0.85::DOUBLE), (3, 'name', 'os.system', 'command_exec', 5, 0.3::DOUBLE)),
edges AS (SELECT path, caller, callee, line FROM snippet JOIN call USING (k)),
calls AS (SELECT DISTINCT path, caller, callee FROM edges),
pairs AS (SELECT DISTINCT path, source, callee AS target FROM edges JOIN (SELECT path, min(caller) AS source FROM edges GROUP BY path) USING (path))""".format(n=len(SNIPPETS))
SYNTAX = f"WITH RECURSIVE {CODE}, {FACTS}"
# The same of the snippets in other languages.
MORE_FACTS = """params(k, name, params) AS (VALUES (1, 'run', 'name'), (2, 'fetch', ''), (2, 'main', ''), (3, 'safe', 'value'), (6, 'first', 'n'), (6, 'second', 'n'), (6, 'third', 'n')),
more_fn(k, name, line_start, line_end, params) AS (VALUES (28, 'handle', 2, 6, 'req,res'), (28, 'send', 8, 12, 'key'), (28, 'anonymous', 14, 14, ''), (28, 'anonymous', 14, 14, ''), (29, 'run', 3, 9, ''), (29, 'main', 10, 12, ''),
    (30, 'find', 3, 8, 'id'), (30, 'list', 9, 11, 'q'), (31, 'load', 2, 7, 'q')),
more_call(k, caller, callee, line) AS (VALUES (28, 'handle', 'exec', 5), (28, 'send', 'fetch', 11), (28, 'anonymous', 'list.map', 14), (28, 'anonymous', 'handle', 14), (29, 'run', 'http.Get', 4), (29, 'run', 'base64.StdEncoding.DecodeString', 6),
    (29, 'run', 'exec.Command', 7), (29, 'run', 'cmd.Run', 8), (29, 'main', 'run', 11), (30, 'find', 'request.getParameter', 4), (30, 'find', 'Statement.executeQuery', 6), (30, 'find', 'list', 7), (30, 'list', 'find', 10), (31, 'load', 'eval', 5), (31, 'load', 'load', 6)),
more_imported(k, name) AS (VALUES (29, 'import "net/http"'), (30, 'import java.sql.Statement'), (31, 'require ' || chr(39) || 'yaml' || chr(39))),
more_source(k, name, kind, line) AS (VALUES (7, 'cmd', 'http_param', 1), (8, 'page', 'file_read', 1), (8, 'box.innerHTML', 'http_body', 4), (9, 'key', 'env_read', 1), (10, 'data', 'env_read', 1), (10, 'resp', 'network_recv', 3), (10, 'err', 'network_recv', 3),
    (11, 'name', 'http_param', 1), (12, 'name', 'http_param', 1), (13, 'name', 'http_param', 1), (14, 'path', 'cli_arg', 1), (14, 'body', 'network_recv', 3), (15, 'name', 'cli_arg', 4), (17, 'name', 'env_read', 1), (18, 'line', 'stdin', 1),
    (28, 'cmd', 'http_param', 3), (28, 'apiKey', 'env_read', 9), (29, 'resp', 'network_recv', 4), (29, 'err', 'network_recv', 4), (30, 'name', 'http_param', 4), (31, 'name', 'http_param', 3)),
more_flow(k, source_var, sink_name, sink_kind, sink_line) AS (VALUES (7, 'cmd', 'child_process.exec', 'command_exec', 3), (8, 'page', 'eval', 'code_exec', 3), (9, 'key', 'fetch', 'network_send', 2), (11, 'name', 'Statement.executeQuery', 'sql_exec', 2),
    (12, 'name', 'system', 'command_exec', 2), (12, 'name', 'YAML.load', 'deserialize', 4), (13, 'name', 'shell_exec', 'command_exec', 2), (17, 'name', 'system', 'command_exec', 2), (17, 'name', 'sprintf', 'code_exec', 3),
    (18, 'line', 'Process.Start', 'command_exec', 2), (18, 'line', 'File.WriteAllText', 'file_write', 3), (28, 'cmd', 'exec', 'command_exec', 5), (28, 'apiKey', 'fetch', 'network_send', 11), (29, 'resp', 'exec.Command', 'command_exec', 7),
    (30, 'name', 'Statement.executeQuery', 'sql_exec', 6), (31, 'name', 'eval', 'code_exec', 5)),
every_source AS (SELECT * FROM source UNION ALL SELECT * FROM more_source),
every_flow AS (SELECT * FROM flow UNION ALL SELECT *, 0.85::DOUBLE FROM more_flow),
syntax_path AS (SELECT path, f.source_var, s.kind AS source_kind, s.line AS source_line, sink_name, sink_kind, sink_line, confidence FROM snippet JOIN every_flow f USING (k) JOIN every_source s ON s.k = f.k AND s.name = f.source_var)"""
ALL_SYNTAX = f"{SYNTAX}, {MORE_FACTS}"
REACH = f"""{SYNTAX}, steps(path, source, target, depth) AS (SELECT path, caller, callee, 1 FROM calls
    UNION SELECT s.path, s.source, c.callee, s.depth + 1 FROM steps s JOIN calls c ON c.path = s.path AND c.caller = s.target WHERE s.depth < 5),
reach AS (SELECT DISTINCT path, source, target FROM steps)"""

FULL_REACH = REACH.replace(" WHERE s.depth < 5", "").replace(", 1 FROM calls", " FROM calls").replace(", s.depth + 1 FROM", " FROM").replace("target, depth)", "target)")

# Python by its syntax, other languages by text.
DEEP_ANALYSIS = f"""{FLOWS.replace('WITH ', 'WITH RECURSIVE ', 1)}, {FACTS},
every_path AS (SELECT * FROM paths WHERE NOT ends_with(path, '.py') AND NOT ends_with(path, '.dockerfile') UNION ALL
    SELECT path, f.source_var, s.kind, s.line, sink_name, sink_kind, sink_line, confidence FROM snippet JOIN flow f USING (k) JOIN source s ON s.k = f.k AND s.name = f.source_var),
{MATCHED.format('every_path')}, {CHAINS_OF_FILES},
summary AS (SELECT * FROM (SELECT path, {DEEP} AS language,
    (SELECT count(*) FROM snippet s JOIN fn USING (k) WHERE s.path = f.path) AS symbols_count, (SELECT count(*) FROM edges e WHERE e.path = f.path) AS call_edges,
    (SELECT count(*) FROM every_path p WHERE p.path = f.path) AS taint_paths, (SELECT count(*) FROM chains c WHERE c.path = f.path) AS attack_chains,
    (SELECT count(*) FROM snippet s WHERE s.path = f.path AND k = 23 AND ends_with(path, '.py')) AS errors FROM files f) WHERE taint_paths + attack_chains + errors > 0)"""
#: What Python says of the one snippet that doesn't parse.
BROKEN = "SyntaxError: invalid syntax (<unknown>, line 1)"
ADVICE = "advice(rule_id, rule_name, description, recommendation) AS (VALUES " + ", ".join(f"({q(r.id)}, {q(r.name)}, {q(r.description)}, {q(r.recommendation)})" for r in RULES) + ")"

ORACLE_SQL: dict[str, str] = {
    "rules_catalogue": f"{findings()}, rules(rule_id, rule_ord, severity, category, languages) AS (VALUES " + ", ".join(f"({q(r.id)}, {n}, {q(r.severity)}, {q(r.category)}, {q(','.join(r.languages))})" for n, r in enumerate(RULES)) + """)
        SELECT r.*, count(f.path) AS n_findings, count(DISTINCT f.path) AS n_files FROM rules r LEFT JOIN findings f USING (rule_id) GROUP BY ALL""",
    "project_flags": f"{RISK} SELECT path, unnest(flags) AS flag FROM risk",
    "syntax_functions": f"{SYNTAX} SELECT path, name, 'function' AS kind, line_start, line_end FROM snippet JOIN fn USING (k)",
    "syntax_calls": f"{SYNTAX} SELECT * FROM edges",
    "syntax_imports": f"{SYNTAX} SELECT path, name FROM snippet JOIN imported USING (k)",
    "syntax_errors": f"{SYNTAX} SELECT path FROM snippet WHERE k = 23",
    "syntax_all_functions": f"{ALL_SYNTAX} SELECT path, name, 'function' AS kind, line_start, line_end, params FROM snippet JOIN (SELECT fn.*, params FROM fn JOIN params USING (k, name) UNION ALL SELECT * FROM more_fn) USING (k)",
    "syntax_all_calls": f"{ALL_SYNTAX} SELECT path, caller, callee, line FROM snippet JOIN (SELECT * FROM call UNION ALL SELECT * FROM more_call) USING (k)",
    "syntax_calls_by_sql": f"{ALL_SYNTAX} SELECT path, caller, callee, line FROM snippet JOIN (SELECT * FROM call UNION ALL SELECT * FROM more_call) USING (k)",
    "syntax_all_imports": f"{ALL_SYNTAX} SELECT path, name FROM snippet JOIN (SELECT * FROM imported UNION ALL SELECT * FROM more_imported) USING (k)",
    "taint_syntax_all_sources": f"{ALL_SYNTAX} SELECT path, name, kind, line FROM snippet JOIN every_source USING (k)",
    "taint_syntax_all_paths": f"{ALL_SYNTAX} SELECT * FROM syntax_path",
    "chains_by_syntax": f"""{FLOWS.replace('WITH ', 'WITH RECURSIVE ', 1)}, {FACTS}, {MORE_FACTS}, {MATCHED.format('syntax_path')}, {CHAINS_OF_FILES}
        SELECT path, chain_name, severity, n_paths, round(confidence, 6) AS confidence, summary FROM chains""",
    "taint_syntax_sources": f"{SYNTAX} SELECT path, name, kind, line FROM snippet JOIN source USING (k)",
    "taint_syntax_tainted": f"{SYNTAX} SELECT path, name, kind, line, name AS source_var FROM snippet JOIN source USING (k) UNION ALL SELECT path, d.name, s.kind, s.line, s.name FROM snippet JOIN derived d USING (k) JOIN source s ON s.k = d.k AND s.name = d.source_var",
    "taint_syntax_paths": f"{SYNTAX} SELECT path, f.source_var, s.kind AS source_kind, s.line AS source_line, sink_name, sink_kind, sink_line, confidence FROM snippet JOIN flow f USING (k) JOIN source s ON s.k = f.k AND s.name = f.source_var",
    "calls_reachable": f"{REACH} SELECT * FROM reach",
    "calls_on_cycle": f"{FULL_REACH} SELECT path, source AS name FROM reach WHERE source = target",
    "calls_components": f"{FULL_REACH} SELECT a.path, a.source AS name, min(a.target) AS component FROM reach a JOIN reach b ON b.path = a.path AND b.source = a.target AND b.target = a.source GROUP BY a.path, a.source",
    "calls_has_path": f"{REACH} SELECT p.path, p.source, p.target, p.source = p.target OR r.path IS NOT NULL AS connected FROM pairs p LEFT JOIN reach r ON r.path = p.path AND r.source = p.source AND r.target = p.target",
    "calls_all_paths": f"""{SYNTAX}, walk(path, source, target, here, names) AS (SELECT path, source, target, source, [source] FROM pairs
        UNION ALL SELECT w.path, w.source, w.target, e.callee, list_append(w.names, e.callee) FROM walk w JOIN edges e ON e.path = w.path AND e.caller = w.here
        WHERE w.here <> w.target AND len(w.names) <= 5 AND NOT list_contains(w.names[:-2], e.callee))
        SELECT path, source, target, array_to_string(names, '>') AS names FROM walk WHERE here = target""",
    "calls_connected": f"""{REACH}, every AS (SELECT * FROM reach UNION SELECT path, target, source FROM reach)
        SELECT p.path, p.source, p.target, p.source = p.target OR r.path IS NOT NULL AS connected FROM every p LEFT JOIN reach r ON r.path = p.path AND r.source = p.source AND r.target = p.target""",
    "calls_paths_of_all": f"""{REACH}, every AS (SELECT * FROM reach UNION SELECT path, target, source FROM reach),
        walk(path, source, target, here, names) AS (SELECT path, source, target, source, [source] FROM every
        UNION ALL SELECT w.path, w.source, w.target, e.callee, list_append(w.names, e.callee) FROM walk w JOIN edges e ON e.path = w.path AND e.caller = w.here
        WHERE w.here <> w.target AND len(w.names) <= 5 AND NOT list_contains(w.names[:-2], e.callee))
        SELECT path, source, target, array_to_string(names, '>') AS names FROM walk WHERE here = target""",
    "calls_cycles": f"""{SYNTAX}, walk(path, here, names) AS (SELECT path, callee, [caller, callee] FROM calls
        UNION ALL SELECT w.path, c.callee, list_append(w.names, c.callee) FROM walk w JOIN calls c ON c.path = w.path AND c.caller = w.here
        WHERE w.here <> w.names[1] AND NOT list_contains(w.names[2:], c.callee)),
        round AS (SELECT path, names[:-2] AS way FROM walk WHERE here = names[1]),
        few AS (SELECT path, arg_min(way, (len(way), way)) AS way FROM round GROUP BY path, way[1], coalesce(way[2], way[1])),
        every AS (SELECT path, way FROM round WHERE len(way) <= 5 UNION SELECT path, way FROM few)
        SELECT DISTINCT path, array_to_string(list_concat(way[list_position(way, list_min(way)) :], way[: list_position(way, list_min(way))]), '>') AS names FROM every""",
    "calls_neighbours": f"""{SYNTAX}, o AS (SELECT path, caller AS name, string_agg(callee, ',' ORDER BY callee) AS callees FROM calls GROUP BY ALL),
        i AS (SELECT path, callee AS name, string_agg(caller, ',' ORDER BY caller) AS callers FROM calls GROUP BY ALL)
        SELECT path, name, coalesce(callees, '') AS callees, coalesce(callers, '') AS callers FROM o FULL JOIN i USING (path, name)""",
    "calls_degrees": f"""{SYNTAX}, ends AS (SELECT path, caller AS name, 1 AS o, 0 AS i FROM edges UNION ALL SELECT path, callee, 0, 1 FROM edges),
        sums AS (SELECT path, name, sum(o)::BIGINT AS o, sum(i)::BIGINT AS i FROM ends GROUP BY ALL)
        SELECT path, count(*) AS total_nodes, sum(o)::BIGINT AS total_edges, count(*) FILTER (WHERE o = 0 AND i = 0) AS isolated_nodes, max(i) AS max_callers, max(o) AS max_callees FROM sums GROUP BY path""",
    "rules_by_severity": f"{findings()} SELECT rule_id, severity, count(*) AS n FROM findings GROUP BY rule_id, severity",
    "languages": f"WITH {CODE}, l AS (SELECT path, {LANGUAGE} AS language, {DEEP} AS deep_language FROM files) SELECT *, {TAINT_LANGUAGE} AS taint_language FROM l",
    "lines": f"WITH {TEXT}, {LINES} SELECT path, line_number, line FROM lines",
    "lines_per_file": f"WITH {TEXT}, {LINES} SELECT path, (SELECT count(*) FROM lines l WHERE l.path = f.path)::INTEGER AS n_lines FROM files f",
    "line_entropy": f"WITH {TEXT}, {LINES} SELECT DISTINCT text, round(CASE WHEN text = '' THEN 0 ELSE list_entropy(string_split(text, '')) END, 6) AS entropy FROM (SELECT rtrim(line, chr(10)) AS text FROM lines)",
    **{f"rule_{r.id.lower().replace('-', '_')}": f"{findings(rules=[r])} SELECT path, line_number, matched_line, context_note FROM findings" for r in RULES},
    "findings_code": f"{findings()} {PLAIN}",
    "findings_text": f"{findings(TEXT)} {PLAIN}",
    "severity_floor_high": f"{findings()} {PLAIN} WHERE {RANK} <= 1",
    "category_poisoning": f"{findings()} {PLAIN} WHERE category = 'poisoning'",
    "severity_counts": f"{findings()} SELECT severity, count(*) AS n FROM findings GROUP BY severity",
    "category_counts": f"{findings()} SELECT category, count(*) AS n FROM findings GROUP BY category",
    "quiet_line": f"{findings()} SELECT concat_ws(', ', count(*) || ' findings', {', '.join(f'CASE WHEN count(*) FILTER (WHERE severity = {q(s)}) > 0 THEN {q(s + " ")} || count(*) FILTER (WHERE severity = {q(s)}) END' for s in SEVERITIES)}) AS line FROM findings",
    "exit_code": f"{findings()} SELECT (CASE WHEN coalesce(bool_or(severity = 'critical'), FALSE) THEN 2 WHEN coalesce(bool_or(severity = 'high'), FALSE) THEN 1 ELSE 0 END)::INTEGER AS exit_code FROM findings",
    "diagnostics": f"""{findings()}, {ADVICE} SELECT path, line_number - 1 AS line, 0 AS "column", 200 AS end_column, CASE WHEN severity IN ('critical', 'high') THEN 'Error' WHEN severity = 'medium' THEN 'Warning' ELSE 'Information' END AS level, rule_id AS code,
        concat_ws(chr(10), '[' || rule_id || '] ' || rule_name, description, CASE WHEN context_note <> description THEN context_note END, recommendation) AS message FROM findings JOIN advice USING (rule_id)""",
    "json_report": f"""{findings()}, {ADVICE} SELECT path, line_number, rule_id, to_json({{'rule_id': rule_id, 'rule_name': rule_name, 'severity': severity, 'category': category, 'path': path, 'line_number': line_number, 'matched_line': matched_line,
        'description': description, 'recommendation': recommendation, 'context_note': context_note}})::VARCHAR AS json FROM findings JOIN advice USING (rule_id)""",
    "scan_totals": f"{findings()} SELECT (SELECT count(*) FROM files) AS files_scanned, count(*) AS findings_count, count(DISTINCT path) AS files_with_findings, (CASE WHEN coalesce(bool_or(severity = 'critical'), FALSE) THEN 2 WHEN coalesce(bool_or(severity = 'high'), FALSE) THEN 1 ELSE 0 END)::INTEGER AS exit_code FROM findings",
    "tree_listing": f"{findings()} SELECT category, severity, path, line_number, rule_id FROM findings",
    "chains_all": f"{DEEP_ANALYSIS} SELECT path, chain_name, severity, n_paths, round(confidence, 6) AS confidence, summary FROM chains",
    "deep_summary": f"{DEEP_ANALYSIS} SELECT * FROM summary",
    "deep_totals": f"{DEEP_ANALYSIS} SELECT count(*) AS reported_files, coalesce(sum(taint_paths), 0)::BIGINT AS taint_paths, coalesce(sum(attack_chains), 0)::BIGINT AS attack_chains, coalesce(sum(errors), 0)::BIGINT AS errors FROM summary",
    "deep_exit_code": f"{DEEP_ANALYSIS} SELECT (CASE WHEN (SELECT count(*) FROM chains) > 0 THEN 2 WHEN (SELECT count(*) FROM every_path) > 0 THEN 1 ELSE 0 END)::INTEGER AS exit_code",
    "deep_json": f"""{DEEP_ANALYSIS}, p AS (SELECT path, list({{'source_line': source_line, 'sink_line': sink_line, 'source_var': source_var, 'source_kind': source_kind, 'sink_name': sink_name, 'sink_kind': sink_kind, 'confidence': round(confidence, 6)}}
            ORDER BY source_line, sink_line, source_var, source_kind, sink_name, sink_kind) AS l FROM every_path GROUP BY path),
        c AS (SELECT path, list({{'chain_name': chain_name, 'severity': severity, 'confidence': round(confidence, 6), 'summary': summary}} ORDER BY chain_name) AS l FROM chains GROUP BY path)
        SELECT s.path, to_json({{'path': s.path, 'language': language, 'symbols_count': symbols_count, 'call_edges': call_edges, 'taint_paths': coalesce(p.l, []), 'attack_chains': coalesce(c.l, []),
            'errors': CASE WHEN errors > 0 THEN [{q(BROKEN)}] ELSE []::VARCHAR[] END}})::VARCHAR AS json FROM summary s LEFT JOIN p USING (path) LEFT JOIN c USING (path)""",
    "file_risk": f"{RISK} SELECT path, total_score, poisoning_score, security_score, findings_count, array_to_string(flags, '|') AS flags FROM risk",
    "project_risk": PROJECT,
    "top_risky_files": f"{RISK} SELECT path, total_score FROM risk ORDER BY total_score DESC, path LIMIT 20",
    "taint_text_sources": f"{FLOWS} SELECT path, var AS source_var, kind AS source_kind, line AS source_line FROM pending",
    "taint_text_tainted": f"{FLOWS} SELECT path, name FROM t{ROUNDS}",
    "taint_text_paths": f"{FLOWS} SELECT * FROM paths",
    "chain_text_paths": f"{CHAIN_PATHS} SELECT path, chain_name, severity, source_line, sink_line, source_kind, sink_kind, source_var FROM matched",
    "chain_text": CHAIN_TEXT,
    "events_by_hour": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
}
