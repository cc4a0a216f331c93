"""DuckDB SQL for the registered queries: own tables, patterns and limits as literals, none of the plans' code.

The tables name what the queries' files hold (ten extensions). ``tests/test_lexer.py`` compares the lexer with one that
reads a character at a time.
"""

from __future__ import annotations

import re

# words of documents that become comment marks, in this order
MARKS = ((". ", ".\n/* "), (", ", " */ "), (" the ", "\n# the "), (" of ", "\n-- of "))
# extension of a document by its number, then the language, comment syntax and decision keywords of each extension
EXTENSIONS = [".ts", ".py", ".sql", ".rb", ".md", ".json", ".css", ".lua", ".go"]
LANGUAGES = """(VALUES ('.ts', 'TypeScript', 'c', 'c'), ('.go', 'Go', 'c', 'c'), ('.css', 'CSS', 'css', 'none'), ('.py', 'Python', 'py', 'py'), ('.rb', 'Ruby', 'hash', 'rb'),
    ('.sql', 'SQL', 'sql', 'c'), ('.lua', 'Lua', 'lua', 'c'), ('.html', 'HTML', 'xml', 'none'), ('.md', 'Markdown', 'text', 'none'), ('.json', 'JSON', 'text', 'none'))"""
STRINGS = r"""(")[^"\\\n]*(?:\\[^\n]?[^"\\\n]*)*("?)|(')[^'\\\n]*(?:\\[^\n]?[^'\\\n]*)*('?)|(`)[^`\\\n]*(?:\\[^\n]?[^`\\\n]*)*(`?)"""
COMMENTS = {
    "c": r"(?s:/\*.*?(?:\*/|\z))|//[^\n]*", "css": r"(?s:/\*.*?(?:\*/|\z))", "py": r"""(?s:\"\"\".*?(?:\"\"\"|\z))|(?s:'''.*?(?:'''|\z))|#[^\n]*""", "hash": r"#[^\n]*",
    "sql": r"(?s:/\*.*?(?:\*/|\z))|--[^\n]*", "lua": r"(?s:--\[\[.*?(?:\]\]|\z))|--[^\n]*", "xml": r"(?s:<!--.*?(?:-->|\z))", "text": r"\x{FDD2}",
}
BRANCHES = {"c": r"\b(?:if|case|catch)\b", "py": r"\b(?:if|elif|except)\b", "rb": r"\b(?:if|elsif|unless|when|rescue)\b"}
LOOPS = {"c": r"\b(?:for|while)\b", "py": r"\b(?:for|while)\b", "rb": r"\b(?:while|until|for)\b"}
BOOLEANS = {"c": r"&&|\|\|", "py": r"\b(?:and|or)\b", "rb": r"\b(?:and|or)\b|&&|\|\|"}
SPACE = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# the globs src1*/en/**, doc_?.go, **/d1/*.sql and *7.html, each over a path or its base name
GLOBS = r"^(?:src1[^/]*/en/.*|doc_[^/]\.go|.*/d1/[^/]*\.sql|[^/]*7\.html)$"
GENERATED = r"(?i)@generated|code generated by|do not edit|autogenerated|auto-generated|generated by|<meta name=\"generator\" content=\"copse|<title>copse[^<]*report</title>".replace('\\"', '"')
GENERATED_NAME = r"(?i)\.(?:min|bundle|generated)\.[^.]+$|(?:^|[.\-_])pb\.[^.]+$"
TEST_NAME = r"(?i)[.\-_](?:test|spec)\.[^.]+$"
VENDOR = "['vendor', 'vendored', 'third_party', 'third-party', 'flow-typed', 'node_modules', 'bower_components']"
TESTS = "['__tests__', '__mocks__', '__fixtures__', '__snapshots__', 'test', 'tests', 'spec', 'specs', 'e2e', 'fixtures', 'benchmarks']"
MACHINES = "['dependabot', 'renovate', 'github-actions', 'greenkeeper', 'snyk-bot', 'imgbot', 'allcontributors', 'mergify', 'codecov', 'semantic-release-bot', 'bot']"
KEYWORDS = """['abstract', 'and', 'as', 'async', 'await', 'break', 'case', 'catch', 'class', 'const', 'continue', 'def', 'default', 'delete', 'do', 'elif', 'else', 'enum', 'except', 'export',
    'extends', 'false', 'final', 'finally', 'fn', 'for', 'from', 'func', 'function', 'if', 'implements', 'import', 'in', 'interface', 'is', 'lambda', 'let', 'match', 'namespace', 'new', 'nil',
    'none', 'not', 'null', 'or', 'package', 'pass', 'private', 'protected', 'public', 'raise', 'return', 'self', 'static', 'struct', 'super', 'switch', 'this', 'throw', 'true', 'try', 'type',
    'typeof', 'undefined', 'use', 'var', 'void', 'when', 'while', 'with', 'yield']"""
LABELS = """CASE WHEN code < 1000 THEN 'Meteoroid 🪨' WHEN code < 10000 THEN 'Asteroid ☄️' WHEN code < 50000 THEN 'Moon 🌑' WHEN code < 100000 THEN 'Planet 🪐'
    WHEN code < 500000 THEN 'Star ⭐' WHEN code < 1000000 THEN 'Solar System ☀️' WHEN code < 5000000 THEN 'Galaxy 🌌' ELSE 'Universe 🌠' END"""


def _q(value: str) -> str:
    """A string literal; line feeds by their code."""
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def _marked() -> str:
    repl = "chr(64976) || '\\1' || chr(64977) || '\\2\\3\\4\\5\\6\\7'"
    arms = " ".join(f"WHEN '{n}' THEN regexp_replace(content, {_q(f'({c})|{STRINGS}')}, {repl}, 'g')" for n, c in COMMENTS.items())
    return f"CASE syntax {arms} END"


def _decisions(column: str, patterns: dict[str, str]) -> str:
    return "(CASE dialect " + " ".join(f"WHEN '{d}' THEN len(regexp_extract_all({column}, {_q(p)}))" for d, p in patterns.items()) + " ELSE 0 END)"


def _tokens(column: str) -> str:
    parts = f"regexp_replace(regexp_replace({column}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Za-z])([0-9])', '\\1_\\2', 'g')"
    pairs = f"regexp_replace({column}, '[\\x{{10000}}-\\x{{10FFFF}}]', '§§', 'g')"
    words = f"list_filter(regexp_extract_all({column}, '[A-Za-z0-9_]+'), lambda w: replace(w, '_', '') = '')"
    return (
        f"(length({column}) - length(replace({column}, chr(10), '')) + len(regexp_extract_all({pairs}, '[^{SPACE}A-Za-z0-9_]{{1,3}}'))"
        f" + len(regexp_extract_all({parts}, '[A-Za-z0-9]{{1,10}}')) + len({words}))"
    )


_CONTENT = "text"
for _old, _new in MARKS:
    _CONTENT = f"replace({_CONTENT}, {_q(_old)}, {_q(_new)})"

_BASE = "list_extract(string_split(path, '/'), -1)"
_DIRS = "string_split(path, '/')[1:len(string_split(path, '/')) - 1]"
_MATCHED = f"(regexp_matches(path, {_q(GLOBS)}) OR regexp_matches({_BASE}, {_q(GLOBS)}))"

#: Named parts, each from those before it.
PARTS: dict[str, str] = {
    "document_files": f"""SELECT doc_id, {_CONTENT} AS content, source || '/' || lang || '/' ||
        CASE WHEN doc_id % 10 = 0 THEN 'tests/' WHEN doc_id % 17 = 0 THEN 'vendor/' WHEN doc_id % 19 = 0 THEN 'docs/' ELSE '' END ||
        'd' || (doc_id // 97)::VARCHAR || '/doc_' || (doc_id % 97)::VARCHAR || {EXTENSIONS}[(doc_id % 9 + 1)::INT] AS path FROM documents""",
    "plain_files": "SELECT 'site/' || page_id::VARCHAR || '.html' AS path, html AS content FROM pages UNION ALL SELECT path, content FROM document_files",
    "files": f"""SELECT path, content, CASE
        WHEN regexp_matches(content[1:2048], {_q(GENERATED)}) THEN 'generated'
        WHEN list_has_any({_DIRS}, {VENDOR}) THEN 'vendored'
        WHEN regexp_matches({_BASE}, {_q(GENERATED_NAME)}) THEN 'generated'
        WHEN list_has_any({_DIRS}, {TESTS}) OR regexp_matches({_BASE}, {_q(TEST_NAME)}) THEN 'test'
        WHEN list_has_any({_DIRS}, ['docs', 'doc']) OR lower(regexp_extract({_BASE}, '\\.[^.]*$')) IN ('.md', '.markdown', '.txt', '.rst', '.adoc') THEN 'docs'
        ELSE 'source' END AS role FROM plain_files""",
    "named": f"SELECT *, regexp_extract({_BASE}, '^.+?(\\.[^.]*)$', 1) AS ext FROM files",
    "typed": f"SELECT n.*, language, syntax, dialect, string_split(content, chr(10)) AS split FROM named n JOIN {LANGUAGES} l(e, language, syntax, dialect) ON lower(ext) = e",
    "marked": f"SELECT *, {_marked()} AS marked FROM typed",
    "stripped": """SELECT *, array_to_string(list_transform(string_split(marked, chr(64976)), lambda p: CASE WHEN contains(p, chr(64977))
        THEN regexp_replace(split_part(p, chr(64977), 1), '[^\\n]', '', 'g') || split_part(p, chr(64977), 2) ELSE p END), '') AS code_text FROM marked""",
    "lexed": """SELECT * EXCLUDE (split, marked), CASE WHEN split[-1] = '' THEN split[1:len(split) - 1] ELSE split END AS lines FROM stripped""",
    "code_split": "SELECT path, string_split(code_text, chr(10)) AS kept FROM lexed",
    "rows_": f"""SELECT path, role, language, dialect, line, raw, code, CASE WHEN NOT regexp_matches(raw, '[^{SPACE}]') THEN 'blank'
        WHEN regexp_matches(code, '[^ \\t\\r\\f\\x{{0B}}]') THEN 'code' ELSE 'comment' END AS kind
        FROM (SELECT l.path, role, language, dialect, unnest(lines) AS raw, unnest(c.kept[1:len(lines)]) AS code, unnest(range(1, len(lines) + 1)) AS line FROM lexed l JOIN code_split c USING (path))""",
    "measured": f"""SELECT path, role, language, count(line) FILTER (WHERE kind = 'code') AS code, count(line) FILTER (WHERE kind = 'comment') AS comment,
        count(line) FILTER (WHERE kind = 'blank') AS blank, count(line) AS total, any_value(branch) AS branch, any_value(loop) AS loop, any_value(bool) AS bool,
        any_value(branch) + any_value(loop) + any_value(bool) AS complexity
        FROM (SELECT path, role, language, {_decisions('code_text', BRANCHES)}::BIGINT AS branch, {_decisions('code_text', LOOPS)}::BIGINT AS loop,
            {_decisions('code_text', BOOLEANS)}::BIGINT AS bool FROM lexed) LEFT JOIN (SELECT path, line, kind FROM rows_) USING (path) GROUP BY path, role, language""",
    "chosen": "SELECT *, CASE WHEN code > 0 THEN complexity / code * 100 ELSE 0.0::DOUBLE END AS density FROM measured WHERE role = 'source'",
    "hits": f"""SELECT path, line, {' + '.join(_decisions('code', b) for b in (BRANCHES, LOOPS, BOOLEANS))} AS n FROM rows_ WHERE role = 'source'""",
    "densest": """SELECT path, max(run)::BIGINT AS densest FROM (SELECT path, sum(n) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS run FROM hits)
        GROUP BY path HAVING max(run) > 0""",
    "scored": """SELECT c.*, coalesce(densest, 0) AS densest, CASE WHEN complexity > 0 THEN coalesce(densest, 0) / complexity * 100 ELSE 0.0::DOUBLE END AS concentration
        FROM chosen c LEFT JOIN densest USING (path)""",
    "costs": f"""SELECT path, coalesce(sum(t), 0)::BIGINT AS tokens, coalesce(sum(t) FILTER (WHERE kind <> 'comment'), 0)::BIGINT AS code_tokens,
        coalesce(sum(t) FILTER (WHERE kind = 'comment'), 0)::BIGINT AS comment_tokens
        FROM files LEFT JOIN (SELECT path, kind, {_tokens('raw')} + 1 AS t FROM rows_) USING (path) WHERE role = 'source' GROUP BY path""",
    "commits": """SELECT o_orderkey AS ord, epoch(o_orderdate)::BIGINT AS time, CASE WHEN o_custkey % 31 = 0 THEN 'renovate@example.com' ELSE replace(lower(c_name), '#', '.') || '@example.com' END AS email,
        CASE WHEN o_custkey % 29 = 0 THEN lower(c_name) || ' [bot]' ELSE lower(c_name) END AS name FROM orders JOIN customer ON o_custkey = c_custkey""",
    "people": f"SELECT * FROM commits WHERE NOT (ends_with(trim(lower(name)), '[bot]') OR list_contains({MACHINES}, regexp_replace(split_part(lower(email), '@', 1), '\\[bot\\]$', '')))",
    "changes": "SELECT l_orderkey AS ord, 'mod' || (l_suppkey % 20)::VARCHAR || '/s' || l_suppkey::VARCHAR || '.ts' AS path, l_quantity::BIGINT AS added, l_linenumber::BIGINT AS deleted FROM lineitem",
    "document_changes": "SELECT l_orderkey AS ord, path, l_quantity::BIGINT AS added, l_linenumber::BIGINT AS deleted FROM lineitem JOIN document_files ON l_partkey = doc_id",
    "life": "SELECT max(time) AS now, (max(time) - min(time)) / 4 AS half FROM people WHERE time > 0",
    "history": """SELECT path, count(*) AS changes, sum(added + deleted)::BIGINT AS churn, sum(CASE WHEN half = 0 THEN 1.0 ELSE pow(0.5::DOUBLE, (now - time) / half) END) AS momentum, max(time) AS last_change
        FROM changes JOIN people USING (ord), life GROUP BY path""",
    "document_history": """SELECT path, count(*) AS changes, sum(added + deleted)::BIGINT AS churn, sum(CASE WHEN half = 0 THEN 1.0 ELSE pow(0.5::DOUBLE, (now - time) / half) END) AS momentum
        FROM document_changes JOIN people USING (ord), life GROUP BY path""",
    "members": "SELECT DISTINCT ord, path FROM changes",
    "bounded": f"SELECT * FROM members WHERE ord IN (SELECT ord FROM members GROUP BY ord HAVING count(*) <= 30)",
    "revised": "SELECT path, count(*) AS revisions FROM bounded GROUP BY path",
    "pairs": f"""SELECT * FROM (SELECT p.a, p.b, shared, x.revisions AS revisions_a, y.revisions AS revisions_b, shared / ((x.revisions + y.revisions) / 2) * 100 AS strength
        FROM (SELECT m.path AS a, n.path AS b, count(*) AS shared FROM bounded m JOIN bounded n ON m.ord = n.ord AND m.path < n.path GROUP BY m.path, n.path) p
        JOIN revised x ON p.a = x.path JOIN revised y ON p.b = y.path)
        WHERE revisions_a >= 10 AND revisions_b >= 10 AND shared >= 2 AND strength >= 0.3""",
    "blame": "SELECT path, line, kind, ((line * 7919 + length(path) * 104729) % 400) * 1000000 AS time FROM rows_ WHERE role = 'source'",
    "runs": "SELECT path, line - row_number() OVER (PARTITION BY path ORDER BY line) AS run, line, time FROM blame WHERE kind = 'comment'",
    "comment_blocks": "SELECT path, run, max(line) AS last, max(time) AS comment_time FROM runs GROUP BY path, run",
    "code_numbered": "SELECT path, line, time, row_number() OVER (PARTITION BY path ORDER BY line) AS k FROM blame WHERE kind = 'code'",
    "drifting": """SELECT b.path, b.run, b.comment_time, max(c.time) AS code_time FROM comment_blocks b
        JOIN (SELECT b.path, b.run, min(c.k) AS k FROM comment_blocks b JOIN code_numbered c ON b.path = c.path AND c.line > b.last GROUP BY b.path, b.run) f ON b.path = f.path AND b.run = f.run
        JOIN code_numbered c ON c.path = b.path AND c.k BETWEEN f.k AND f.k + 9 GROUP BY b.path, b.run, b.comment_time""",
    "drifts": f"SELECT path, count(*) AS blocks, count(*) FILTER (WHERE code_time - comment_time > {3 * 365 * 86400}) AS drifted FROM drifting GROUP BY path",
    "known_blame": "SELECT * FROM blame WHERE line % 11 <> 0 AND path NOT LIKE '%7.%'",
    "zipped": "SELECT path, line, kind, coalesce(k.time, 0) AS time FROM blame b LEFT JOIN known_blame k USING (path, line, kind) WHERE path IN (SELECT path FROM known_blame)",
    "zipped_blocks": "SELECT path, run, max(line) AS last, max(time) AS comment_time FROM (SELECT *, line - row_number() OVER (PARTITION BY path ORDER BY line) AS run FROM zipped WHERE kind = 'comment') GROUP BY path, run",
    "zipped_code": "SELECT path, line, time, row_number() OVER (PARTITION BY path ORDER BY line) AS k FROM zipped WHERE kind = 'code'",
    "zipped_drifting": """SELECT b.path, b.run, b.comment_time, max(c.time) AS code_time FROM zipped_blocks b
        JOIN (SELECT b.path, b.run, min(c.k) AS k FROM zipped_blocks b JOIN zipped_code c ON b.path = c.path AND c.line > b.last GROUP BY b.path, b.run) f ON b.path = f.path AND b.run = f.run
        JOIN zipped_code c ON c.path = b.path AND c.k BETWEEN f.k AND f.k + 9 GROUP BY b.path, b.run, b.comment_time""",
    "code_rows": f"""SELECT path, line, regexp_replace(regexp_replace(raw, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'), '[{SPACE}]+', ' ', 'g') AS t,
        row_number() OVER (PARTITION BY path ORDER BY line) - 1 AS i FROM rows_ WHERE role = 'source' AND kind = 'code'""",
    "windowed": """SELECT path, i, string_agg(t, chr(10)) OVER w AS key, count(*) OVER w AS n FROM code_rows WINDOW w AS (PARTITION BY path ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""",
    "dup_classes": "SELECT key, count(*) AS copies FROM windowed WHERE n = 5 GROUP BY key HAVING count(*) > 1",
    # a block is a repeated window with all lines before and after it that its occurrences have in common
    "occurrences": "SELECT w.path, w.i, w.key, c.copies FROM windowed w JOIN dup_classes c USING (key) WHERE w.n = 5",
    "lines_after": """SELECT o.key, c.i - o.i - 4 AS d, count(*) AS m, count(DISTINCT c.t) AS u, any_value(o.copies) AS copies
        FROM occurrences o JOIN code_rows c ON c.path = o.path AND c.i > o.i + 4 GROUP BY o.key, c.i - o.i - 4""",
    "lines_before": """SELECT o.key, o.i - c.i AS d, count(*) AS m, count(DISTINCT c.t) AS u, any_value(o.copies) AS copies
        FROM occurrences o JOIN code_rows c ON c.path = o.path AND c.i < o.i GROUP BY o.key, o.i - c.i""",
    "extents": """SELECT key, coalesce(max(d) FILTER (WHERE side = 'after'), 0) AS r, coalesce(max(d) FILTER (WHERE side = 'before'), 0) AS l FROM (
        SELECT key, side, d, min(CASE WHEN m = copies AND u = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY key, side ORDER BY d) AS same, row_number() OVER (PARTITION BY key, side ORDER BY d) AS k
        FROM (SELECT *, 'after' AS side FROM lines_after UNION ALL SELECT *, 'before' AS side FROM lines_before)) WHERE same = 1 AND k = d GROUP BY key""",
    "raw_spans": "SELECT o.key, o.path, o.i - coalesce(l, 0) AS first, o.i + 4 + coalesce(r, 0) AS last FROM occurrences o LEFT JOIN extents USING (key)",
    "apart": """SELECT *, sum(fresh) OVER (PARTITION BY key, path ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS span FROM (SELECT *, CASE WHEN first <= max(last) OVER
        (PARTITION BY key, path ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM raw_spans)""",
    "whole_spans": "SELECT key, path, min(first) AS first, max(last) AS last FROM apart GROUP BY key, path, span",
    "placed": """SELECT s.*, a.line AS start_line, b.line AS end_line FROM whole_spans s JOIN code_rows a ON a.path = s.path AND a.i = s.first
        JOIN code_rows b ON b.path = s.path AND b.i = s.last""",
    "clone_groups": """SELECT fragments, min(key) AS key, any_value(copies) AS copies, any_value(files) AS files, any_value(lines) AS lines FROM (
        SELECT key, string_agg(path || ':' || start_line || ':' || end_line, ',' ORDER BY path, start_line) AS fragments, count(*) AS copies, list_sort(list(DISTINCT path)) AS files,
        arg_min(last - first + 1, path || chr(1) || lpad(start_line::VARCHAR, 9, '0')) AS lines FROM placed GROUP BY key HAVING count(*) > 1) GROUP BY fragments""",
    "clone_files": """SELECT s.path, count(DISTINCT c.i) AS duplicated_lines FROM placed s JOIN clone_groups USING (key) JOIN code_rows c ON c.path = s.path AND c.i BETWEEN s.first AND s.last GROUP BY s.path""",
    "clone_paths": "SELECT DISTINCT s.path FROM placed s JOIN clone_groups g USING (key)",
    "clone_totals": "SELECT path, count(*) AS total_lines FROM code_rows GROUP BY path",
}

_WORDS = "list_transform(regexp_extract_all(t, '[A-Za-z0-9_$]+|[^A-Za-z0-9_$]+'), lambda w: CASE WHEN regexp_matches(w, '^[A-Za-z_$]') AND NOT list_contains({keywords}, w) THEN '$' ELSE w END)"
PARTS["masked_rows"] = f"SELECT path, line, i, array_to_string({_WORDS.format(keywords=KEYWORDS)}, '') AS t FROM code_rows"
for _name in ("windowed", "dup_classes", "occurrences", "lines_after", "lines_before", "extents", "raw_spans", "apart", "whole_spans", "placed", "clone_groups"):
    PARTS[f"masked_{_name}"] = re.sub(
        r"\b(windowed|dup_classes|occurrences|lines_after|lines_before|extents|raw_spans|apart|whole_spans|placed|clone_groups)\b", r"masked_\1", PARTS[_name].replace("code_rows", "masked_rows")
    )


def _with(body: str) -> str:
    """A query after the parts that it needs, and those that they need."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name, part in PARTS.items():
            if name not in needed and re.search(rf"\b{name}\b", sql):
                needed.add(name)
                visit(part)

    visit(body)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({p})" for n, p in PARTS.items() if n in needed) + f"\n{body}"


def _quantile(table: str, column: str, fraction: float, where: str = "TRUE") -> str:
    """The value at index min(n - 1, floor(n * fraction)); 0 of none."""
    ranked = f"SELECT {column} AS v, row_number() OVER (ORDER BY {column}) - 1 AS k, count(*) OVER () AS n FROM {table} WHERE {where}"
    return f"coalesce((SELECT v FROM ({ranked}) WHERE k = least(n - 1, floor(n * {fraction}::DOUBLE)::BIGINT)), 0)"


_SUMS = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in ("code", "comment", "blank", "total", "complexity"))
_IGNORED = f"(list_has_any({_DIRS}, ['vendor', 'tests']) OR {_BASE} = 'doc_1.py' OR lower(regexp_extract({_BASE}, '\\.[^.]*$')) IN ('.md', '.css') OR {_MATCHED})"
_DIST = "SELECT language, code, row_number() OVER (PARTITION BY language ORDER BY code) - 1 AS k, count(*) OVER (PARTITION BY language) AS n FROM chosen"
_REFACTOR = f"""SELECT m.path, complexity, code, density, tokens, coalesce(changes, 0) AS changes, coalesce(churn, 0) AS churn, coalesce(momentum, 0) AS momentum
    FROM chosen m JOIN costs USING (path) LEFT JOIN document_history h USING (path) WHERE complexity > 0"""
_LIMITS = f"{_quantile('inputs', 'momentum', 0.5, 'changes > 0')} AS busy, {_quantile('inputs', 'density', 0.75)} AS dense, {_quantile('inputs', 'tokens', 0.75)} AS costly"
_RENAMES = """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'src/' || p_brand || '/f' || p_partkey::VARCHAR WHEN p_partkey % 3 = 1 THEN p_name ELSE 'x' END AS old_path,
    CASE WHEN p_partkey % 3 = 0 THEN 'src/' || p_type || '/f' || p_partkey::VARCHAR WHEN p_partkey % 3 = 1 THEN p_type ELSE p_brand || '/x' END AS new_path FROM part"""

_AGENT_INPUT = """(SELECT s.path, code, density, concentration, tokens, coalesce(duplicated_lines / total_lines * 100, 0) AS duplication
    FROM scored s JOIN costs USING (path) LEFT JOIN clone_files USING (path) LEFT JOIN clone_totals USING (path) WHERE code > 0)"""
_RISKS = f"""list_filter([CASE WHEN density >= dense AND density > 0 THEN 'dense' END, CASE WHEN tokens >= large AND tokens > 0 THEN 'large' END,
    CASE WHEN duplication >= 20 THEN 'duplicated' END, CASE WHEN density >= dense AND density > 0 AND concentration > 0 AND concentration < 15 THEN 'diffuse' END], lambda r: r IS NOT NULL)"""
_AGENT = f"""SELECT path, round(density, 6) AS density, round(concentration, 6) AS concentration, tokens, round(duplication, 6) AS duplication, array_to_string(risks, ',') AS risks,
    CASE WHEN len(risks) = 0 THEN 'safe' WHEN len(risks) = 1 THEN 'review' ELSE 'human' END AS verdict FROM (SELECT *, {_RISKS} AS risks FROM (SELECT *,
    greatest(10, {_quantile(_AGENT_INPUT, 'density', 0.75)}) AS dense, greatest(2000, {_quantile(_AGENT_INPUT, 'tokens', 0.75)}) AS large FROM {_AGENT_INPUT}))"""

ORACLE_SQL: dict[str, str] = {
    "line_kinds": _with("SELECT path, language, code, comment, blank, total FROM measured"),
    "chunk_kinds": _with("SELECT path, language, code, comment, blank, total, complexity FROM measured"),
    "count_by_language": _with(f"SELECT language, count(*) AS files, {_SUMS} FROM chosen GROUP BY language"),
    "count_totals": _with(f"SELECT count(*) AS files, {_SUMS} FROM chosen"),
    "size_distribution": _with(
        f"""SELECT language, max(code) AS max_code, max(code) FILTER (WHERE k = least(n - 1, floor(n * 0.5::DOUBLE)::BIGINT)) AS median_code,
        max(code) FILTER (WHERE k = least(n - 1, floor(n * 0.9::DOUBLE)::BIGINT)) AS p90_code FROM ({_DIST}) GROUP BY language"""
    ),
    "concentration": _with(
        f"""SELECT max(k)::BIGINT AS largest_files, round(sum(code) FILTER (WHERE r <= k) / sum(code) * 100, 6)::DOUBLE AS share, {_quantile('chosen', 'code', 0.5)} AS median_code,
        {_quantile('chosen', 'code', 0.9)} AS p90_code FROM (SELECT code, row_number() OVER (ORDER BY code DESC) AS r, greatest(1, floor(count(*) OVER () * 0.05::DOUBLE + 0.5)) AS k FROM chosen)"""
    ),
    "largest_files": _with("SELECT path, code, comment, complexity FROM chosen ORDER BY code DESC, path LIMIT 25"),
    "role_classify": _with("SELECT path, role FROM files"),
    "role_summary": _with("SELECT role, count(*) AS files, sum(code)::BIGINT AS code FROM measured GROUP BY role"),
    "test_ratio": _with(
        """SELECT source_code, test_code, round(test_code / source_code, 6)::DOUBLE AS ratio FROM (SELECT sum(code) FILTER (WHERE role = 'source')::BIGINT AS source_code,
        sum(code) FILTER (WHERE role = 'test')::BIGINT AS test_code FROM measured)"""
    ),
    "ignore_filter": _with(f"SELECT path FROM plain_files WHERE NOT {_IGNORED}"),
    "glob_match": _with(f"SELECT path, {_MATCHED} AS matched FROM plain_files"),
    # numbers in the paths against the rule that makes the globs, rather than the globs one by one
    "glob_many": _with(
        r"""SELECT path, coalesce(folder % 3 = 0 AND folder < 3000, false) OR coalesce(list_bool_or([n % 3 = 0 AND n < 3000 FOR n IN [page % 10, page % 100, page % 1000, page % 10000]]), false)
            OR coalesce(typed % 3 = 1 AND typed < 3000, false) OR coalesce(seven % 3 = 2 AND seven < 3000, false) OR coalesce(doc % 3 = 0, false) AS matched
        FROM (SELECT path, TRY_CAST(nullif(regexp_extract(path, '/d([0-9]+)/', 1), '') AS BIGINT) AS folder, TRY_CAST(nullif(regexp_extract(path, '^site/([0-9]+)\.html$', 1), '') AS BIGINT) AS page,
            TRY_CAST(nullif(regexp_extract(path, '^src[^/]*/[^/]*/d([0-9]+)/[^/]*\.ts$', 1), '') AS BIGINT) AS typed,
            CASE WHEN page % 10 = 7 AND page >= 10 THEN page // 10 END AS seven, TRY_CAST(nullif(regexp_extract(path, '/doc_([0-9]+)\.[^/]s[^/]*$', 1), '') AS BIGINT) AS doc FROM plain_files)"""
    ),
    "complexity_rank": _with(
        "SELECT path, language, complexity, code, round(density, 6) AS density, densest, round(concentration, 6) AS concentration FROM scored WHERE complexity > 0 AND code >= 3"
    ),
    "complexity_density": _with("SELECT path, round(density, 6) AS density FROM chosen"),
    "complexity_breakdown": _with("SELECT path, branch, loop, bool, complexity FROM chosen"),
    "densest_window": _with("SELECT path, densest FROM densest"),
    "token_estimate": f"SELECT doc_id, {_tokens('text')}::BIGINT AS tokens FROM documents",
    "context_files": _with("SELECT path, tokens, code_tokens, comment_tokens FROM costs"),
    "context_dirs": _with("SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS dir, sum(tokens)::BIGINT AS tokens, count(*) AS files FROM costs GROUP BY dir"),
    "context_totals": _with("SELECT sum(tokens)::BIGINT AS tokens, sum(code_tokens)::BIGINT AS code_tokens, sum(comment_tokens)::BIGINT AS comment_tokens FROM costs"),
    "navigability": _with(
        f"""SELECT count(*) AS files, max(depth)::INT AS max_depth, (SELECT coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM plain_files GROUP BY {_BASE} HAVING count(*) > 1)) AS ambiguous_files,
        {_quantile("(SELECT len(string_split(path, '/')) AS depth FROM plain_files)", 'depth', 0.5)}::INT AS median_depth FROM (SELECT len(string_split(path, '/')) AS depth FROM plain_files)"""
    ),
    "repeated_names": _with(f"SELECT {_BASE} AS name, count(*) AS count FROM plain_files GROUP BY name HAVING count(*) > 1"),
    "budget_tiers": _with("SELECT share::DOUBLE AS share, threshold::BIGINT AS threshold, (SELECT count(*) FROM costs WHERE tokens > threshold) AS files FROM (VALUES (0.5, 4000), (0.25, 2000), (0.1, 800)) t(share, threshold)"),
    "diff_scope": _with("SELECT path, role FROM files WHERE path IN (SELECT path FROM document_files WHERE doc_id % 7 = 0)"),
    "bot_filter": _with("SELECT ord, name FROM people"),
    "rename_pair": _RENAMES,
    "file_changes": _with("SELECT path, changes, churn, round(momentum, 6) AS momentum, last_change FROM history"),
    "folded_changes": _with("SELECT path, changes, churn, round(momentum, 6) AS momentum, last_change FROM history"),
    "coupling_pairs": _with("SELECT a, b, shared, revisions_a, revisions_b, round(strength, 6) AS strength FROM pairs"),
    "coupling_files": _with(
        """SELECT path, any_value(revisions) AS revisions, sum(shared)::BIGINT AS sum_of_coupling, count(*) AS partners FROM
        (SELECT a AS path, revisions_a AS revisions, shared FROM pairs UNION ALL SELECT b, revisions_b, shared FROM pairs) GROUP BY path"""
    ),
    "coupling_commits": _with("SELECT count(*) FILTER (WHERE n <= 5) AS commits, count(*) FILTER (WHERE n > 5) AS skipped FROM (SELECT ord, count(*) AS n FROM members GROUP BY ord)"),
    "comment_drift": _with("SELECT path, blocks, drifted FROM drifts"),
    "drift_summary": _with("SELECT count(*) AS files_checked, sum(blocks)::BIGINT AS blocks, sum(drifted)::BIGINT AS drifted FROM drifts"),
    "dup_windows": _with("SELECT copies, count(*) AS classes FROM dup_classes GROUP BY copies"),
    "drift_candidates": _with("SELECT path FROM chosen WHERE comment > 0 ORDER BY comment DESC, path LIMIT 50"),
    "dup_clones": _with("SELECT lines::INT AS line_count, copies::INT AS copies, fragments FROM clone_groups"),
    "clone_code": _with("""SELECT g.lines::INT AS line_count, g.copies::INT AS copies, g.fragments, string_agg(raw, chr(10) ORDER BY line) AS code
        FROM (SELECT *, string_split(string_split(fragments, ',')[1], ':') AS first FROM clone_groups) g
        JOIN rows_ r ON r.path = first[1] AND r.line BETWEEN first[2]::INT AND first[3]::INT GROUP BY ALL"""),
    "dup_cross_file": _with("SELECT lines::INT AS line_count, copies::INT AS copies, fragments FROM clone_groups WHERE copies >= 3 AND len(files) > 1"),
    "dup_ranked": _with("SELECT array_to_string(files, ',') AS files, copies::INT AS copies, lines::INT AS line_count, (lines * (copies - 1))::INT AS removable FROM clone_groups"),
    "dup_per_file": _with(
        "SELECT path, total_lines, duplicated_lines, round(duplicated_lines / total_lines * 100, 6) AS percentage FROM clone_files JOIN clone_totals USING (path)"
    ),
    "dup_focus": _with(
        """SELECT lines::INT AS line_count, copies::INT AS copies, fragments FROM clone_groups WHERE key IN
        (SELECT key FROM placed WHERE path IN (SELECT path FROM document_files WHERE doc_id % 7 = 0))"""
    ),
    "dup_shape": _with(
        f"""SELECT count(*) AS groups, sum(removable)::BIGINT AS removable, max(lines)::INT AS max_lines, round(count(*) FILTER (WHERE lines < 10) / count(*) * 100, 6) AS under_ten,
        count(*) FILTER (WHERE place = 0) AS within_file, count(*) FILTER (WHERE place = 1) AS same_directory, count(*) FILTER (WHERE place = 2) AS same_package, count(*) FILTER (WHERE place = 3) AS cross_package,
        {_quantile('clone_groups', 'lines', 0.5)}::INT AS median_lines, round(sum(removable) FILTER (WHERE r <= 10) / sum(removable) * 100, 6) AS top_ten_share
        FROM (SELECT *, row_number() OVER (ORDER BY removable DESC) AS r FROM (SELECT lines, lines * (copies - 1) AS removable, CASE WHEN len(files) = 1 THEN 0
            WHEN len(list_distinct(list_transform(files, lambda p: regexp_replace(p, '/?[^/]*$', '')))) = 1 THEN 1
            WHEN len(list_distinct(list_transform(files, lambda p: string_split(regexp_replace(p, '/?[^/]*$', ''), '/')[1:2]))) = 1 THEN 2 ELSE 3 END AS place FROM clone_groups))"""
    ),
    "dup_renamed": _with("SELECT greatest(0, (SELECT count(*) FROM masked_clone_groups) - (SELECT count(*) FROM clone_groups)) AS renamed_groups"),
    "clone_newest": _with("SELECT path, max(time)::BIGINT AS newest FROM clone_paths JOIN known_blame USING (path) GROUP BY path"),
    "comment_blame": _with(
        """SELECT path, count(*) AS blocks, count(*) FILTER (WHERE code_time - comment_time > 94608000) AS drifted FROM zipped_drifting
        WHERE path IN (SELECT path FROM chosen WHERE comment > 0 ORDER BY comment DESC, path LIMIT 50) GROUP BY path"""
    ),
    "log_parsing": _with(f"""SELECT c.ord, 'h' || c.ord::VARCHAR AS hash, time, email, name,
        ends_with(trim(lower(name)), '[bot]') OR list_contains({MACHINES}, regexp_replace(split_part(lower(email), '@', 1), '\\[bot\\]$', '')) AS bot,
        coalesce(files, 0) AS files, added, deleted, last, old_path, new_path
        FROM commits c LEFT JOIN (
            SELECT l_orderkey AS ord, count(*) AS files, sum(CASE WHEN l_quantity % 5 = 0 THEN 0 ELSE l_quantity::BIGINT END)::BIGINT AS added,
                sum(CASE WHEN l_quantity % 5 = 0 THEN 0 ELSE l_linenumber END)::BIGINT AS deleted, (count(*) - 1)::INT AS last,
                min('mod/s' || l_suppkey::VARCHAR || '/f.ts') AS old_path,
                max(CASE WHEN l_linenumber % 3 = 0 THEN 'mod/t' || l_linenumber::VARCHAR ELSE 'mod/s' || l_suppkey::VARCHAR END || '/f.ts') AS new_path
            FROM lineitem GROUP BY l_orderkey
        ) l USING (ord)"""),
    "rename_resolution": """SELECT 'dir/f' || file::VARCHAR || '_v' || max(k // 7) OVER (PARTITION BY file) AS path, (-l_orderkey)::INT AS ord, added FROM (SELECT *,
        row_number() OVER (PARTITION BY file ORDER BY l_orderkey) - 1 AS k FROM (SELECT l_orderkey, min(l_suppkey) % 50 AS file, sum(l_linenumber)::BIGINT AS added FROM lineitem GROUP BY l_orderkey))""",
    "agent_risk": _with(_AGENT),
    "agent_verdicts": _with(f"SELECT {', '.join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in ('safe', 'review', 'human'))} FROM ({_AGENT})"),
    "refactor_verdicts": _with(
        f"""SELECT path, changes, churn, round(momentum, 6) AS momentum, tokens * changes AS recurring_tokens, CASE WHEN code > 0 THEN round(churn / code * 100, 6) ELSE 0 END AS churn_ratio,
        CASE WHEN changes = 0 THEN 'inert' WHEN NOT (momentum >= busy AND changes >= 2) THEN 'quiet' WHEN density >= dense THEN 'refactor' WHEN tokens >= costly THEN 'split' ELSE 'watch' END AS verdict
        FROM (SELECT *, {_LIMITS} FROM inputs)""".replace("inputs", f"({_REFACTOR})")
    ),
    "refactor_limits": _with(f"SELECT round(busy, 6) AS busy, round(dense, 6) AS dense, costly FROM (SELECT {_LIMITS})".replace("inputs", f"({_REFACTOR})")),
    "size_label": _with(f"SELECT code, {LABELS} AS label FROM (SELECT sum(code)::BIGINT AS code FROM chosen)"),
}

