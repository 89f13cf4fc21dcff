"""DuckDB SQL for the registered queries, formulated apart from the Spark expressions.

One regular expression per keyword, UNION ALL, joins and window functions here; one marked
pass over the text and in-row arrays there. RE2 has neither look-around nor possessive
quantifiers, so no pattern is shared.
"""

from __future__ import annotations

from modlens.operators.rules import RULES
from modlens.plans.corpus import EDGES, TEMPLATES
from modlens.plans.documents import DEFAULT_QUESTION, QUESTIONS
from modlens.plans.queries import CONFIG
from modlens.schemas import SEVERITY_RANK


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


BLANK = r"E' \n\t\r'"
LITERAL = r"'[^']*(?:'|\z)"
TOKENS = (
    LITERAL
    + r"""|"[^"]*(?:"|\z)|\[(?:[^\]]|\]\])*(?:\]|\z)|--[^\n]*|/\*(?s:.*?)\*/|/\*(?s:.*)\z|[^'"\[/-]+|(?s:.)"""
)
DECLARED = (
    r"(?is)^.*?\b(?:CREATE|ALTER)\s+(?:OR\s+ALTER\s+)?(?:PROCEDURE|PROC)\s+[a-z0-9_\[\].]+"
)
OBJECT = r"([A-Za-z0-9_#@\[\].]+)"
REFERENCES = [  # keyword pattern, source, operation
    (r"\bSELECT\s+INTO\s+", "SELECT INTO", "Write"),
    (r"\bINSERT\s+INTO\s+", "INSERT INTO", "Write"),
    (r"\bUPDATE\s+", "UPDATE", "Write"),
    (r"\bDELETE(?:\s+[A-Za-z0-9_#@\[\].]+)?\s+FROM\s+", "DELETE FROM", "Write"),
    (r"\bMERGE\s+INTO\s+", "MERGE INTO", "Write"),
    (r"\bFROM\s+", "FROM", "Read"),
    (r"\bJOIN\s+", "JOIN", "Read"),
    (r"\bUSING\s+", "USING", "Read"),
    (r"\bEXEC(?:UTE)?\s+", "EXEC", "Execute"),
]

SHORT_TEXT = "replace(replace(replace(replace(replace({template}, '{{k}}', CAST(o_orderkey AS VARCHAR)), '{{a}}', CAST(o_orderkey % 97 AS VARCHAR)), '{{b}}', CAST(100 + o_orderkey % 89 AS VARCHAR)), '{{d}}', substr(CAST(o_orderdate AS VARCHAR), 1, 10)), '{{p}}', o_orderpriority)"


def short_modules(number: str = "o_orderkey % 16", condition: str = "true", texts: list[str] = TEMPLATES) -> str:
    templates = "[" + ", ".join(q(t) for t in texts) + "]"
    text = SHORT_TEXT.format(template=f"({templates})[CAST({number} AS INTEGER) + 1]")
    return (
        f"SELECT CAST(o_orderkey AS VARCHAR) AS module_id, {text} AS sql"
        f" FROM orders WHERE {condition}"
    )


LONG_MODULES = (
    "SELECT 'D' || doc_id AS module_id, 'CREATE PROCEDURE dbo.DOC_' || doc_id || chr(10) || 'AS'"
    " || chr(10) || '/* ' || text || ' */' || chr(10) || 'UPDATE TB_' || (doc_id % 97)"
    " || ' SET NOTE = ''' || replace(text, '''', '''''') || ''' ;' AS sql FROM documents"
)


# A module per part as a file; which are left out, empty or no UTF-8 follows from the number.
PART_MODULES = short_modules().replace(
    "FROM orders",
    "FROM (SELECT p_partkey AS o_orderkey, '1998-10-03' AS o_orderdate, p_brand AS o_orderpriority FROM part)",
)
ALL_FILES = f"""
SELECT CASE WHEN k % 11 = 3 THEN 'out/' WHEN k % 7 = 0 THEN '' WHEN k % 2 = 0 THEN 'd' || k % 13 || '/' ELSE 'd' || k % 13 || '/e' || k % 5 || '/' END
    || 'm' || k || CASE WHEN k % 4 = 1 THEN '.SQL' ELSE '.sql' END AS module_id,
  CASE WHEN k % 19 = 7 THEN '' ELSE sql END AS sql, 'm' || k AS stem, k % 17 = 5 AND k % 19 <> 7 AS bad
FROM (SELECT CAST(module_id AS BIGINT) AS k, sql FROM ({PART_MODULES})) WHERE k % 10 <> 9"""
FILES = f"SELECT * FROM ({ALL_FILES}) WHERE NOT starts_with(module_id, 'out/')"


def names(expression: str) -> str:
    return f"array_to_string(list_transform(string_split({expression}, '.'), lambda p: trim(p, '[]')), '.')"


def node(expression: str) -> str:
    return f"rtrim('N_' || regexp_replace({expression}, '[^A-Za-z0-9]', '_', 'g'), '_')"


def _clean() -> str:
    collapsed = "trim(regexp_replace(kw, '\\s+', ' ', 'g'))"
    words = "^(?i)(?:(?:BEGIN(?: (?:TRY|CATCH|TRAN|TRANSACTION))?|END(?: (?:TRY|CATCH))?)(?: |$))+"
    return f"regexp_replace({collapsed}, {q(words)}, '')"


def _rules(p: str) -> str:
    def kw(pattern: str) -> str:
        return f"regexp_matches(kw, {q(pattern)})"

    module_rules = {
        "select_star": kw(r"(?i)\bSELECT\s+\*"),
        "nolock_used": kw(r"(?i)WITH\s*\(\s*NOLOCK\s*\)"),
        "dynamic_sql": kw(r"(?i)\bEXEC(?:UTE)?\s*\(\s*@") + " OR " + kw(r"(?i)\bsp_executesql\b"),
        "linked_server": kw(
            r"\b[A-Za-z0-9_\[\]]+\.[A-Za-z0-9_\[\]]+\.[A-Za-z0-9_\[\]]+\.[A-Za-z0-9_\[\]]+\b"
        ),
        "multi_join_aggregation": "(contains(upper(kw), 'SUM(') OR contains(upper(kw), 'COUNT('))"
        " AND " + kw(r"(?i)\bJOIN\b") + " AND " + kw(r"(?i)\bGROUP\s+BY\b"),
        "cursor_used": kw(r"(?i)\bCURSOR\b"),
        "transaction_without_trycatch": "contains(upper(kw), 'BEGIN TRAN') AND NOT"
        " (contains(upper(kw), 'BEGIN TRY') AND contains(upper(kw), 'BEGIN CATCH'))",
        "trycatch_without_rollback": "contains(upper(kw), 'BEGIN TRY')"
        " AND contains(upper(kw), 'BEGIN CATCH') AND NOT contains(upper(kw), 'ROLLBACK')",
        "hardcoded_date": r"regexp_matches(body, '''\d{4}-\d{2}-\d{2}''')",
        "status_magic_number": kw(r"(?i)\bSTATUS\s*=\s*\d+"),
        "temp_table_chain": "len(temps) >= 3",
    }
    statement_rules = {
        "update_without_where": "starts_with(u, 'UPDATE') AND contains(u, ' SET ')"
        " AND NOT contains(u, ' WHERE ')",
        "delete_without_where": "starts_with(u, 'DELETE') AND NOT contains(u, ' WHERE ')",
        "insert_select_no_distinct": "starts_with(u, 'INSERT INTO') AND contains(u, ' SELECT ')"
        " AND NOT contains(u, ' DISTINCT ') AND NOT contains(u, ' GROUP BY ')",
    }
    parts = [
        f"SELECT module_id, '{rule}' AS rule_id FROM {p}bodies WHERE {condition}"
        for rule, condition in module_rules.items()
    ] + [
        f"SELECT DISTINCT module_id, '{rule}' FROM {p}cleaned WHERE {condition}"
        for rule, condition in statement_rules.items()
    ]
    return " UNION ALL ".join(parts)


def _hits(p: str) -> str:
    parts = []
    for keyword, source, operation in REFERENCES:
        pattern = q("(?i)" + keyword + OBJECT)
        parts.append(
            f"SELECT module_id, stmt_index, '{source}' AS source, '{operation}' AS operation,"
            f" unnest(regexp_extract_all(s, {pattern})) AS hit,"
            f" unnest(regexp_extract_all(s, {pattern}, 1)) AS raw,"
            f" unnest(string_split_regex(s, {pattern})) AS gap,"
            f" unnest(range(len(regexp_extract_all(s, {pattern})) + 1)) AS n"
            f" FROM {p}stmts WHERE regexp_matches(s, {pattern})"
        )
    return " UNION ALL ".join(parts)


def _catalog(config: dict | None) -> str:
    rows = []
    for rule in RULES:
        setting = (config or {}).get(rule.rule_id, True)
        if setting is False:
            continue
        severity = setting.capitalize() if isinstance(setting, str) else rule.severity
        rows.append(
            f"({q(rule.rule_id)}, {q(severity)}, {SEVERITY_RANK[severity]},"
            f" {q(rule.message)}, {q(rule.suggestion)})"
        )
    return (
        "SELECT * FROM (VALUES "
        + ", ".join(rows)
        + ") AS t(rule_id, severity, rank, message, suggestion)"
    )


def analysis(modules: str, p: str = "", config: dict | None = None) -> dict[str, str]:
    """Common table expressions from module texts to all child tables."""
    return {
        f"{p}mods": modules,
        f"{p}codes": f"""SELECT module_id, array_to_string(list_transform(
            regexp_extract_all(sql, {q(TOKENS)}), lambda t:
            CASE WHEN starts_with(t, '--') THEN '' WHEN starts_with(t, '/*') AND (NOT ends_with(t, '*/') OR length(t) < 4)
            THEN regexp_replace(left(t, -1), '[^\\n]', '', 'g') || right(t, 1) WHEN starts_with(t, '/*')
            THEN regexp_replace(t, '[^\\n]', '', 'g') ELSE t END), '') AS code FROM {p}mods""",
        f"{p}heads": f"""SELECT *, substr(code, length(pre) + 1) AS rest FROM (
            SELECT *, regexp_extract(code, {q(DECLARED)}) AS pre FROM {p}codes)""",
        # EXECUTE AS opens no body; it is hidden by as many other characters while the opening is looked for.
        f"{p}marks": f"""SELECT *, CASE WHEN pre = '' THEN '' ELSE left(rest, length(regexp_extract(
            regexp_replace(rest, '(?i)\\b(EXECUTE\\s+)AS\\b', '\\1__', 'g'), '(?is)^.*?\\bAS\\b\\s*')))
            END AS opening FROM {p}heads""",
        f"{p}bodies": f"""SELECT *, regexp_replace(body, {q(LITERAL)}, '  ', 'g') AS kw,
            list_sort(list_distinct(regexp_extract_all(body, '#{{1,2}}[A-Za-z0-9_]+'))) AS temps
            FROM (SELECT module_id, code, nullif({names("regexp_extract(pre, '[A-Za-z0-9_\\[\\].]+$')")}, '') AS name,
            CASE WHEN pre = '' THEN '' WHEN opening = '' THEN rest ELSE opening END AS block,
            trim(CASE WHEN opening = '' THEN code ELSE substr(rest, length(opening) + 1) END, {BLANK}) AS body
            FROM {p}marks)""",
        f"{p}lists": f"""SELECT module_id, list_filter(list_transform(string_split(regexp_replace(
            array_to_string(list_transform(regexp_extract_all(body, {q(LITERAL + "|[^']+")}),
            lambda t: CASE WHEN starts_with(t, '''') THEN replace(replace(t, ';', chr(1)), chr(10), chr(2))
            ELSE t END), ''), '(?im)^[ \\t\\r]*GO[ \\t\\r]*$', ';', 'g'), ';'),
            lambda s: trim(replace(replace(s, chr(1), ';'), chr(2), chr(10)), {BLANK})),
            lambda s: s <> '') AS texts FROM {p}bodies""",
        f"{p}stmts": f"""SELECT module_id, unnest(texts) AS s, generate_subscripts(texts, 1) AS stmt_index
            FROM {p}lists""",
        f"{p}cleaned": f"""SELECT module_id, stmt_index, nullif({_clean()}, '') AS cleaned, upper({_clean()}) AS u FROM (
            SELECT *, regexp_replace(s, {q(LITERAL)}, '  ', 'g') AS kw FROM {p}stmts)""",
        f"{p}catalog": _catalog(config),
        f"{p}found": _rules(p),
        f"{p}findings": f"SELECT module_id, c.* FROM {p}found JOIN {p}catalog c USING (rule_id)",
        f"{p}raw": _hits(p),
        f"{p}placed": f"""SELECT *, sum(strlen(gap)) OVER w + sum(strlen(hit)) OVER w - strlen(raw) AS "offset",
            {names("raw")} AS object FROM {p}raw
            WINDOW w AS (PARTITION BY module_id, stmt_index, source ORDER BY n)""",
        f"{p}named": f"""SELECT * FROM {p}placed WHERE hit IS NOT NULL AND object <> ''
            AND NOT starts_with(raw, '@') AND NOT (source = 'EXEC' AND lower(raw) IN
            ('as', 'caller', 'owner', 'self', 'sp_executesql', 'sp_prepare', 'sp_execute'))""",
        f"{p}hits": f"""SELECT * FROM {p}named n WHERE NOT (source = 'FROM' AND EXISTS (SELECT 1 FROM {p}named w
            WHERE w.module_id = n.module_id AND w.stmt_index = n.stmt_index
            AND w.operation = 'Write' AND w.object = n.object))""",
        f"{p}stmt_hits": f"""SELECT * FROM {p}hits QUALIFY row_number() OVER (
            PARTITION BY module_id, stmt_index, object, source ORDER BY "offset") = 1""",
        f"{p}first_hits": f"""SELECT * FROM {p}hits QUALIFY row_number() OVER (
            PARTITION BY module_id, object, source ORDER BY "offset", stmt_index) = 1""",
        f"{p}deps": f"""SELECT module_id, row_number() OVER (PARTITION BY module_id
            ORDER BY "offset", stmt_index) AS ord, CAST("offset" AS BIGINT) AS "offset", stmt_index, object,
            operation, source, len(list_filter(string_split(object, '.'), lambda x: x <> '')) >= 4
            AS is_external FROM {p}first_hits""",
        f"{p}summaries": f"""SELECT module_id, stmt_index, c, CASE WHEN starts_with(u, 'SELECT INTO') THEN 'Insert'
            WHEN starts_with(u, 'SELECT') THEN 'Select' WHEN starts_with(u, 'INSERT') THEN 'Insert'
            WHEN starts_with(u, 'UPDATE') THEN 'Update' WHEN starts_with(u, 'DELETE') THEN 'Delete'
            WHEN starts_with(u, 'MERGE') THEN 'Merge' WHEN starts_with(u, 'EXECUTE') OR
            starts_with(u, 'EXEC ') OR u = 'EXEC' THEN 'Execute' WHEN contains(u, 'BEGIN TRAN') OR
            contains(u, 'COMMIT') OR contains(u, 'ROLLBACK') THEN 'Transaction' ELSE 'Unknown' END AS kind
            FROM (SELECT *, upper(c) AS u FROM (SELECT *, CASE WHEN upper(s) = 'END' THEN ''
            WHEN upper(words[1]) = 'BEGIN' AND len(words) > 1 AND upper(words[2]) NOT IN
            ('TRY', 'CATCH', 'TRAN', 'TRANSACTION') THEN array_to_string(words[2:], ' ') ELSE s END AS c
            FROM (SELECT *, string_split_regex(s, '\\s+') AS words FROM {p}stmts)))""",
        f"{p}acts": f"""SELECT module_id, stmt_index, arg_min(object, "offset") FILTER (operation <> 'Read') AS target,
            list(object ORDER BY "offset") FILTER (operation = 'Read') AS sources
            FROM {p}stmt_hits GROUP BY ALL""",
        f"{p}statements": f"""SELECT module_id, row_number() OVER (PARTITION BY module_id ORDER BY stmt_index)
            AS "index", kind, target, coalesce(sources, []) AS sources FROM {p}summaries
            LEFT JOIN {p}acts USING (module_id, stmt_index) WHERE c <> ''""",
        f"{p}items": f"""SELECT module_id, pos, regexp_replace(trim(regexp_replace(regexp_replace(item,
            '(?i) OUTPUT$', ''), '\\s+', ' ', 'g')), '(?i)(?: (?:AS|BEGIN|END))+$', '') AS words FROM (
            SELECT module_id, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM (
            SELECT module_id, list_filter(list_transform(regexp_extract_all(trim(block, {BLANK}),
            '(?:[^,''(]|''[^'']*''|\\([^()]*\\))+'), lambda i: trim(i, {BLANK})),
            lambda i: starts_with(i, '@')) AS items FROM {p}bodies))""",
        f"{p}parameters": f"""SELECT module_id, pos, name, trim(regexp_extract(tail, '^[^=]*')) AS data_type,
            CASE WHEN contains(tail, '=') THEN nullif(trim(substr(tail, strpos(tail, '=') + 1)), '') END
            AS default_value FROM (SELECT module_id, pos, split_part(words, ' ', 1) AS name,
            substr(words, length(split_part(words, ' ', 1)) + 2) AS tail FROM {p}items)""",
        f"{p}dep_counts": f"""SELECT module_id, count(*) FILTER (operation = 'Read') AS r,
            count(*) FILTER (operation = 'Write') AS w FROM {p}deps GROUP BY 1""",
        f"{p}stmt_counts": f'SELECT module_id, count(*) AS n FROM {p}statements GROUP BY 1',
        f"{p}levels": f"""SELECT module_id, count(*) AS n, arg_max(severity, rank) AS level,
            string_agg(rule_id, ',' ORDER BY rank DESC, rule_id) AS rules,
            list(rule_id ORDER BY rank DESC, rule_id) AS ids,
            list(rule_id || ': ' || message ORDER BY rank DESC, rule_id) AS texts,
            list(struct_pack(rule_id := rule_id, severity := severity, message := message,
            suggestion := suggestion) ORDER BY rank DESC, rule_id) AS risks
            FROM {p}findings GROUP BY 1""",
        f"{p}metrics": f"""SELECT module_id, b.name, b.temps, coalesce(s.n, 0) AS statement_count,
            coalesce(d.r, 0) AS read_count, coalesce(d.w, 0) AS write_count,
            coalesce(l.level, 'Low') AS risk_level, coalesce(l.n, 0) AS risk_count,
            coalesce(l.rules, '') AS risk_rules, coalesce(l.ids, []) AS ids, coalesce(l.texts, []) AS texts,
            coalesce(l.risks, []) AS risks FROM {p}bodies b LEFT JOIN {p}stmt_counts s USING (module_id)
            LEFT JOIN {p}dep_counts d USING (module_id) LEFT JOIN {p}levels l USING (module_id)""",
        f"{p}objects": f"""SELECT module_id, object, operation, any_value(is_external) AS is_external,
            min(ord) AS ord FROM {p}deps GROUP BY 1, 2, 3""",
        f"{p}outside": f"""SELECT module_id, list(object ORDER BY ord) AS external FROM (SELECT module_id,
            object, min(ord) AS ord FROM {p}deps WHERE is_external GROUP BY 1, 2) GROUP BY 1""",
        f"{p}groups": f"""SELECT m.*, coalesce(g.reads, []) AS reads, coalesce(g.writes, []) AS writes,
            coalesce(g.executes, []) AS executes, coalesce(x.external, []) AS external FROM {p}metrics m
            LEFT JOIN (SELECT module_id, list(object ORDER BY ord) FILTER (operation = 'Read') AS reads,
            list(object ORDER BY ord) FILTER (operation = 'Write') AS writes,
            list(object ORDER BY ord) FILTER (operation = 'Execute') AS executes
            FROM {p}objects GROUP BY 1) g USING (module_id) LEFT JOIN {p}outside x USING (module_id)""",
        f"{p}params": f"""SELECT module_id, list(name || ' ' || data_type || coalesce(' = ' || default_value, '')
            ORDER BY pos) AS params, list(struct_pack(name := name, data_type := data_type,
            default_value := default_value) ORDER BY pos) AS structs FROM {p}parameters GROUP BY 1""",
        f"{p}sides": f"""SELECT g.*, coalesce(params, []) AS params FROM {p}groups g
            LEFT JOIN {p}params USING (module_id)""",
    }


def _documents() -> dict[str, str]:
    asked = ", ".join(f"({q(question)}, {q(rule)})" for question, rules in QUESTIONS for rule in rules)
    return {
        "raised": f"""SELECT DISTINCT module_id, question FROM found
            JOIN (VALUES {asked}) AS t(question, rule_id) USING (rule_id)""",
        "questions": f"""SELECT module_id, row_number() OVER (PARTITION BY module_id ORDER BY question) AS pos,
            question FROM raised UNION ALL SELECT module_id, 1, {q(DEFAULT_QUESTION)} FROM mods
            WHERE module_id NOT IN (SELECT module_id FROM raised)""",
        "suggested": """SELECT module_id, row_number() OVER (PARTITION BY module_id ORDER BY kind) AS pos, query
            FROM (SELECT module_id, 1 AS kind, 'SELECT ORDER_NO, PART_NO, COUNT(*) AS CNT' || chr(10)
            || 'FROM ' || coalesce(reads[1], '<SOURCE_TABLE>') || chr(10) || 'GROUP BY ORDER_NO, PART_NO'
            || chr(10) || 'HAVING COUNT(*) > 1;' AS query FROM groups
            WHERE list_contains(ids, 'multi_join_aggregation')
            UNION ALL SELECT module_id, 2, 'SELECT TOP 100 *' || chr(10) || 'FROM '
            || coalesce(writes[1], '<TARGET_TABLE>') || ';' FROM groups
            WHERE list_has_any(ids, ['update_without_where', 'delete_without_where'])
            UNION ALL SELECT module_id, 3, '-- Inspect the generated SQL string before execution'
            || chr(10) || '-- PRINT @SQL;' FROM groups WHERE list_contains(ids, 'dynamic_sql'))""",
        "steps": """SELECT module_id, row_number() OVER (PARTITION BY module_id ORDER BY kind) AS pos, step FROM (
            SELECT module_id, 1 AS kind, 'Reads from `' || array_to_string(reads, '`, `') || '`' AS step
            FROM groups WHERE len(reads) > 0 UNION ALL
            SELECT module_id, 2, 'Uses temp tables `' || array_to_string(temps, '`, `') || '`'
            FROM groups WHERE len(temps) > 0 UNION ALL
            SELECT module_id, 3, 'Writes to `' || array_to_string(writes, '`, `') || '`'
            FROM groups WHERE len(writes) > 0 UNION ALL
            SELECT module_id, 4, 'Calls `' || array_to_string(executes, '`, `') || '`'
            FROM groups WHERE len(executes) > 0)""",
        "flows": """SELECT module_id, coalesce(string_agg(pos || '. ' || step, chr(10) ORDER BY pos),
            '1. No explicit flow detected.') AS flow FROM mods LEFT JOIN steps USING (module_id) GROUP BY 1""",
        "dep_nodes": f"""SELECT d.*, {node("object")} AS id, {node("coalesce(name, 'UNKNOWN_PROC')")} AS proc
            FROM deps d JOIN bodies USING (module_id)""",
        "dep_lines": """SELECT module_id, ord, CASE WHEN id <> proc AND row_number() OVER (
            PARTITION BY module_id, id ORDER BY ord) = 1 THEN '    ' || id || '["' || object || '"]' || chr(10)
            ELSE '' END || '    ' || CASE operation WHEN 'Read' THEN id || ' --> ' || proc
            WHEN 'Write' THEN proc || ' --> ' || id ELSE proc || ' -. executes .-> ' || id END AS line
            FROM dep_nodes""",
        "diagrams": f"""SELECT module_id, 'flowchart LR' || chr(10) || '    '
            || {node("coalesce(any_value(name), 'UNKNOWN_PROC')")} || '["'
            || coalesce(any_value(name), 'UNKNOWN_PROC') || '"]' || chr(10)
            || coalesce(string_agg(line, chr(10) ORDER BY ord), '    %% No dependencies detected') AS diagram
            FROM bodies LEFT JOIN dep_lines USING (module_id) GROUP BY 1""",
        "asked": "SELECT module_id, list(question ORDER BY pos) AS asked FROM questions GROUP BY 1",
        "advised": "SELECT module_id, list(query ORDER BY pos) AS advised FROM suggested GROUP BY 1",
        "dep_lists": """SELECT module_id, list(struct_pack(object := object, operation := operation,
            source := source) ORDER BY ord) AS deps FROM deps GROUP BY 1""",
        "stmt_lists": """SELECT module_id, list(struct_pack("index" := "index", kind := kind,
            target := target, sources := sources) ORDER BY "index") AS stmts FROM statements GROUP BY 1""",
        "docs": """SELECT g.*, asked, coalesce(advised, []) AS advised, coalesce(deps, []) AS deps,
            coalesce(stmts, []) AS stmts, coalesce(structs, []) AS structs, flow, diagram,
            coalesce(name, 'Unknown') AS title FROM groups g JOIN asked USING (module_id)
            JOIN flows USING (module_id) JOIN diagrams USING (module_id)
            LEFT JOIN advised USING (module_id) LEFT JOIN dep_lists USING (module_id)
            LEFT JOIN stmt_lists USING (module_id) LEFT JOIN params USING (module_id)""",
    }


def _bullets(items: str) -> str:
    return (
        f"CASE WHEN len({items}) = 0 THEN '- None' || chr(10) ELSE"
        f" array_to_string(list_transform({items}, lambda i: '- ' || i || chr(10)), '') END"
    )


def _text(*parts: str) -> str:
    # \n in the parts stands for a newline
    return " || ".join(p.replace("\\n", "\n") for p in parts)


_BLOCKS = (
    "CASE WHEN len(advised) = 0 THEN '- No specific query suggested.\\n' ELSE array_to_string("
    "list_transform(advised, lambda a: '```sql\\n' || a || '\\n```\\n'), '') END"
)


def _report() -> str:
    # The report's headings.
    return _text(
        "'# Procedure Report: ' || title || '\\n\\n## 1. Overview\\n- Procedure: ' || title",
        "'\\n- Dialect: T-SQL\\n- Statements: ' || statement_count || '\\n- Risk Level: ' || risk_level",
        "'\\n- Read Tables: ' || len(reads) || '\\n- Written Tables: ' || len(writes)",
        "'\\n- Temp Tables: ' || len(temps) || '\\n- Risk Findings: ' || risk_count",
        "'\\n\\n## 2. Parameters\\n| Parameter | Type | Default |\\n|---|---|---|\\n'",
        "CASE WHEN len(structs) = 0 THEN '| None | - | - |\\n' ELSE array_to_string(list_transform("
        "structs, lambda p: '| ' || p.name || ' | ' || p.data_type || ' | '"
        " || coalesce(p.default_value, 'Required') || ' |\\n'), '') END",
        "'\\n## 3. Dependencies\\n\\n### Tables Read\\n' || " + _bullets("reads"),
        "'\\n### Tables Written\\n' || " + _bullets("writes"),
        "'\\n### Procedures Executed\\n' || " + _bullets("executes"),
        "'\\n### External Dependencies\\n' || " + _bullets("external"),
        "'\\n## 4. Temp Tables\\n' || " + _bullets("temps"),
        "'\\n## 5. Dependency Diagram\\n\\n```mermaid\\n' || diagram || '\\n```\\n\\n'",
        "'## 6. Execution Flow\\n' || flow || '\\n\\n## 7. Risk Findings\\n'",
        "CASE WHEN risk_count = 0 THEN '- None detected.\\n' ELSE array_to_string(list_transform("
        "risks, lambda r: '\\n### ' || r.severity || ': ' || r.rule_id || '\\n' || r.message"
        " || '\\n\\nSuggestion: ' || r.suggestion || '\\n'), '') END",
        "'\\n## 8. Questions to Verify\\n' || " + _bullets("asked"),
        "'\\n## 9. Suggested Next Queries\\n' || " + _BLOCKS,
    )


def _context() -> str:
    def noun(items: str) -> str:
        return f"len({items}) || CASE WHEN len({items}) = 1 THEN ' table' ELSE ' tables' END"

    return _text(
        "'# AI Context for Stored Procedure Analysis\\n\\n## Procedure\\n' || title",
        "'\\n\\n## Summary\\nThis procedure has ' || statement_count || ' statements, reads '",
        noun("reads") + " || ', writes ' || " + noun("writes") + " || ', uses ' || len(temps)",
        "' temp ' || CASE WHEN len(temps) = 1 THEN 'table' ELSE 'tables' END || ', and raises '",
        "risk_count || ' risk ' || CASE WHEN risk_count = 1 THEN 'finding' ELSE 'findings' END",
        "'.\\n\\n## Extracted Dependencies\\n### Tables Read\\n' || " + _bullets("reads"),
        "'\\n### Tables Written\\n' || " + _bullets("writes"),
        "'\\n### Procedures Executed\\n' || " + _bullets("executes"),
        "'\\n### Temp Tables\\n' || " + _bullets("temps") + " || '\\n## Suspicious Logic\\n'",
        "CASE WHEN risk_count = 0 THEN '- None detected.\\n' ELSE array_to_string(list_transform("
        "risks, lambda r: '- [' || r.severity || '] ' || r.rule_id || ': ' || r.message || '\\n'), '') END",
        "'\\n## Ask\\n' || " + _bullets("asked"),
        "'\\n## Suggested Verification Queries\\n' || " + _BLOCKS,
    )


_TRACE_JSON = """CAST(to_json(struct_pack(name := name, parameters := structs, dependencies := deps,
    temp_tables := temps, risks := risks, statements := stmts, metrics := struct_pack(
    statement_count := statement_count, read_count := read_count, write_count := write_count,
    risk_level := risk_level))) AS VARCHAR)"""
_CONTEXT_JSON = """CAST(to_json(struct_pack(procedure := name, summary := struct_pack(
    statement_count := statement_count, read_count := len(reads), write_count := len(writes),
    temp_table_count := len(temps), risk_count := risk_count, risk_level := risk_level),
    dependencies := struct_pack(reads := reads, writes := writes, executes := executes,
    external := external), temp_tables := temps, risks := risks, questions := asked,
    suggested_queries := advised)) AS VARCHAR)"""


def _with(ctes: dict[str, str], select: str) -> str:
    """Only what ``select`` needs, in order."""
    needed: set[str] = set()
    texts = [select]
    for name in reversed(ctes):
        if any(_mentions(t, name) for t in texts):
            needed.add(name)
            texts.append(ctes[name])
    chosen = ", ".join(f"{n} AS MATERIALIZED ({s})" for n, s in ctes.items() if n in needed)
    return f"WITH {chosen} {select}"


def _mentions(sql: str, name: str) -> bool:
    import re

    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql) is not None


# Set name, column of the sides, for comparison.
_SETS = {
    "parameters": "params",
    "tables_read": "reads",
    "tables_written": "writes",
    "procedures_executed": "executes",
    "temp_tables": "temps",
    "risks": "texts",
}


def _difference(left: str, right: str) -> str:
    left, right = f"coalesce({left}, [])", f"coalesce({right}, [])"
    return f"list_sort(list_distinct(list_filter({left}, lambda x: NOT list_contains({right}, x))))"


def _delta(column: str) -> str:
    return f"coalesce(a.{column}, 0) - coalesce(b.{column}, 0)"


_DELTAS = (
    f"{_delta('statement_count')} AS statement_delta, {_delta('read_count')} AS read_delta,"
    f" {_delta('write_count')} AS write_delta,"
    " coalesce(len(a.temps), 0) - coalesce(len(b.temps), 0) AS temp_table_delta,"
    f" {_delta('risk_count')} AS risk_delta"
)


def _diff_sets(joined: bool) -> str:
    columns = []
    for name, column in _SETS.items():
        for change, left, right in (("added", "a", "b"), ("removed", "b", "a")):
            value = _difference(f"{left}.{column}", f"{right}.{column}")
            if joined:
                value = f"array_to_string({value}, ' | ')"
            columns.append(f"{value} AS {name}_{change}")
    return ", ".join(columns)


def _snapshot_analysis() -> dict[str, str]:
    changed = "CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey + 1) % 16 ELSE o_orderkey % 16 END"
    return {
        **analysis(short_modules(condition="o_orderkey % 11 <> 0"), "b_"),
        **analysis(short_modules(changed, "o_orderkey % 7 <> 0"), "a_"),
    }


_PRESENCE = (
    "CASE WHEN b.module_id IS NULL AND a.module_id IS NULL THEN 'missing' WHEN b.module_id IS NULL"
    " THEN 'added' WHEN a.module_id IS NULL THEN 'removed' ELSE 'paired' END AS presence"
)


def _diff_document() -> tuple[str, str]:
    """Markdown and JSON of a row of `d`, the compared pairs with their sets as lists."""

    def sets(*names: tuple[str, str]) -> list[str]:
        return [f"'### {title}\\n' || {_bullets(column)}" for title, column in names]

    # The headings.
    markdown = _text(
        "'# Module Diff Report\\n\\n## Overview\\n- Before: before/' || pair_id || '\\n- After: after/' || pair_id",
        "'\\n- Before Procedure: ' || coalesce(before_procedure, 'Unknown') || '\\n- After Procedure: ' || coalesce(after_procedure, 'Unknown')",
        "'\\n- Before Risk Level: ' || coalesce(before_risk_level, 'None') || '\\n- After Risk Level: ' || coalesce(after_risk_level, 'None')",
        "'\\n\\n## Change Summary\\n- Statement Delta: ' || statement_delta || '\\n- Read Delta: ' || read_delta || '\\n- Write Delta: ' || write_delta",
        "'\\n- Temp Table Delta: ' || temp_table_delta || '\\n- Risk Delta: ' || risk_delta || '\\n\\n## Parameter Changes\\n'",
        *sets(("Added", "parameters_added"), ("Removed", "parameters_removed")),
        "'\\n## Dependency Changes\\n'",
        *sets(("New Tables Read", "tables_read_added"), ("Removed Tables Read", "tables_read_removed")),
        *sets(("New Tables Written", "tables_written_added"), ("Removed Tables Written", "tables_written_removed")),
        *sets(("New Procedures Executed", "procedures_executed_added"), ("Removed Procedures Executed", "procedures_executed_removed")),
        "'\\n## Temp Table Changes\\n'",
        *sets(("New Temp Tables", "temp_tables_added"), ("Removed Temp Tables", "temp_tables_removed")),
        "'\\n## Risk Changes\\n'",
        *sets(("Added Risks", "risks_added"), ("Removed Risks", "risks_removed")),
        "'- Before Count: ' || before_risk_count || '\\n- After Count: ' || after_risk_count || '\\n'",
    )
    json = """CAST(to_json(struct_pack(
      overview := struct_pack(before_label := 'before/' || pair_id, after_label := 'after/' || pair_id, before_procedure := before_procedure,
        after_procedure := after_procedure, before_risk_level := before_risk_level, after_risk_level := after_risk_level),
      change_summary := struct_pack(statement_delta := statement_delta, read_delta := read_delta, write_delta := write_delta,
        temp_table_delta := temp_table_delta, risk_delta := risk_delta),
      parameter_changes := struct_pack(added := parameters_added, removed := parameters_removed),
      dependency_changes := struct_pack(new_tables_read := tables_read_added, removed_tables_read := tables_read_removed,
        new_tables_written := tables_written_added, removed_tables_written := tables_written_removed,
        new_procedures_executed := procedures_executed_added, removed_procedures_executed := procedures_executed_removed),
      temp_table_changes := struct_pack(added := temp_tables_added, removed := temp_tables_removed),
      risk_changes := struct_pack(added := risks_added, removed := risks_removed, before_count := before_risk_count,
        after_count := after_risk_count))) AS VARCHAR)"""
    return markdown, json


# Ten or more modules of one text, a third of all of the same.
REPEATED_MODULES = (
    "SELECT CAST(own AS VARCHAR) AS module_id, sql, count(*) OVER (PARTITION BY sql) AS copies FROM (SELECT own, sql FROM ("
    + short_modules("o_orderkey % 16").replace(
        "SELECT CAST(o_orderkey AS VARCHAR) AS module_id,", "SELECT own,"
    ).replace(
        "FROM orders",
        "FROM (SELECT o_orderkey AS own, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey // 40 END AS o_orderkey,"
        " '1998-10-03' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM orders)",
    )
    + "))"
)
DENSE_MODULES = (
    "SELECT CAST(o_orderkey // 8000 AS VARCHAR) AS module_id, 'CREATE PROC d.P AS' || string_agg("
    "' INSERT INTO d.T' || (o_orderkey % 997) || ' SELECT C FROM d.T' || (o_orderkey % 1009), ''"
    " ORDER BY o_orderkey) AS sql FROM orders GROUP BY 1"
)
NESTED_PARAMETERS = r"""
WITH m AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS module_id, CAST(o_orderkey % 40 + 1 AS INTEGER) AS depth,
    o_orderkey % 9 + 1 AS width FROM orders
)
SELECT module_id, 1 AS pos, '@a' AS name, 'INT' AS data_type,
  'f('')'', ' || repeat('g(', depth) || $$'x,=(', 1$$ || repeat(')', depth) || ')' AS default_value FROM m
UNION ALL SELECT module_id, 2, '@b', 'CHAR(' || width || ')', $$'=,'$$ FROM m
UNION ALL SELECT module_id, 3, '@c', 'INT', NULL FROM m
"""


def statements() -> dict[str, str]:
    short = {**analysis(short_modules()), **_documents()}
    configured = analysis(short_modules(), config=CONFIG)
    long = analysis(LONG_MODULES)
    dense = analysis(DENSE_MODULES)
    snapshots = _snapshot_analysis()
    masked = f"array_to_string(list_transform(regexp_extract_all(body, {q(LITERAL + "|[^']+")}), lambda t: CASE WHEN starts_with(t, '''') THEN regexp_replace(t, '[^\\n]', ' ', 'g') ELSE t END), '')"
    levels = (
        "count(*) AS scanned, count(*) FILTER (risk_level = 'High') AS high,"
        " count(*) FILTER (risk_level = 'Medium') AS medium, count(*) FILTER (risk_level = 'Low') AS low"
    )
    name_or_stem = "coalesce(name, module_id)"
    key = "trim(regexp_replace(lower(regexp_replace({}, '[^A-Za-z0-9_.-]', '_', 'g')), '_+', '_', 'g'), '_')"
    changes = " UNION ALL ".join(
        f"SELECT pair_id, '{name}' AS category, '{change}' AS change, unnest({name}_{change}) AS item FROM d"
        for name in _SETS
        for change in ("added", "removed")
    )
    pairs = (
        "(SELECT 'n' || o_orderkey AS pair_id, CAST(o_orderkey - 1 AS VARCHAR) AS before_id,"
        " CAST(o_orderkey AS VARCHAR) AS after_id FROM orders UNION ALL SELECT 'h' || o_orderkey, '1',"
        " CAST(o_orderkey AS VARCHAR) FROM orders)"
    )
    usage = ", ".join(
        f"count(*) FILTER (operation = '{o}') AS {c}"
        for o, c in (("Read", "readers"), ("Write", "writers"), ("Execute", "callers"))
    )
    short_queries = {
        "comment_stripping": "SELECT module_id, code FROM codes",
        "whitespace_collapse": f"SELECT module_id, trim(regexp_replace(sql, '\\s+', ' ', 'g'), {BLANK}) AS text FROM mods",
        "identifier_parts": "SELECT module_id, 'dbo.' || coalesce(name, 'x') AS from_name FROM bodies",
        "statement_split": "SELECT module_id, stmt_index, s AS statement FROM stmts",
        "literal_masking": f"SELECT module_id, {masked} AS masked FROM bodies",
        "rule_statements": "SELECT module_id, stmt_index, cleaned FROM cleaned",
        "summary_statements": "SELECT module_id, stmt_index, c AS cleaned, kind FROM summaries",
        "module_names": f"SELECT module_id, name, {name_or_stem} AS procedure FROM bodies",
        "module_bodies": "SELECT module_id, body FROM bodies",
        "parameter_list": "SELECT * FROM parameters",
        "dependency_list": "SELECT * FROM deps",
        "temp_table_list": "SELECT module_id, unnest(temps) AS name FROM bodies",
        "statement_list": 'SELECT module_id, "index", kind, target, array_to_string(sources, \',\') AS sources FROM statements',
        "statement_kinds": "SELECT kind, count(*) AS statements FROM statements GROUP BY 1",
        "findings_by_module": "SELECT * FROM findings",
        "findings_by_rule": "SELECT rule_id, severity, rank, count(*) AS modules FROM findings GROUP BY ALL",
        "module_metrics": "SELECT module_id, statement_count, read_count, write_count, risk_level FROM metrics",
        "module_index": f"SELECT module_id, module_id AS source_file, {key.format(name_or_stem)} || '.md' AS report_file, {name_or_stem} AS procedure, statement_count, read_count, write_count, len(temps) AS temp_table_count, risk_count, risk_level, risk_rules FROM metrics",
        "risk_summary": f"SELECT {levels} FROM metrics",
        "object_usage": f"SELECT object, {usage}, any_value(is_external) AS is_external FROM objects GROUP BY 1",
        "object_lists": "SELECT module_id, array_to_string(reads, ',') AS reads, array_to_string(writes, ',') AS writes, array_to_string(executes, ',') AS executes, array_to_string(external, ',') AS external FROM groups",
        "external_dependencies": "SELECT module_id, object, operation, source FROM deps WHERE is_external",
        "graph_nodes": f"SELECT {node('x')} AS node_id, min(replace(x, '\"', '''')) AS label FROM (SELECT coalesce(name, 'UNKNOWN_PROC') AS x FROM bodies UNION ALL SELECT object FROM deps) GROUP BY 1",
        "graph_edges": "SELECT DISTINCT CASE operation WHEN 'Read' THEN id ELSE proc END AS src, CASE operation WHEN 'Read' THEN proc ELSE id END AS dst, operation AS kind FROM dep_nodes",
        "pair_diff": f"SELECT pair_id, {_PRESENCE}, {_DELTAS}, array_to_string({_difference('a.reads', 'b.reads')}, ',') AS tables_read_added, array_to_string({_difference('b.reads', 'a.reads')}, ',') AS tables_read_removed FROM {pairs} p LEFT JOIN sides b ON b.module_id = before_id LEFT JOIN sides a ON a.module_id = after_id",
        "questions": "SELECT * FROM questions",
        "suggested_queries": "SELECT * FROM suggested",
        "execution_flow": "SELECT * FROM flows",
        "diagrams": "SELECT * FROM diagrams",
        "trace_json": f"SELECT module_id, {_TRACE_JSON} AS trace_json FROM docs",
        "context_json": f"SELECT module_id, {_CONTEXT_JSON} AS context_json FROM docs",
        "report_md": f"SELECT module_id, {key.format(name_or_stem)} AS report_key, {_report()} AS report_md FROM docs",
        "context_text": f"SELECT module_id, {_context()} AS context_text FROM docs",
    }
    result = {name: _with(short, select) for name, select in short_queries.items()}
    rewritten = analysis(
        short_modules("CASE WHEN o_orderkey % 10 = 0 THEN (o_orderkey + 1) % 16 ELSE o_orderkey % 16 END")
    )
    files = {**analysis(f"SELECT module_id, sql FROM ({FILES}) WHERE NOT bad"), "files": FILES}
    result["folder_scan"] = _with(
        files,
        "SELECT module_id AS path, coalesce(name, stem) AS procedure, statement_count,"
        " risk_rules AS rules FROM metrics JOIN files USING (module_id)",
    )
    result["folder_bad_files"] = f"SELECT module_id AS path FROM ({FILES}) WHERE bad"
    markdown, json = _diff_document()
    result["diff_documents"] = _with(
        {
            **snapshots,
            "d": "SELECT coalesce(a.module_id, b.module_id) AS pair_id, b.name AS before_procedure, a.name AS after_procedure,"
            f" b.risk_level AS before_risk_level, a.risk_level AS after_risk_level, {_DELTAS},"
            f" coalesce(b.risk_count, 0) AS before_risk_count, coalesce(a.risk_count, 0) AS after_risk_count, {_diff_sets(False)}"
            " FROM b_sides b FULL JOIN a_sides a USING (module_id)",
        },
        f"SELECT pair_id, {markdown} AS diff_md, {json} AS diff_json FROM d",
    )
    result["shared_texts"] = _with(
        {**analysis(f"SELECT module_id, sql FROM ({REPEATED_MODULES})"), "repeated": REPEATED_MODULES},
        f"SELECT module_id, {name_or_stem} AS procedure, statement_count, read_count, write_count, risk_level,"
        " risk_rules AS rules, copies FROM metrics JOIN repeated USING (module_id)",
    )
    edges = analysis(short_modules("(o_orderkey // 4) % 16", texts=EDGES))
    for name, select in {
        "edge_text": "SELECT module_id, code, body, coalesce(statements, '') AS statements FROM bodies LEFT JOIN"
        " (SELECT module_id, string_agg(s, '|' ORDER BY stmt_index) AS statements FROM stmts GROUP BY 1) USING (module_id)",
        "edge_names": "SELECT module_id, name, array_to_string(temps, ',') AS temps FROM bodies",
        "edge_parameters": "SELECT * FROM parameters",
        "edge_statements": short_queries["statement_list"],
        "edge_dependencies": "SELECT * FROM deps",
        "edge_findings": "SELECT * FROM findings",
    }.items():
        result[name] = _with(edges, select)
    again = f"SELECT module_id, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'DELETE FROM gone' ELSE sql END AS sql, stem, bad FROM (SELECT *, CAST(substr(stem, 2) AS BIGINT) AS k FROM ({ALL_FILES}))"
    kept = f"SELECT * FROM ({again}) WHERE NOT bad OR sql = 'DELETE FROM gone'"
    result["arrived_files"] = _with(
        {**analysis(f"SELECT module_id, sql FROM ({kept})"), "files": kept},
        "SELECT module_id AS path, coalesce(name, stem) AS procedure, risk_rules AS rules FROM metrics JOIN files USING (module_id)",
    )
    result["kept_findings"] = _with(rewritten, "SELECT module_id, rule_id, severity, rank FROM findings")
    result["kept_summary"] = _with(
        rewritten,
        "SELECT 'scanned' AS key, count(*)::BIGINT AS modules FROM metrics"
        " UNION ALL SELECT l, (SELECT count(*) FROM metrics WHERE risk_level = l)::BIGINT FROM (VALUES ('High'), ('Medium'), ('Low')) v(l)"
        " UNION ALL SELECT rule_id, count(*)::BIGINT FROM findings GROUP BY 1"
        " UNION ALL SELECT operation || ' ' || object, count(DISTINCT module_id)::BIGINT FROM deps GROUP BY 1",
    )
    result["published_index"] = _with(
        snapshots,
        f"SELECT module_id, module_id AS source_file, {key.format(name_or_stem)} || '.md' AS report_file, {name_or_stem} AS procedure,"
        " statement_count, read_count, write_count, len(temps) AS temp_table_count, risk_count, risk_level, risk_rules FROM a_metrics",
    )
    result["stored_index"], result["stored_reports"] = result["module_index"], result["report_md"]
    result.update(
        {
            "incremental_findings": _with(
                rewritten, "SELECT module_id, rule_id, severity, rank FROM findings"
            ),
            "latest_index": _with(
                rewritten,
                f"SELECT module_id, {name_or_stem} AS procedure, statement_count, read_count,"
                " write_count, risk_level FROM metrics",
            ),
            "nested_parameters": NESTED_PARAMETERS,
            "findings_with_config": _with(
                configured, "SELECT module_id, rule_id, severity, rank FROM findings"
            ),
            "risk_summary_with_config": _with(configured, f"SELECT {levels} FROM metrics"),
            "module_diff": _with(
                snapshots,
                f"SELECT coalesce(a.module_id, b.module_id) AS pair_id, {_PRESENCE},"
                " b.name AS before_procedure, a.name AS after_procedure,"
                " b.risk_level AS before_risk_level, a.risk_level AS after_risk_level,"
                f" {_DELTAS}, coalesce(b.risk_count, 0) AS before_risk_count,"
                f" coalesce(a.risk_count, 0) AS after_risk_count, {_diff_sets(True)}"
                " FROM b_sides b FULL JOIN a_sides a USING (module_id)",
            ),
            "diff_changes": _with(
                {
                    **snapshots,
                    "d": f"SELECT coalesce(a.module_id, b.module_id) AS pair_id, {_diff_sets(False)}"
                    " FROM b_sides b FULL JOIN a_sides a USING (module_id)",
                },
                changes,
            ),
            "long_module_text": _with(
                long,
                "SELECT module_id, length(code) AS code_chars, md5(code) AS code_md5,"
                " length(body) AS body_chars, len(texts) AS statements"
                " FROM bodies JOIN lists USING (module_id)",
            ),
            "chunked_text": _with(
                long,
                "SELECT module_id, length(code) AS code_chars, md5(code) AS code_md5, md5("
                + masked.replace("body", "code")
                + ") AS blanked_md5 FROM codes",
            ),
            "long_module_findings": _with(long, "SELECT module_id, rule_id, severity FROM findings"),
            "long_module_dependencies": _with(
                long, "SELECT module_id, ord, object, operation, source FROM deps"
            ),
            "dense_module_dependencies": _with(
                dense, "SELECT module_id, ord, object, operation, source FROM deps"
            ),
            "dense_module_usage": _with(
                dense,
                "SELECT object, " + ", ".join(
                    f"count(DISTINCT module_id) FILTER (operation = '{o}') AS {n}"
                    for o, n in (("Read", "readers"), ("Write", "writers"), ("Execute", "callers"))
                ) + " FROM deps GROUP BY 1",
            ),
            "report_keys": "SELECT p_partkey, "
            + key.format("'[' || p_name || '] #' || p_type || '.' || p_brand")
            + " AS report_key, p_name || '.v1' AS file_stem FROM part",
            "duplicate_keys": "SELECT l_orderkey, l_partkey, count(*) AS CNT FROM lineitem"
            " GROUP BY 1, 2 HAVING count(*) > 1",
            "duplicate_brands": "SELECT p_brand, count(*) AS CNT FROM part GROUP BY 1"
            " HAVING count(*) > 1",
            "preview_target": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"
            " ORDER BY o_orderkey LIMIT 100",
            "join_inflation": "SELECT o_orderkey AS key, count(*) AS n,"
            " round(any_value(o_totalprice), 2) AS detail_sum,"
            " round(sum(o_totalprice), 2) AS joined_sum FROM orders JOIN lineitem"
            " ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) > 1",
        }
    )
    return result
