"""Documents per module, built in the module's own row: JSON, report, diagram, context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.functions.core import bind, bullet_list, each, text, where, zipped
from modlens.functions.identifiers import is_external, node_id, node_label, report_key
from modlens.operators.dependencies import objects_of
from modlens.operators.graph import module_node
from modlens.operators.rules import risks
from modlens.sources.config import RuleConfig

# Questions and the rules that raise them.
QUESTIONS = [
    ("Is PART_NO unique per ORDER_NO?", ["multi_join_aggregation"]),
    ("Should MANIFEST_NO be part of the join key?", ["multi_join_aggregation"]),
    (
        "Should quantity be pre-aggregated before joining master data?",
        ["multi_join_aggregation"],
    ),
    (
        "Is the full-table update/delete intentional?",
        ["update_without_where", "delete_without_where"],
    ),
    (
        "Should a WHERE clause be added to narrow the affected rows?",
        ["update_without_where", "delete_without_where"],
    ),
    ("What runtime object names are injected into the dynamic SQL?", ["dynamic_sql"]),
    ("Can the dynamic SQL be replaced with a static query?", ["dynamic_sql"]),
    ("Is the linked server available and trusted in all environments?", ["linked_server"]),
    ("Does this external dependency affect freshness or latency?", ["linked_server"]),
    (
        "Is transaction rollback handled correctly on error?",
        ["transaction_without_trycatch", "trycatch_without_rollback"],
    ),
    ("Can the query list explicit columns instead of SELECT *?", ["select_star"]),
]
DEFAULT_QUESTION = "Does the current dependency graph match the intended business flow?"


def _broken(*rules: str) -> str:
    return f"arrays_overlap(rule_ids, array({', '.join(text(r) for r in rules)}))"


def _compact(*items: str) -> str:
    return where(f"array({', '.join(items)})", lambda i: f"{i} IS NOT NULL")


def _questions() -> str:
    # Sorted here, so that no row is.
    asked = _compact(
        *[f"CASE WHEN {_broken(*rules)} THEN {text(q)} END" for q, rules in sorted(QUESTIONS)]
    )
    return bind(
        asked, lambda a: f"CASE WHEN size({a}) = 0 THEN array({text(DEFAULT_QUESTION)}) ELSE {a} END"
    )


def _suggested_queries() -> str:
    source = "coalesce(get(reads, 0), '<SOURCE_TABLE>')"
    target = "coalesce(get(writes, 0), '<TARGET_TABLE>')"
    duplicates = (
        f"concat('SELECT ORDER_NO, PART_NO, COUNT(*) AS CNT\\nFROM ', {source},"
        " '\\nGROUP BY ORDER_NO, PART_NO\\nHAVING COUNT(*) > 1;')"
    )
    preview = f"concat('SELECT TOP 100 *\\nFROM ', {target}, ';')"
    inspect = "'-- Inspect the generated SQL string before execution\\n-- PRINT @SQL;'"
    return _compact(
        f"CASE WHEN {_broken('multi_join_aggregation')} THEN {duplicates} END",
        f"CASE WHEN {_broken('update_without_where', 'delete_without_where')} THEN {preview} END",
        f"CASE WHEN {_broken('dynamic_sql')} THEN {inspect} END",
    )


def _flow() -> str:
    def step(verb: str, items: str) -> str:
        return (
            f"CASE WHEN size({items}) > 0"
            f" THEN concat('{verb} `', array_join({items}, '`, `'), '`') END"
        )

    steps = _compact(
        step("Reads from", "reads"),
        step("Uses temp tables", "temp_tables"),
        step("Writes to", "writes"),
        step("Calls", "executes"),
    )
    return bind(
        steps,
        lambda s: f"CASE WHEN size({s}) = 0 THEN '1. No explicit flow detected.' ELSE array_join("
        + each(s, lambda line, i: f"concat({i} + 1, '. ', {line})", index=True)
        + ", '\\n') END",
    )


def _diagram() -> str:
    def node(identifier: str, label: str) -> str:
        return f"concat('    ', {identifier}, '[\"', {node_label(label)}, '\"]')"

    def first_places(ids: str) -> str:
        """For each id whether it stands there for the first time; by sorting, not by search."""
        placed = each(ids, lambda x, i: f"named_struct('id', {x}, 'at', {i})", index=True)

        def flags(found: str) -> str:
            flagged = zipped(
                found,
                f"concat(array(cast(null AS string)), transform({found}, k -> k.id))",
                lambda k, last: f"CASE WHEN {k}.id IS NOT NULL"
                f" THEN named_struct('at', {k}.at, 'first', NOT ({k}.id <=> {last})) END",
            )
            return f"transform(sort_array(filter({flagged}, k -> k IS NOT NULL)), k -> k.first)"

        return bind(f"sort_array({placed})", flags)

    def lines(procedure: str, ids: str) -> str:
        def line(d: str, i: str, first: str) -> str:
            this = f"{ids}[{i}]"
            named = f"{this} != {procedure} AND {first}[{i}]"
            return (
                f"concat(CASE WHEN {named} THEN concat({node(this, f'{d}.object')}, '\\n')"
                f" ELSE '' END, CASE {d}.operation"
                f" WHEN 'Read' THEN concat('    ', {this}, ' --> ', {procedure})"
                f" WHEN 'Write' THEN concat('    ', {procedure}, ' --> ', {this})"
                f" ELSE concat('    ', {procedure}, ' -. executes .-> ', {this}) END)"
            )

        return bind(
            first_places(ids),
            lambda first: each("dependencies", lambda d, i: line(d, i, first), index=True),
        )

    empty = "array('    %% No dependencies detected')"
    body = bind(
        node_id(module_node("name")),
        lambda p: bind(
            each("dependencies", lambda d: node_id(f"{d}.object")),
            lambda ids: f"concat(array('flowchart LR', {node(p, module_node('name'))}),"
            f" CASE WHEN size(dependencies) = 0 THEN {empty} ELSE {lines(p, ids)} END)",
        ),
    )
    return f"array_join({body}, '\\n')"


def with_document_parts(traces: DataFrame, config: RuleConfig | None = None) -> DataFrame:
    """Add ``reads, writes, executes, external, risks, questions, suggested_queries, flow,
    diagram``."""
    outside = where("dependencies", lambda d: is_external(f"{d}.object"))
    return (
        traces.withColumns(
            {
                "reads": F.expr(objects_of("dependencies", "Read")),
                "writes": F.expr(objects_of("dependencies", "Write")),
                "executes": F.expr(objects_of("dependencies", "Execute")),
                "external": F.expr(f"array_distinct({each(outside, lambda d: f'{d}.object')})"),
                "risks": risks("rule_ids", config),
                "questions": F.expr(_questions()),
                "diagram": F.expr(_diagram()),
            }
        )
        .withColumn("suggested_queries", F.expr(_suggested_queries()))
        .withColumn("flow", F.expr(_flow()))
    )


_KEEP_NULLS = {"ignoreNullFields": "false"}


def trace_json(traces: DataFrame, config: RuleConfig | None = None) -> DataFrame:
    """The whole trace as one JSON document per module."""
    document = F.struct(
        "name",
        "parameters",
        F.expr(
            "transform(dependencies, d -> named_struct('object', d.object,"
            " 'operation', d.operation, 'source', d.source))"
        ).alias("dependencies"),
        "temp_tables",
        risks("rule_ids", config).alias("risks"),
        "statements",
        "metrics",
    )
    return traces.select("module_id", F.to_json(document, _KEEP_NULLS).alias("trace_json"))


def context_json(traces: DataFrame, config: RuleConfig | None = None) -> DataFrame:
    """Summary, object lists, findings, questions and queries as JSON."""
    document = F.struct(
        F.col("name").alias("procedure"),
        F.struct(
            F.col("metrics.statement_count").alias("statement_count"),
            F.size("reads").alias("read_count"),
            F.size("writes").alias("write_count"),
            F.size("temp_tables").alias("temp_table_count"),
            F.size("risks").alias("risk_count"),
            F.col("metrics.risk_level").alias("risk_level"),
        ).alias("summary"),
        F.struct("reads", "writes", "executes", "external").alias("dependencies"),
        "temp_tables",
        "risks",
        "questions",
        "suggested_queries",
    )
    return with_document_parts(traces, config).select(
        "module_id", F.to_json(document, _KEEP_NULLS).alias("context_json")
    )


def diagrams(traces: DataFrame) -> DataFrame:
    return with_document_parts(traces).select("module_id", "diagram")


def _sql_blocks() -> str:
    blocks = each("suggested_queries", lambda q: f"concat('```sql\\n', {q}, '\\n```\\n')")
    return (
        "CASE WHEN size(suggested_queries) = 0 THEN '- No specific query suggested.\\n'"
        f" ELSE array_join({blocks}, '') END"
    )


def _concat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


_NAME = "coalesce(name, 'Unknown')"


def report_md(traces: DataFrame, config: RuleConfig | None = None) -> DataFrame:
    """Markdown report per module, with the output key to store it under."""
    rows = each(
        "parameters",
        lambda p: f"concat('| ', {p}.name, ' | ', {p}.data_type, ' | ',"
        f" coalesce({p}.default_value, 'Required'), ' |\\n')",
    )
    found = each(
        "risks",
        lambda r: f"concat('\\n### ', {r}.severity, ': ', {r}.rule_id, '\\n', {r}.message,"
        f" '\\n\\nSuggestion: ', {r}.suggestion, '\\n')",
    )
    # The report's headings.
    report = _concat(
        f"'# Procedure Report: ', {_NAME}, '\\n\\n'",
        f"'## 1. Overview\\n- Procedure: ', {_NAME}, '\\n- Dialect: T-SQL\\n- Statements: '",
        "metrics.statement_count, '\\n- Risk Level: ', metrics.risk_level",
        "'\\n- Read Tables: ', size(reads), '\\n- Written Tables: ', size(writes)",
        "'\\n- Temp Tables: ', size(temp_tables), '\\n- Risk Findings: ', size(risks), '\\n\\n'",
        "'## 2. Parameters\\n| Parameter | Type | Default |\\n|---|---|---|\\n'",
        f"CASE WHEN size(parameters) = 0 THEN '| None | - | - |\\n' ELSE array_join({rows}, '') END",
        f"'\\n## 3. Dependencies\\n\\n### Tables Read\\n', {bullet_list('reads')}",
        f"'\\n### Tables Written\\n', {bullet_list('writes')}",
        f"'\\n### Procedures Executed\\n', {bullet_list('executes')}",
        f"'\\n### External Dependencies\\n', {bullet_list('external')}",
        f"'\\n## 4. Temp Tables\\n', {bullet_list('temp_tables')}",
        "'\\n## 5. Dependency Diagram\\n\\n```mermaid\\n', diagram, '\\n```\\n\\n'",
        "'## 6. Execution Flow\\n', flow, '\\n\\n## 7. Risk Findings\\n'",
        f"CASE WHEN size(risks) = 0 THEN '- None detected.\\n' ELSE array_join({found}, '') END",
        f"'\\n## 8. Questions to Verify\\n', {bullet_list('questions')}",
        f"'\\n## 9. Suggested Next Queries\\n', {_sql_blocks()}",
    )
    return with_document_parts(traces, config).select(
        "module_id",
        F.expr(report_key("procedure")).alias("report_key"),
        F.expr(report).alias("report_md"),
    )


def context_text(traces: DataFrame, config: RuleConfig | None = None) -> DataFrame:
    """The context document as Markdown text."""

    def counted(items: str, singular: str, plural: str) -> str:
        noun = f"CASE WHEN size({items}) = 1 THEN '{singular}' ELSE '{plural}' END"
        return noun

    found = each(
        "risks",
        lambda r: f"concat('- [', {r}.severity, '] ', {r}.rule_id, ': ', {r}.message, '\\n')",
    )
    context = _concat(
        f"'# AI Context for Stored Procedure Analysis\\n\\n## Procedure\\n', {_NAME}",
        "'\\n\\n## Summary\\nThis procedure has ', metrics.statement_count, ' statements, reads '",
        f"size(reads), ' ', {counted('reads', 'table', 'tables')}, ', writes '",
        f"size(writes), ' ', {counted('writes', 'table', 'tables')}, ', uses '",
        f"size(temp_tables), ' temp ', {counted('temp_tables', 'table', 'tables')}",
        f"', and raises ', size(risks), ' risk ', {counted('risks', 'finding', 'findings')}",
        f"'.\\n\\n## Extracted Dependencies\\n### Tables Read\\n', {bullet_list('reads')}",
        f"'\\n### Tables Written\\n', {bullet_list('writes')}",
        f"'\\n### Procedures Executed\\n', {bullet_list('executes')}",
        f"'\\n### Temp Tables\\n', {bullet_list('temp_tables')}, '\\n## Suspicious Logic\\n'",
        f"CASE WHEN size(risks) = 0 THEN '- None detected.\\n' ELSE array_join({found}, '') END",
        f"'\\n## Ask\\n', {bullet_list('questions')}",
        f"'\\n## Suggested Verification Queries\\n', {_sql_blocks()}",
    )
    return with_document_parts(traces, config).select(
        "module_id", F.expr(context).alias("context_text")
    )


def questions(traces: DataFrame) -> DataFrame:
    """Questions to verify, one row each, in their order."""
    asked = traces.select("module_id", F.posexplode_outer(F.expr(_questions())).alias("pos", "q"))
    return asked.filter(F.col("q").isNotNull()).select(
        "module_id", (F.col("pos") + 1).alias("pos"), F.col("q").alias("question")
    )


def suggested_queries(traces: DataFrame) -> DataFrame:
    """Suggested verification queries, one row each, in their order."""
    asked = with_document_parts(traces).select(
        "module_id", F.posexplode_outer("suggested_queries").alias("pos", "q")
    )
    return asked.filter(F.col("q").isNotNull()).select(
        "module_id", (F.col("pos") + 1).alias("pos"), F.col("q").alias("query")
    )


def object_lists(traces: DataFrame) -> DataFrame:
    """Distinct objects of a module by role, in order of first reference."""
    parts = with_document_parts(traces)
    return parts.select(
        "module_id",
        *[
            F.array_join(c, ",").alias(c)
            for c in ("reads", "writes", "executes", "external")
        ],
    )


def flows(traces: DataFrame) -> DataFrame:
    return with_document_parts(traces).select("module_id", "flow")


# The headings of a diff's sections, and the sets below them.
_DIFF_SECTIONS = [
    ("Parameter Changes", [("Added", "parameters_added"), ("Removed", "parameters_removed")]),
    (
        "Dependency Changes",
        [
            ("New Tables Read", "tables_read_added"),
            ("Removed Tables Read", "tables_read_removed"),
            ("New Tables Written", "tables_written_added"),
            ("Removed Tables Written", "tables_written_removed"),
            ("New Procedures Executed", "procedures_executed_added"),
            ("Removed Procedures Executed", "procedures_executed_removed"),
        ],
    ),
    (
        "Temp Table Changes",
        [("New Temp Tables", "temp_tables_added"), ("Removed Temp Tables", "temp_tables_removed")],
    ),
    ("Risk Changes", [("Added Risks", "risks_added"), ("Removed Risks", "risks_removed")]),
]


def diff_documents(diff: DataFrame, before_label: str = "pair_id", after_label: str = "pair_id") -> DataFrame:
    """``pair_id, diff_md, diff_json``: each compared pair as Markdown and as JSON.

    The labels are SQL expressions over the diff's columns. A side that is not there has the
    procedure ``Unknown`` and the level ``None`` in Markdown, and nulls in JSON.
    """
    overview = [
        ("Before", before_label),
        ("After", after_label),
        ("Before Procedure", "coalesce(before_procedure, 'Unknown')"),
        ("After Procedure", "coalesce(after_procedure, 'Unknown')"),
        ("Before Risk Level", "coalesce(before_risk_level, 'None')"),
        ("After Risk Level", "coalesce(after_risk_level, 'None')"),
    ]
    deltas = ["statement", "read", "write", "temp_table", "risk"]
    summary = [(f"{d.replace('_', ' ').title()} Delta", f"{d}_delta") for d in deltas]

    def lines(items: list[tuple[str, str]]) -> str:
        return _concat(*[f"'- {title}: ', {value}, '\\n'" for title, value in items])

    parts = ["'# Module Diff Report\\n\\n## Overview\\n'", lines(overview), "'\\n## Change Summary\\n'", lines(summary)]
    for title, sets in _DIFF_SECTIONS:
        parts.append(f"'\\n## {title}\\n'")
        parts += [f"'### {heading}\\n', {bullet_list(items)}" for heading, items in sets]
    parts.append("'- Before Count: ', before_risk_count, '\\n- After Count: ', after_risk_count, '\\n'")

    def changes(name: str) -> F.Column:
        return F.struct(F.col(f"{name}_added").alias("added"), F.col(f"{name}_removed").alias("removed"))

    document = F.struct(
        F.struct(
            F.expr(before_label).alias("before_label"),
            F.expr(after_label).alias("after_label"),
            "before_procedure",
            "after_procedure",
            "before_risk_level",
            "after_risk_level",
        ).alias("overview"),
        F.struct(*[f"{d}_delta" for d in deltas]).alias("change_summary"),
        changes("parameters").alias("parameter_changes"),
        F.struct(
            *[
                F.col(f"{name}_{change}").alias(f"{new}_{name}")
                for name in ("tables_read", "tables_written", "procedures_executed")
                for change, new in (("added", "new"), ("removed", "removed"))
            ]
        ).alias("dependency_changes"),
        changes("temp_tables").alias("temp_table_changes"),
        F.struct(
            F.col("risks_added").alias("added"),
            F.col("risks_removed").alias("removed"),
            F.col("before_risk_count").alias("before_count"),
            F.col("after_risk_count").alias("after_count"),
        ).alias("risk_changes"),
    )
    return diff.select(
        "pair_id",
        F.expr(_concat(*parts)).alias("diff_md"),
        F.to_json(document, _KEEP_NULLS).alias("diff_json"),
    )
