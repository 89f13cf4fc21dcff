"""Risk rules: one predicate per rule over the prepared columns, and their catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.functions import patterns as P
from modlens.functions.core import bind, each, regex, text
from modlens.functions.text import clean_for_rules, drop_literals
from modlens.schemas import SEVERITY_RANK
from modlens.sources.config import RuleConfig


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    message: str
    suggestion: str
    predicate: str  # SQL text over body, temp_tables and the columns of with_rule_inputs


def _keywords(pattern: str, literal: str) -> str:
    # ``literal`` is part of all that the pattern finds. Looking for bytes in upper-case text
    # is cheap, so that the pattern runs on few modules.
    return f"(contains(upper_keywords, {text(literal)}) AND rlike(keywords, {regex(pattern)}))"


def _any_statement(pattern: str, literal: str) -> str:
    return (
        f"(contains(upper_keywords, {text(literal)})"
        f" AND exists(rule_statements, s -> rlike(s, {regex(pattern)})))"
    )


_HANDLED = (
    f"({_keywords(P.BEGIN_TRY, 'BEGIN TRY')} AND {_keywords(P.BEGIN_CATCH, 'BEGIN CATCH')})"
)


# Ids, severities and texts of the catalog.
RULES = [
    Rule(
        "select_star",
        "Low",
        "SELECT * found. This may make the procedure fragile when table schema changes.",
        "List required columns explicitly.",
        _keywords(P.SELECT_STAR, "*"),
    ),
    Rule(
        "nolock_used",
        "Medium",
        "NOLOCK found. Query may read dirty or uncommitted data.",
        "Verify whether dirty reads are acceptable for this procedure.",
        _keywords(P.NOLOCK, "NOLOCK"),
    ),
    Rule(
        "dynamic_sql",
        "Medium",
        "Dynamic SQL found. Static dependency detection may be incomplete.",
        "Review generated SQL string and validate runtime dependencies manually.",
        f"{_keywords(P.DYNAMIC_EXEC, '@')} OR {_keywords(P.EXECUTESQL, 'SP_EXECUTESQL')}",
    ),
    Rule(
        "linked_server",
        "Medium",
        "Linked server or four-part object reference found. External DB dependency should be "
        "verified.",
        "Verify linked server availability, permissions, and source data freshness.",
        f"{_keywords(P.THREE_DOTS, '.')} AND rlike(keywords, {regex(P.FOUR_PARTS)})",
    ),
    Rule(
        "update_without_where",
        "High",
        "UPDATE statement may be missing WHERE condition.",
        "Confirm this update is intended to affect all rows, or add a WHERE clause.",
        _any_statement(P.UPDATE_ALL, "UPDATE"),
    ),
    Rule(
        "delete_without_where",
        "High",
        "DELETE statement may be missing WHERE condition.",
        "Confirm this delete is intended to affect all rows, or add a WHERE clause.",
        _any_statement(P.DELETE_ALL, "DELETE"),
    ),
    Rule(
        "insert_select_no_distinct",
        "Medium",
        "INSERT INTO ... SELECT without DISTINCT or GROUP BY found. Duplicate rows may be "
        "inserted if source rows are duplicated.",
        "Verify source row uniqueness or add explicit duplicate prevention.",
        _any_statement(P.INSERT_SELECT_RAW, "INSERT"),
    ),
    Rule(
        "multi_join_aggregation",
        "High",
        "SUM/COUNT used with JOIN and GROUP BY. Aggregated values may be duplicated if join keys "
        "are not unique.",
        "Check join key uniqueness, pre-aggregate detail rows before joins, and verify whether "
        "additional keys such as MANIFEST_NO, ORDER_NO, or PART_NO are required.",
        f"{_keywords(P.JOIN, 'JOIN')} AND {_keywords(P.GROUP_BY, 'GROUP')}"
        f" AND {_keywords(P.SUM_OR_COUNT, '(')}",
    ),
    Rule(
        "cursor_used",
        "Medium",
        "CURSOR usage found. This may indicate row-by-row processing and performance risk.",
        "Check whether cursor logic can be replaced with set-based operations.",
        _keywords(P.CURSOR, "CURSOR"),
    ),
    Rule(
        "transaction_without_trycatch",
        "Medium",
        "Transaction found without TRY/CATCH error handling.",
        "Consider adding TRY/CATCH with COMMIT/ROLLBACK handling.",
        f"{_keywords(P.BEGIN_TRAN, 'BEGIN TRAN')} AND NOT {_HANDLED}",
    ),
    Rule(
        "trycatch_without_rollback",
        "High",
        "TRY/CATCH found without ROLLBACK. Failed transactions may remain open or partially "
        "applied.",
        "Verify transaction handling and add ROLLBACK in CATCH when appropriate.",
        f"{_HANDLED} AND NOT {_keywords(P.ROLLBACK, 'ROLLBACK')}",
    ),
    Rule(
        "hardcoded_date",
        "Low",
        "Hardcoded date literal found.",
        "Verify whether date should be parameterized.",
        f"contains(body, '\\'') AND rlike(body, {regex(P.DATE_LITERAL)})",
    ),
    Rule(
        "status_magic_number",
        "Low",
        "Status magic number found.",
        "Consider documenting status meaning or replacing with named constants/reference table.",
        _keywords(P.STATUS_NUMBER, "STATUS"),
    ),
    Rule(
        "temp_table_chain",
        "Low",
        "Multiple temp tables found. Procedure flow may be complex and order-dependent.",
        "Review temp table lifecycle and ensure intermediate data is deduplicated where needed.",
        "size(temp_tables) >= 3",
    ),
]


def active_rules(config: RuleConfig | None = None) -> list[tuple[Rule, str]]:
    """Enabled rules with their severity, in report order: severity down, then id."""
    config = config or RuleConfig()
    active = [
        (rule, config.severity_of(rule.rule_id) or rule.severity)
        for rule in RULES
        if config.is_enabled(rule.rule_id)
    ]
    return sorted(active, key=lambda r: (-SEVERITY_RANK[r[1]], r[0].rule_id))


def rule_catalog(spark: SparkSession, config: RuleConfig | None = None) -> DataFrame:
    """One row per enabled rule. At most as many rows as rules exist, so safe to broadcast."""
    rows = [
        (rule.rule_id, severity, SEVERITY_RANK[severity], rule.message, rule.suggestion)
        for rule, severity in active_rules(config)
    ]
    schema = "rule_id string, severity string, rank int, message string, suggestion string"
    if not rows:
        return spark.createDataFrame([], schema)
    # A VALUES list is a local table of the plan: no job and no Python worker to read it.
    values = ", ".join(
        f"({text(rule_id)}, {text(severity)}, {rank}, {text(message)}, {text(suggestion)})"
        for rule_id, severity, rank, message, suggestion in rows
    )
    return spark.sql(
        f"SELECT * FROM VALUES {values} AS t(rule_id, severity, rank, message, suggestion)"
    )


def with_rule_inputs(prepared: DataFrame) -> DataFrame:
    """Add ``keywords`` (body without literals), ``upper_keywords`` and ``rule_statements``
    (cleaned)."""
    cleaned = each("statement_texts", lambda s: clean_for_rules(drop_literals(s)))
    changes_data = " OR ".join(
        f"contains(upper_keywords, '{word}')" for word in ("UPDATE", "DELETE", "INSERT")
    )
    return (
        prepared.withColumn("keywords", F.expr(drop_literals("body")))
        .withColumn("upper_keywords", F.upper("keywords"))
        .withColumn(
            "rule_statements",
            F.expr(
                f"CASE WHEN {changes_data} THEN {cleaned} ELSE cast(array() AS array<string>) END"
            ),
        )
    )


def rule_ids(config: RuleConfig | None = None) -> Column:
    """Ids of the rules a module breaks. The order is fixed at plan time: no sort per row."""
    hits = [
        f"CASE WHEN {rule.predicate} THEN '{rule.rule_id}' END" for rule, _ in active_rules(config)
    ]
    if not hits:
        return F.array().cast("array<string>")
    return F.expr(f"array_compact(array({', '.join(hits)}))")


def risk_level(ids: Column, config: RuleConfig | None = None) -> Column:
    """Highest severity among ``ids``; they are ordered, so the first decides."""
    level = F.lit("Low")
    for severity in ("Medium", "High"):
        members = [rule.rule_id for rule, s in active_rules(config) if s == severity]
        if members:
            level = F.when(F.get(ids, F.lit(0)).isin(members), severity).otherwise(level)
    return level


def risks(ids: str, config: RuleConfig | None = None) -> Column:
    """In-row findings: the catalog entries of the array ``ids``, in report order."""
    active = active_rules(config)
    if not active:
        return F.array().cast(
            "array<struct<rule_id:string,severity:string,message:string,suggestion:string>>"
        )
    entries = ", ".join(
        f"named_struct('rule_id', {text(rule.rule_id)}, 'severity', {text(severity)},"
        f" 'message', {text(rule.message)}, 'suggestion', {text(rule.suggestion)})"
        for rule, severity in active
    )
    return F.expr(
        bind(ids, lambda i: f"filter(array({entries}), e -> array_contains({i}, e.rule_id))")
    )
