import pytest
from pyspark.sql import functions as F

from modlens import RuleConfig, analyze, findings, schemas
from modlens.functions import text
from modlens.operators.rules import RULES, active_rules, rule_catalog
from modlens.plans.corpus import TEMPLATES
from modlens.schemas import SEVERITY_RANK

# rule: texts that break it, texts that do not
MATRIX = {
    "select_star": (
        ["SELECT * FROM a", "select\n\t*", "SELECT 'x' * 2", "SELECT *"],
        ["SELECT a.* FROM a", "SELECT TOP 5 *", "XSELECT *", "PRINT 'SELECT *'", "-- SELECT *"],
    ),
    "nolock_used": (
        ["FROM a WITH (NOLOCK)", "with( nolock )"],
        ["FROM a (NOLOCK)", "WITH (NOLOCK, READPAST)", "'WITH (NOLOCK)'"],
    ),
    "dynamic_sql": (
        ["EXEC(@s)", "EXECUTE ( @s )", "EXEC sp_executesql @s", "sys.SP_EXECUTESQL"],
        ["EXEC p @a", "EXEC('SELECT 1')", "sp_executesql2", "XEXEC(@s)"],
    ),
    "linked_server": (
        ["FROM S.D.dbo.T", "FROM [S].[D].[dbo].[T]", "x = 1.2.3.4", "a.b.c.d.e", "é[a.b.c.d"],
        ["FROM D.dbo.T", "FROM S.D..T", "'S.D.dbo.T'", "[].[].[].[]", "éa.b.c."],
    ),
    "update_without_where": (
        [
            "UPDATE a SET b = 1",
            "BEGIN UPDATE a SET b = 'x WHERE y'",
            "UPDATE a SET b = 1 WHERE(c = 1)",
            "SELECT 1; update a\nset b = 1;",
        ],
        [
            "UPDATE a SET b = 1 WHERE c = 1",
            "UPDATE a SET b = 1\nWHERE c = 1",
            "UPDATE STATISTICS a",
            "SELECT 1 UPDATE a SET b = 1",
        ],
    ),
    "delete_without_where": (
        ["DELETE FROM a;", "BEGIN TRY DELETE a", "DELETE FROM a -- WHERE x\n"],
        ["DELETE FROM a WHERE b = 'WHERE'", "SELECT 1 DELETE FROM a", "'DELETE'"],
    ),
    "insert_select_no_distinct": (
        ["INSERT INTO a SELECT b FROM c", "insert into a\nselect b from c;"],
        [
            "INSERT INTO a SELECT DISTINCT b FROM c",
            "INSERT INTO a SELECT b FROM c GROUP BY b",
            "INSERT INTO a VALUES (1)",
            "INSERT a SELECT b FROM c",
        ],
    ),
    "multi_join_aggregation": (
        ["SELECT SUM(a) FROM b JOIN c ON 1=1 GROUP BY d", "count(x) join group\nby"],
        [
            "SELECT SUM (a) FROM b JOIN c ON 1=1 GROUP BY d",
            "SELECT SUM(a) FROM b GROUP BY d",
            "SELECT SUM(a) FROM b JOIN c ON 1=1",
            "SELECT SUM(a) FROM b JOINED c GROUP BY d",
        ],
    ),
    "cursor_used": (["DECLARE c CURSOR FOR x", "cursor"], ["@cursors", "'CURSOR'", "xCURSOR"]),
    "transaction_without_trycatch": (
        ["BEGIN TRAN; x", "begin transaction", "BEGIN TRAN BEGIN TRY x"],
        ["BEGIN  TRAN", "BEGIN TRAN BEGIN TRY x BEGIN CATCH", "COMMIT", "BEGIN TRY BEGIN CATCH"],
    ),
    "trycatch_without_rollback": (
        ["BEGIN TRY x END TRY BEGIN CATCH y END CATCH"],
        ["BEGIN TRY x BEGIN CATCH ROLLBACK", "BEGIN TRY x", "BEGIN CATCH x"],
    ),
    "hardcoded_date": (
        ["d = '2024-01-31'", "'''2024-01-31'"],
        ["'2024-1-31'", "2024-01-31", "'2024-01-31 00:00'", "-- '2024-01-31'"],
    ),
    "status_magic_number": (
        ["STATUS = 2", "t.status=12", "STATUS\n=\n3"],
        ["ORDER_STATUS = 2", "STATUS = 'x'", "STATUS <> 2", "'STATUS = 2'"],
    ),
    "temp_table_chain": (
        ["FROM #a, #b, ##c", "#a '#b' #c"],
        ["#a #a #a #b", "#a #b -- #c"],
    ),
}


def test_matrix_is_complete():
    assert list(MATRIX) == [r.rule_id for r in RULES]


def test_matrix(traces):
    texts = {}
    for rule, (broken, kept) in MATRIX.items():
        texts.update({f"{rule} + {i}": sql for i, sql in enumerate(broken)})
        texts.update({f"{rule} - {i}": sql for i, sql in enumerate(kept)})
    for key, trace in traces(texts).items():
        rule, sign, _ = key.split()
        assert (rule in trace.rule_ids) == (sign == "+"), (key, texts[key], trace.rule_ids)


# Findings of the 16 corpus templates.
TEMPLATE_FINDINGS = [
    [],
    ["multi_join_aggregation"],
    ["dynamic_sql"],
    ["linked_server"],
    ["nolock_used", "select_star"],
    ["update_without_where", "hardcoded_date", "status_magic_number"],
    ["delete_without_where"],
    ["insert_select_no_distinct", "temp_table_chain"],
    ["cursor_used"],
    ["transaction_without_trycatch"],
    ["trycatch_without_rollback"],
    ["hardcoded_date"],
    ["update_without_where"],
    ["dynamic_sql"],
    [],
    [],
]
TEMPLATE_STATEMENTS = [1, 1, 3, 1, 1, 2, 2, 3, 2, 3, 3, 1, 2, 3, 2, 2]


def test_templates(traces):
    found = traces({str(i): t.replace("{d}", "1998-10-03") for i, t in enumerate(TEMPLATES)})
    assert [found[str(i)].rule_ids for i in range(16)] == TEMPLATE_FINDINGS
    assert [len(found[str(i)].statements) for i in range(16)] == TEMPLATE_STATEMENTS


def test_config(traces, modules):
    sql = {"m": "SELECT * FROM a WITH (NOLOCK); UPDATE b SET c = 1"}
    assert traces(sql)["m"].rule_ids == ["update_without_where", "nolock_used", "select_star"]
    config = RuleConfig.from_json(
        '{"rules": {"select_star": false, "nolock_used": "HIGH", "update_without_where": "low",'
        ' "unknown": true}}'
    )
    trace = traces(sql, config)["m"]
    assert trace.rule_ids == ["nolock_used", "update_without_where"]
    assert trace.metrics.risk_level == "High"
    rows = findings(analyze(modules(sql), config), config).collect()
    assert {(r.rule_id, r.severity, r["rank"]) for r in rows} == {
        ("nolock_used", "High", 3),
        ("update_without_where", "Low", 1),
    }
    nothing = RuleConfig({r.rule_id: False for r in RULES})
    assert traces(sql, nothing)["m"].rule_ids == []
    assert findings(analyze(modules(sql), nothing), nothing).count() == 0


def test_config_forms(spark):
    known = [r.rule_id for r in RULES]
    rows = spark.createDataFrame(
        [
            ("select_star", False, None),
            ("nolock_used", True, "high"),
            ("cursor_used", None, "LOW"),
            ("other", True, "High"),
        ],
        schemas.RULE_CONFIG,
    )
    config = RuleConfig.from_dataframe(rows, known)
    assert dict(config.rules) == {
        "select_star": False,
        "nolock_used": "high",
        "cursor_used": "LOW",
    }
    assert RuleConfig.from_json("{}").rules == {}
    for bad in ("hIgH", 3, "urgent"):
        with pytest.raises(ValueError):
            RuleConfig({"select_star": bad})


def test_catalog_order(spark):
    active = active_rules()
    order = [(-SEVERITY_RANK[s], r.rule_id) for r, s in active]
    assert order == sorted(order)
    assert rule_catalog(spark).count() == 14


def test_dropped_literals_equal_blanked(spark):
    """The short form the rules read gives what the blanks of full length give."""
    cases = [sql for broken, kept in MATRIX.values() for sql in broken + kept]
    rows = spark.createDataFrame([(s,) for s in cases], "s string").coalesce(1)
    patterns = [r"(?i)SELECT\s+\*", r"(?i)BEGIN TRAN", r"(?i)STATUS\s*=\s*\d"]
    for pattern in patterns:
        same = F.expr(text.drop_literals("s")).rlike(pattern) == F.expr(
            text.blank_literals("s")
        ).rlike(pattern)
        assert rows.filter(~same).count() == 0


# Each rule's severity.
SEVERITIES = {
    "select_star": "Low",
    "nolock_used": "Medium",
    "dynamic_sql": "Medium",
    "linked_server": "Medium",
    "update_without_where": "High",
    "delete_without_where": "High",
    "insert_select_no_distinct": "Medium",
    "multi_join_aggregation": "High",
    "cursor_used": "Medium",
    "transaction_without_trycatch": "Medium",
    "trycatch_without_rollback": "High",
    "hardcoded_date": "Low",
    "status_magic_number": "Low",
    "temp_table_chain": "Low",
}


def test_catalog():
    from modlens.operators.rules import RULES

    assert {r.rule_id: r.severity for r in RULES} == SEVERITIES


def test_toml():
    from modlens import RuleConfig

    config = RuleConfig.from_toml('[rules]\nselect_star = false\nnolock_used = "High"\n')
    assert config == RuleConfig({"select_star": False, "nolock_used": "High"})
    assert RuleConfig.from_toml("") == RuleConfig()
