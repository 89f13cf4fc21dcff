import json

import pytest
from golden import EXPECTED, GOLDEN

from modlens import analyze
from modlens.plans import documents, tables


@pytest.fixture(scope="module")
def found(traces):
    return traces(GOLDEN)


@pytest.mark.parametrize("key", list(GOLDEN))
def test_golden_module(found, key):
    trace = found[key]
    name, parameters, deps, kinds, rules, level = EXPECTED[key]
    assert trace.name == name
    assert [tuple(p) for p in trace.parameters] == parameters
    assert [(d.object, d.operation, d.source) for d in trace.dependencies] == deps
    assert [s.kind for s in trace.statements] == kinds
    assert trace.rule_ids == rules
    assert trace.metrics.risk_level == level
    assert trace.metrics.statement_count == len(kinds)
    assert trace.metrics.read_count == sum(d[1] == "Read" for d in deps)
    assert trace.metrics.write_count == sum(d[1] == "Write" for d in deps)


def test_trace_document(modules):
    row = documents.trace_json(analyze(modules({"a": GOLDEN["aggregation"]}))).first()
    document = json.loads(row.trace_json)
    assert list(document) == [
        "name",
        "parameters",
        "dependencies",
        "temp_tables",
        "risks",
        "statements",
        "metrics",
    ]
    assert document["parameters"] == [
        {"name": "@ORDER_NO", "data_type": "VARCHAR(20)", "default_value": None}
    ]
    assert document["dependencies"][0] == {
        "object": "TB_T_GR_HUB",
        "operation": "Write",
        "source": "INSERT INTO",
    }
    assert document["statements"] == [
        {
            "index": 1,
            "kind": "Insert",
            "target": "TB_T_GR_HUB",
            "sources": ["TB_R_DAILY_ORDER_PART", "TB_R_DELIVERY_CTL_H", "TB_R_DELIVERY_CTL_D"],
        }
    ]
    assert document["metrics"] == {
        "statement_count": 1,
        "read_count": 3,
        "write_count": 1,
        "risk_level": "High",
    }
    assert document["risks"][0]["suggestion"].startswith("Check join key uniqueness")


# The published report of GOLDEN["aggregation"]: fixed values.
REPORT = """# Procedure Report: SP_GENERATE_GR_SAMPLE

## 1. Overview
- Procedure: SP_GENERATE_GR_SAMPLE
- Dialect: T-SQL
- Statements: 1
- Risk Level: High
- Read Tables: 3
- Written Tables: 1
- Temp Tables: 0
- Risk Findings: 1

## 2. Parameters
| Parameter | Type | Default |
|---|---|---|
| @ORDER_NO | VARCHAR(20) | Required |

## 3. Dependencies

### Tables Read
- TB_R_DAILY_ORDER_PART
- TB_R_DELIVERY_CTL_H
- TB_R_DELIVERY_CTL_D

### Tables Written
- TB_T_GR_HUB

### Procedures Executed
- None

### External Dependencies
- None

## 4. Temp Tables
- None

## 5. Dependency Diagram

```mermaid
flowchart LR
    N_SP_GENERATE_GR_SAMPLE["SP_GENERATE_GR_SAMPLE"]
    N_TB_T_GR_HUB["TB_T_GR_HUB"]
    N_SP_GENERATE_GR_SAMPLE --> N_TB_T_GR_HUB
    N_TB_R_DAILY_ORDER_PART["TB_R_DAILY_ORDER_PART"]
    N_TB_R_DAILY_ORDER_PART --> N_SP_GENERATE_GR_SAMPLE
    N_TB_R_DELIVERY_CTL_H["TB_R_DELIVERY_CTL_H"]
    N_TB_R_DELIVERY_CTL_H --> N_SP_GENERATE_GR_SAMPLE
    N_TB_R_DELIVERY_CTL_D["TB_R_DELIVERY_CTL_D"]
    N_TB_R_DELIVERY_CTL_D --> N_SP_GENERATE_GR_SAMPLE
```

## 6. Execution Flow
1. Reads from `TB_R_DAILY_ORDER_PART`, `TB_R_DELIVERY_CTL_H`, `TB_R_DELIVERY_CTL_D`
2. Writes to `TB_T_GR_HUB`

## 7. Risk Findings

### High: multi_join_aggregation
SUM/COUNT used with JOIN and GROUP BY. Aggregated values may be duplicated if join keys are not unique.

Suggestion: Check join key uniqueness, pre-aggregate detail rows before joins, and verify whether additional keys such as MANIFEST_NO, ORDER_NO, or PART_NO are required.

## 8. Questions to Verify
- Is PART_NO unique per ORDER_NO?
- Should MANIFEST_NO be part of the join key?
- Should quantity be pre-aggregated before joining master data?

## 9. Suggested Next Queries
```sql
SELECT ORDER_NO, PART_NO, COUNT(*) AS CNT
FROM TB_R_DAILY_ORDER_PART
GROUP BY ORDER_NO, PART_NO
HAVING COUNT(*) > 1;
```
"""


def test_report(modules):
    row = documents.report_md(analyze(modules({"a": GOLDEN["aggregation"]}))).first()
    assert row.report_key == "sp_generate_gr_sample"
    assert row.report_md == REPORT


def test_context_documents(modules):
    found = analyze(modules(GOLDEN))
    texts = {r.module_id: r.context_text for r in documents.context_text(found).collect()}
    assert (
        "has 1 statements, reads 1 table, writes 0 tables, uses 0 temp tables, and raises 2 risk"
        " findings." in texts["nolock"]
    )
    assert "- [Low] select_star: SELECT * found." in texts["nolock"]
    assert "## Suspicious Logic\n- None detected.\n" in texts["basic"]
    contexts = {
        r.module_id: json.loads(r.context_json) for r in documents.context_json(found).collect()
    }
    assert contexts["linked"]["dependencies"]["external"] == [
        "EASTHUB.Warehouse.dbo.Shelf"
    ]
    assert contexts["update"]["suggested_queries"] == [
        "SELECT TOP 100 *\nFROM shop.Carts;"
    ]
    assert contexts["basic"]["questions"] == [
        "Does the current dependency graph match the intended business flow?"
    ]


def test_index_order(modules):
    rows = tables.ranked_index(analyze(modules(GOLDEN))).collect()
    assert [r.module_id for r in rows] == [
        "aggregation",  # High, by procedure name
        "update",
        "edge",
        "dynamic",  # Medium
        "nolock",
        "linked",
        "delete_join",  # Low
        "basic",
    ]
    assert rows[0].source_file == "/src/aggregation.sql"
    assert rows[0].report_file == "sp_generate_gr_sample.md"
