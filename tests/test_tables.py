import pytest
from golden import GOLDEN
from pyspark.sql import functions as F

from modlens import analyze, schemas
from modlens.operators import diff, graph, verify
from modlens.plans import documents, tables


@pytest.fixture(scope="module")
def corpus(modules):
    texts = {
        **GOLDEN,
        "empty": "",
        "unnamed": "EXEC shop.FindCart; SELECT 1 FROM [shop].[Carts] JOIN shop.Carts ON 1=1",
        "same": GOLDEN["basic"],
    }
    return analyze(modules(texts)).persist()


def test_index_agrees_with_child_tables(corpus):
    index = {r.module_id: r for r in tables.module_index(corpus).collect()}

    def counts(table, condition="true"):
        rows = table.filter(condition).groupBy("module_id").count().collect()
        return {r.module_id: r["count"] for r in rows}

    for column, found in {
        "statement_count": counts(tables.statements(corpus)),
        "read_count": counts(tables.dependencies(corpus), "operation = 'Read'"),
        "write_count": counts(tables.dependencies(corpus), "operation = 'Write'"),
        "temp_table_count": counts(tables.temp_tables(corpus)),
        "risk_count": counts(tables.findings(corpus)),
    }.items():
        assert {k: r[column] for k, r in index.items() if r[column]} == found, column
    # one table through FROM and JOIN counts twice, but is one object
    assert index["unnamed"].read_count == 2
    lists = {r.module_id: r for r in documents.object_lists(corpus).collect()}
    assert lists["unnamed"].reads == "shop.Carts"
    assert tables.risk_summary(corpus).first().asDict() == {
        "scanned": 11,
        "high": 3,
        "medium": 3,
        "low": 5,
    }


def test_object_usage(corpus):
    usage = {r.object: r for r in tables.object_usage(corpus).collect()}
    assert (usage["shop.Carts"].readers, usage["shop.Carts"].writers) == (3, 2)
    assert usage["shop.FindCart"].callers == 1
    assert usage["EASTHUB.Warehouse.dbo.Shelf"].is_external


def test_graph(corpus):
    nodes = {r.node_id: r.label for r in graph.graph_nodes(corpus).collect()}
    edges = {tuple(r) for r in graph.graph_edges(corpus).collect()}
    assert nodes["N_shop_FindCart"] == "shop.FindCart"
    assert nodes["N_UNKNOWN_PROC"] == "UNKNOWN_PROC"
    assert ("N_shop_Carts", "N_shop_FindCart", "Read") in edges
    assert ("N_shop_DropStale", "N_shop_Carts", "Write") in edges
    assert ("N_UNKNOWN_PROC", "N_shop_FindCart", "Execute") in edges
    assert {n for e in edges for n in e[:2]} <= set(nodes)
    diagrams = {r.module_id: r.diagram for r in documents.diagrams(corpus).collect()}
    assert diagrams["empty"].endswith("    %% No dependencies detected")
    # each node once, each edge as often as found
    assert diagrams["unnamed"].count('N_shop_Carts["') == 1
    assert diagrams["unnamed"].count("N_shop_Carts --> N_UNKNOWN_PROC") == 2


def test_diff_with_itself_is_empty(corpus):
    result = diff.diff_snapshots(corpus, corpus)
    assert result.filter("presence != 'paired'").count() == 0
    assert diff.diff_changes(result).count() == 0


def test_diff_direction(modules):
    before = analyze(
        modules(
            {
                "m": "CREATE PROC p @a INT AS SELECT 1 FROM old; SELECT 2 FROM both; EXEC q",
                "gone": "SELECT * FROM x",
            }
        )
    )
    after = analyze(
        modules(
            {
                "m": "CREATE PROC p @a INT = 1 AS SELECT * FROM new JOIN both ON 1=1 JOIN #t ON 1=1",
                "fresh": "UPDATE y SET a = 1",
            }
        )
    )
    result = diff.diff_snapshots(before, after)
    rows = {r.pair_id: r for r in result.collect()}
    m = rows["m"]
    assert m.tables_read_added == ["#t", "new"]
    assert m.tables_read_removed == ["old"]
    assert m.procedures_executed_removed == ["q"]
    assert m.parameters_added == ["@a INT = 1"] and m.parameters_removed == ["@a INT"]
    assert m.temp_tables_added == ["#t"]
    assert m.risks_added[0].startswith("select_star: SELECT * found.")
    assert (m.statement_delta, m.read_delta, m.risk_delta) == (-2, 1, 1)
    assert (rows["gone"].presence, rows["fresh"].presence) == ("removed", "added")
    assert rows["gone"].tables_read_removed == ["x"]
    assert rows["fresh"].after_risk_level == "High" and rows["fresh"].before_risk_level is None

    def items(changes, change):
        return {(r.pair_id, r.category, r.item) for r in changes.collect() if r.change == change}

    there = diff.diff_changes(result)
    back = diff.diff_changes(diff.diff_snapshots(after, before))
    assert items(there, "added") == items(back, "removed")
    assert items(there, "removed") == items(back, "added")


def test_diff_of_named_pairs(spark, corpus):
    pairs = spark.createDataFrame(
        [("1", "basic", "update"), ("2", "basic", "same"), ("3", "basic", "nowhere")],
        schemas.PAIRS,
    )
    rows = {r.pair_id: r for r in diff.diff_pairs(corpus, pairs).collect()}
    assert rows["1"].tables_written_added == ["shop.Carts"]
    assert rows["2"].presence == "paired" and rows["2"].tables_read_added == []
    assert rows["3"].presence == "removed"


def test_verification(spark):
    detail = spark.createDataFrame([(1, 10.0), (1, 5.0), (2, 1.0), (3, 2.0)], "k int, v double")
    other = spark.createDataFrame([(1,), (1,), (1,), (2,), (4,), (4,)], "k int")
    assert {tuple(r) for r in verify.duplicate_keys(other, ["k"]).collect()} == {(1, 3), (4, 2)}
    inflated = verify.join_inflation(detail, other, ["k"], "v").collect()
    assert [r.asDict() for r in inflated] == [
        {"k": 1, "detail_sum": 15.0, "n": 3, "joined_sum": 45.0}
    ]
    joined = detail.join(other, "k").groupBy("k").agg(F.sum("v").alias("s")).filter("k = 1")
    assert joined.first().s == 45.0
    assert [r.v for r in verify.preview(detail, 2, ["v"]).collect()] == [1.0, 2.0]
    assert verify.preview(detail, 3).count() == 3
