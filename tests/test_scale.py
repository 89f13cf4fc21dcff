"""Long and dense modules stay affordable, and plans keep their shape."""

import re
import time

import pytest
from pyspark.sql import functions as F

from modlens import analyze
from modlens.functions import core, patterns
from modlens.operators.diff import diff_modules
from modlens.plans import corpus, documents, tables
from modlens.streaming.incremental import latest_traces

LONG = {
    "no_hit": "lorem ipsum dolor sit amet " * 20_000,
    "words": "abcdefgh" * 50_000,
    "blanks": "SELECT" + " " * 300_000 + "1",
    "quotes": "UPDATE t SET a = '" + "''" * 100_000 + "'",
    "open_quote": "SELECT '" + "x" * 300_000,
    "comment": "/*" + "* /" * 100_000 + "*/ SELECT 1",
    "open_comment": "/*" + "* /" * 100_000,
    "brackets": "[" * 100_000 + "]" * 100_000,
    "mixed_brackets": "a[b" * 100_000,
    "dots": "a.b." * 75_000,
    "dense": " ".join(f"FROM t{i % 50_000}" for i in range(60_000)),
    "writes": " ".join(f"INSERT INTO t{i} SELECT 1 FROM s{i}" for i in range(5_000)),
    "statements": "INSERT INTO t VALUES (1);\n" * 20_000,
    "lines": "GO\n" * 50_000,
    "keywords": "FROM " * 60_000,
    "creates": "CREATE PROC " * 30_000,
    "as": "CREATE PROC p " + "EXECUTE AS x " * 30_000,
    "parens": "CREATE PROC p @a t" + "(" * 50_000 + " AS SELECT 1",
    "commas": "CREATE PROC p " + ", ".join(f"@p{i} INT = {i}" for i in range(10_000)) + " AS x",
}


@pytest.mark.parametrize("key", list(LONG))
def test_long_module(traces, key):
    started = time.time()
    trace = traces({key: LONG[key]})[key]
    assert time.time() - started < 40
    if key == "dense":
        assert trace.metrics.read_count == 50_000
    if key == "writes":
        assert trace.metrics.read_count == trace.metrics.write_count == 5_000
    if key == "statements":
        assert trace.metrics.statement_count == 20_000 and trace.metrics.write_count == 1
    if key == "quotes":
        assert trace.rule_ids == ["update_without_where"]
    if key == "commas":
        assert len(trace.parameters) == 10_000


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_analysis_needs_no_shuffle(modules):
    traces = analyze(modules({"m": "SELECT 1"}))
    assert "Exchange" not in plan(traces)
    for table in (tables.dependencies, tables.statements, tables.parameters):
        assert "Exchange" not in plan(table(traces))
    findings = plan(tables.findings(traces))
    assert "BroadcastExchange" in findings and "hashpartitioning" not in findings


def test_text_is_analyzed_once(modules):
    """No step is evaluated a second time in an inferred filter or an inlined projection."""
    traces = analyze(modules({"m": "SELECT 1"}))
    for table in (tables.findings, tables.dependencies, tables.module_index, tables.object_usage):
        text = plan(table(traces))
        statements = "(?=\\n|\\z)"  # the end of the statement pattern only
        assert text.count(statements) == 1, table


def test_unused_steps_are_pruned(modules):
    traces = analyze(modules({"m": "SELECT 1"}))
    assert "MERGE" not in plan(tables.findings(traces).select("module_id", "rule_id"))
    names = plan(traces.select("module_id", "name"))
    assert "NOLOCK" not in names and "MERGE" not in names


def test_scan_reads_needed_columns(spark):
    modules = corpus.short_modules(spark, "/root/testdata/sf0.001")
    text = plan(tables.risk_summary(analyze(modules)))
    assert "o_totalprice" not in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>" in text


def nested(depth):
    calls = "g(" * depth + "1, 2" + ")" * depth
    return f"CREATE PROC p @a INT = f(')', {calls}), @b INT AS SELECT 1"


@pytest.mark.parametrize("depth", [1, 7, 8, 9, 10, 40, 2000, 80_000])
def test_parameters_nest_to_any_depth(modules, depth):
    started = time.time()
    found = analyze(modules({"m": nested(depth)})).select("parameters").first().parameters
    assert time.time() - started < 20
    assert [(p.name, p.data_type) for p in found] == [("@a", "INT"), ("@b", "INT")]
    assert found[0].default_value == nested(depth)[len("CREATE PROC p @a INT = ") : -len(", @b INT AS SELECT 1")]


def test_brackets_of_one_kind_are_one_step():
    """Forty brackets in a row are one run, so that a walk over the runs does not grow with the depth."""
    pattern = patterns.BRACKET_RUNS.replace(r"\z", r"\Z")  # as Python writes it
    runs = [m.group() for m in re.finditer(pattern, "f(')', " + "g(" * 40 + "'x(', 1" + ")" * 40 + ", b) c = (d")]
    assert runs == ["f(", "')', g", "(" + "g(" * 39, "'x(', 1", ")" * 40, ", b", ")", " c = ", "(", "d"]


OF_MANY = {
    "dependencies": tables.dependencies,
    "usage": tables.object_usage,
    "diagrams": documents.diagrams,
    "lists": documents.object_lists,
    "flows": documents.flows,
    "report": documents.report_md,
    "trace": documents.trace_json,
    "context": documents.context_json,
    "context_text": documents.context_text,
}


@pytest.mark.parametrize("name", list(OF_MANY))
def test_time_follows_the_number_of_references(modules, name):
    def seconds(n):
        text = " ".join(f"INSERT INTO t{i} SELECT 1 FROM t{i + 1}" for i in range(n // 2))
        frame = OF_MANY[name](analyze(modules({"m": text})))
        started = time.time()
        frame.write.format("noop").mode("overwrite").save()
        return time.time() - started

    seconds(2_000)
    few = max(1.0, seconds(20_000))
    assert seconds(40_000) < 3 * few


def test_latest_traces_read_what_is_needed(spark, modules, tmp_path):
    """Columns that are not asked for are neither read nor shuffled."""
    for k, sql in enumerate(("SELECT * FROM t", "DELETE FROM t")):
        analyze(modules({"m": sql})).withColumn("arrived", F.lit(k).cast("timestamp")).write.mode("append").parquet(str(tmp_path / "t"))
    latest = latest_traces(spark.read.parquet(str(tmp_path / "t")), ("rule_ids",))
    assert [(r.module_id, r.rule_ids) for r in latest.collect()] == [("m", ["delete_without_where"])]
    assert "statements" not in plan(latest) and "dependencies" not in plan(latest)


def test_changed_modules_are_analyzed_by_many_tasks(modules):
    """Adaptive execution joins small partitions of text unless their number is given."""
    text = plan(diff_modules(modules({"m": "SELECT 1"}), modules({"m": "SELECT 2"})))
    assert "hashpartitioning(module_id#" in text and "REPARTITION_BY_NUM" in text and "ENSURE_REQUIREMENTS" not in text


def test_trim_passes_visible_ends_through(spark):
    """As the trim of all white space, at each kind of end."""
    values = ["", " ", "a", " a", "a\n", "a b", "　x", "x ", "é", "éa", "aé", "\x7fa", "a\x7f", "!", "~", "\x00a", "a\x00", None]
    rows = spark.createDataFrame([(v,) for v in values], "s string")
    assert core.trim("s").startswith("CASE WHEN")
    assert [r.a for r in rows.selectExpr(f"{core.trim('s')} AS a").collect()] == [v and v.strip(core.WS_CHARS) for v in values]
