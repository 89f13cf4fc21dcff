"""Stores that change all at once: published tables, and the latest traces kept by arrivals."""

import json

import pytest

from modlens import analyze, schemas
from modlens.plans import tables
from modlens.sources import sinks, versions
from modlens.streaming.incremental import arriving_files, arriving_modules
from modlens.streaming.store import TraceStore, keep_traces

SQL = "CREATE PROC p{n} AS SELECT * FROM t{n} JOIN s ON s.a = t{n}.a; UPDATE u{n} SET STATUS = 1; EXEC q"


def frame(spark, rows):
    return spark.createDataFrame([(i, f"/src/{i}.sql", "s1", sql) for i, sql in rows], schemas.MODULES)


def plain(frame):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in frame.collect())


@pytest.fixture
def store(spark, tmp_path):
    return TraceStore(spark, str(tmp_path / "store"), buckets=8)


def same(store, spark, rows):
    """The store is what an analysis of the rows gives, summaries too."""
    traces = analyze(frame(spark, rows))
    assert plain(store.traces().drop("arrived")) == plain(traces)
    for kept, counted in (
        (store.risk_summary(), tables.risk_summary(traces)),
        (store.findings_by_rule(), tables.findings_by_rule(traces)),
        (store.object_usage(), tables.object_usage(traces)),
    ):
        assert sorted(kept.columns) == sorted(counted.columns)
        assert plain(kept) == plain(counted)


def test_arrivals(store, spark):
    rows = {f"m{k}": SQL.format(n=k) for k in range(60)}
    assert store.upsert(frame(spark, list(rows.items())[:40])) == 0
    assert store.upsert(frame(spark, list(rows.items())[40:])) == 1
    _, before = store._places()
    changes = {"m3": "SELECT 1", "new": "DELETE FROM t"}
    rows |= changes
    assert store.upsert(frame(spark, list(changes.items()))) == 2
    _, after = store._places()
    moved = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(moved) <= 2  # only the buckets of the two modules are written anew
    for b in moved:
        files = spark.read.parquet(f"{after[b]}/traces/bucket={b}").inputFiles()
        assert files and all(f"bucket={b}" in f for f in files)
    same(store, spark, list(rows.items()))


def test_layers_below_are_not_written_again(store, spark, monkeypatch):
    """Arrivals add layers with what is new; the sums hold what was replaced, also when layers become one."""
    monkeypatch.setattr("modlens.streaming.store.LAYERS", 3)
    rows = {f"m{k}": SQL.format(n=k) for k in range(40)}
    store.upsert(frame(spark, list(rows.items())))
    for batch in range(5):
        changes = {"m1": f"SELECT {batch} FROM a{batch}", f"m{batch + 2}": "DELETE FROM gone", f"new{batch}": "EXEC q"}
        rows |= changes
        before = store._layers()[1]
        number = store.upsert(frame(spark, list(changes.items())))
        after = store._layers()[1]
        for b in after:
            assert len(after[b]) <= 4 and (after[b] == before[b] or after[b][-1].number == number)
            assert len(before[b]) >= 3 or after[b][: len(before[b])] == before[b]
        if batch == 0:
            written = spark.read.parquet(f"{store._places()[1][next(b for b in after if after[b] != before[b])]}/traces")
            assert written.count() == 3
        same(store, spark, list(rows.items()))
    assert max(len(of) for of in after.values()) > 1
    store.vacuum(keep=1)
    same(store, spark, list(rows.items()))


def test_a_large_batch_is_dealt_to_many_tasks(store, spark):
    store.upsert(frame(spark, [(f"m{k}", f"SELECT {k}") for k in range(24_000)]))
    files = spark.read.parquet(f"{next(iter(store._places()[1].values()))}/traces").inputFiles()
    assert len(files) == 16  # twice the cores, though there are 8 buckets and ``files`` is 1


def test_only_touched_buckets_are_read(store, spark, monkeypatch):
    store.upsert(frame(spark, [(f"m{k}", SQL.format(n=k)) for k in range(60)]))
    asked = []
    plain_read = TraceStore._read
    monkeypatch.setattr(TraceStore, "_read", lambda self, places, kind, schema, some=None: asked.append((kind, some)) or plain_read(self, places, kind, schema, some))
    store.upsert(frame(spark, [("m5", "SELECT 2")]))
    assert all(some is not None and len(some) == 1 for kind, some in asked if kind == "traces" and some is not None)
    assert sum(kind == "traces" and some is not None for kind, some in asked) == 2


def test_equal_arrivals_change_nothing(store, spark):
    rows = [(f"m{k}", SQL.format(n=k)) for k in range(10)]
    first = store.upsert(frame(spark, rows))
    arrived = plain(store.traces())
    assert store.upsert(frame(spark, rows)) == first
    assert store.upsert(frame(spark, rows[:3] + rows[:3])) == first
    assert plain(store.traces()) == arrived
    assert store.upsert(frame(spark, [])) == first
    assert store.upsert(frame(spark, [("n", None)])) == first


def test_repeats_in_a_batch_and_empty_texts(store, spark):
    store.upsert(frame(spark, [("a", "SELECT 1"), ("a", "SELECT 2"), ("b", ""), ("c", None)]))
    same(store, spark, [("a", "SELECT 2"), ("b", "")])


def test_a_batch_that_failed_is_repeated(store, spark, monkeypatch):
    """Before the commit nothing has changed; run again, all has."""
    rows = [(f"m{k}", SQL.format(n=k)) for k in range(10)]
    store.upsert(frame(spark, rows[:5]))
    former = plain(store.traces())
    with monkeypatch.context() as patched:
        patched.setattr(TraceStore, "_summarize", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.upsert(frame(spark, rows))
    assert plain(store.traces()) == former
    store.upsert(frame(spark, rows))
    store.upsert(frame(spark, rows))
    same(store, spark, rows)
    assert store.vacuum(keep=1)
    same(store, spark, rows)
    assert store.vacuum(keep=1) == []


def test_other_number_of_buckets(store, spark):
    store.upsert(frame(spark, [("a", "SELECT 1")]))
    with pytest.raises(ValueError, match="buckets"):
        TraceStore(spark, store.folder, buckets=9).traces()
    assert TraceStore(spark, store.folder + "x").traces().collect() == []


def test_streams_into_a_store(store, spark, tmp_path):
    """Tables of modules and files; a file put there again with the same text changes nothing."""
    frame(spark, [("m1", "SELECT 1"), ("m2", SQL.format(n=2))]).write.parquet(str(tmp_path / "in"))
    keep_traces(arriving_modules(spark, str(tmp_path / "in")), store, str(tmp_path / "c1")).awaitTermination()
    files = TraceStore(spark, str(tmp_path / "files"), buckets=3)
    (tmp_path / "sql" / "deep").mkdir(parents=True)
    (tmp_path / "sql" / "a.sql").write_text("SELECT * FROM t")
    (tmp_path / "sql" / "deep" / "none.SQL").write_text("")

    def run():
        stream = arriving_files(spark, str(tmp_path / "sql"), settle_ms=0)
        keep_traces(stream, files, str(tmp_path / "c2")).awaitTermination()
        return sorted((r.path.rsplit("/", 1)[1], len(r.rule_ids)) for r in files.traces().collect())

    assert run() == [("a.sql", 1), ("none.SQL", 0)]
    number = files._places()[0]
    (tmp_path / "sql" / "a.sql").write_text("SELECT * FROM t")
    assert run() == [("a.sql", 1), ("none.SQL", 0)] and files._places()[0] == number
    (tmp_path / "sql" / "a.sql").write_text("SELECT b FROM t")
    assert run() == [("a.sql", 0), ("none.SQL", 0)] and files._places()[0] == number + 1
    assert {r.module_id for r in store.traces().collect()} == {"m1", "m2"}


def test_published_tables(spark, tmp_path, monkeypatch):
    """A writer that fails between two tables leaves the former set."""
    folder = str(tmp_path / "tables")
    with pytest.raises(ValueError, match="no published"):
        sinks.published_table(spark, folder, "findings")
    assert sinks.publish_tables(analyze(frame(spark, [("a", SQL.format(n=1))])), folder) == 0
    former = plain(sinks.published_table(spark, folder, "findings"))
    assert former
    later = analyze(frame(spark, [("b", "SELECT 1")]))
    with monkeypatch.context() as patched:
        patched.setattr(sinks, "graph_edges", lambda traces: traces.selectExpr("raise_error('stop') AS x"))
        with pytest.raises(Exception, match="stop"):
            sinks.publish_tables(later, folder)
    assert plain(sinks.published_table(spark, folder, "findings")) == former
    assert sinks.published_table(spark, folder, "module_index").count() == 1
    assert sinks.publish_tables(later, folder) == 1
    assert sinks.published_table(spark, folder, "findings").collect() == []
    assert [r.module_id for r in sinks.published_table(spark, folder, "module_index").collect()] == ["b"]
    assert len(versions.vacuum(spark, folder, keep=1)) == 2
    assert sinks.published_table(spark, folder, "traces").count() == 1
