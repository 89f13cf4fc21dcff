import json

from golden import GOLDEN

from modlens import analyze, read_module_files, read_module_table
from modlens.plans import tables
from modlens.sources import sinks
from modlens.sources.modules import bad_module_files
from modlens.streaming.incremental import append_traces, arriving_modules


def test_folder_scan(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    (tmp_path / "outer").mkdir()
    (tmp_path / "a.sql").write_text(GOLDEN["basic"])
    (tmp_path / "deep" / "b.SQL").write_text("SELECT 1 -- é\n", encoding="utf-8")
    (tmp_path / "deep" / "er" / "c.Sql").write_bytes(b"SELECT '\xff'")
    (tmp_path / "deep" / "d.txt").write_text("SELECT 2")
    (tmp_path / "out" / "e.sql").write_text("SELECT 3")
    (tmp_path / "outer" / "f.sql").write_text("SELECT 4")
    (tmp_path / "outer" / "no thing+50%é.sql").write_text("")
    (tmp_path / "out" / "none.sql").write_text("")
    found = read_module_files(spark, str(tmp_path), skip=str(tmp_path / "out")).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in found) == [
        "a.sql",
        "b.SQL",
        "f.sql",
        "no thing+50%é.sql",
    ]
    assert [r.sql for r in found if "no thing" in r.path] == [""]
    assert {r.sql for r in found} >= {GOLDEN["basic"], "SELECT 1 -- é\n"}
    bad = bad_module_files(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in bad] == ["c.Sql"]
    one = analyze(read_module_files(spark, str(tmp_path / "a.sql"), snapshot="s")).collect()
    assert [(t.name, t.snapshot) for t in one] == [("shop.FindCart", "s")]
    stems = tables.procedures(analyze(read_module_files(spark, str(tmp_path / "deep")))).collect()
    assert [r.procedure for r in stems] == ["b"]


def test_tables_round_trip(spark, modules, tmp_path):
    source = str(tmp_path / "modules")
    modules(GOLDEN).write.parquet(source)
    traces = analyze(read_module_table(spark, source))
    folder = str(tmp_path / "tables")
    sinks.write_tables(traces, folder)
    index = spark.read.parquet(f"{folder}/module_index")
    assert index.count() == len(GOLDEN)
    assert {r.snapshot for r in index.collect()} == {"s1"}
    for name in ("procedures", "parameters", "statements", "dependencies", "findings"):
        assert spark.read.parquet(f"{folder}/{name}").count() > 0
    assert spark.read.parquet(f"{folder}/graph_edges").count() > 0
    sinks.write_reports(traces, str(tmp_path / "reports"))
    assert spark.read.parquet(str(tmp_path / "reports")).count() == len(GOLDEN)
    sinks.write_trace_json(traces, str(tmp_path / "json"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert {json.loads(line)["name"] for line in lines} >= {"shop.FindCart"}


def test_only_arrived_modules_are_analyzed(spark, modules, tmp_path):
    arriving, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    keys = list(GOLDEN)

    def arrive(some):
        modules({k: GOLDEN[k] for k in some}).write.mode("append").parquet(arriving)

    def run():
        stream = arriving_modules(spark, arriving, files_per_batch=1)
        query = append_traces(stream, out, checkpoint)
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    for part in (keys[:2], keys[2:4], keys[4:5], keys[5:6]):
        arrive(part)
    assert run() == 6
    arrive(keys[6:])
    assert run() == 2
    assert run() == 0
    streamed = tables.findings(spark.read.parquet(out))
    batch = tables.findings(analyze(modules(GOLDEN)))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
