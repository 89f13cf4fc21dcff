"""The folder data source: what it lists, how it deals files out, and its stream."""

import os

import pytest

from modlens.sources.folder import Folder, FolderReader
from modlens.sources.modules import scan_module_files
from modlens.sources.stores import open_store
from modlens.streaming.incremental import append_traces, arriving_files


def names(rows):
    return sorted(r.path.rsplit("/", 1)[1] for r in rows)


@pytest.fixture
def tree(tmp_path):
    for k in range(40):
        folder = tmp_path / f"a{k % 4}" / f"b{k % 3}" / "c"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"m{k}.sql").write_text(f"SELECT {k}")
    (tmp_path / "top.SQL").write_text("")
    (tmp_path / ".sql").write_text("SELECT 1")
    (tmp_path / "_x.sql").write_text("SELECT 2")
    (tmp_path / "a0" / "note.txt").write_text("SELECT 3")
    os.symlink(tmp_path, tmp_path / "a0" / "loop")
    os.symlink(tmp_path / "top.SQL", tmp_path / "link.sql")
    return tmp_path


@pytest.mark.parametrize("partitions", [1, 2, 5, 16, 200])
def test_each_file_is_in_one_share(tree, partitions):
    reader = FolderReader({"path": str(tree), "partitions": str(partitions)})
    shares = reader.partitions()
    assert len(shares) >= partitions
    found = [p for s in shares for b in reader.read(s) for p in b.column(0).to_pylist()]
    assert len(found) == len(set(found)) == 42


def test_the_driver_stops_listing(tree, monkeypatch):
    """It lists the top folder only, where that has folders enough."""
    from modlens.sources import stores

    listed = []
    plain = stores.Local.entries
    monkeypatch.setattr(stores.Local, "entries", lambda self, folder: listed.append(folder) or plain(self, folder))
    Folder({"path": str(tree), "partitions": "4"}).shares()
    assert listed == [str(tree)]


def test_flat_folder_is_read_by_many_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"m{k}.sql").write_text("SELECT 1")
    shares = Folder({"path": str(tmp_path), "partitions": "8"}).shares()
    folder = Folder({"path": str(tmp_path)})
    counts = [sum(1 for _ in folder.files(open_store(str(tmp_path)), s)) for s in shares]
    assert len(counts) == 8 and sum(counts) == 300 and min(counts) > 10


def test_scan(spark, tree):
    rows = scan_module_files(spark, str(tree), skip=str(tree / "a1")).collect()
    assert names(rows) == sorted(["top.SQL", "_x.sql", *(f"m{k}.sql" for k in range(40) if k % 4 != 1)])
    assert [r.sql for r in rows if r.path.endswith("top.SQL")] == [""]
    assert {r.path for r in rows} == {r.module_id for r in rows} and all(r.path.startswith("file:/") for r in rows)
    assert names(scan_module_files(spark, f"file://{tree}").collect()) == names(scan_module_files(spark, f"{tree}/").collect())
    plan = scan_module_files(spark, str(tree), partitions=6)
    assert plan.rdd.getNumPartitions() >= 6
    with pytest.raises(Exception, match="there is no"):
        scan_module_files(spark, str(tree / "nothing")).collect()
    (tree / "empty").mkdir()
    assert scan_module_files(spark, str(tree / "empty")).collect() == []


def test_stream_of_files(spark, tmp_path):
    """Empty files are modules, a file put there again comes again, older ones do not."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in" / "deep").mkdir(parents=True)

    def run():
        append_traces(arriving_files(spark, source, settle_ms=0), out, checkpoint).awaitTermination()
        return sorted((r.path.rsplit("/", 1)[1], len(r.rule_ids)) for r in spark.read.parquet(out).collect())

    (tmp_path / "in" / "a.sql").write_text("SELECT * FROM t")
    (tmp_path / "in" / "deep" / "none.SQL").write_text("")
    (tmp_path / "in" / "bad.sql").write_bytes(b"\xff")
    first = [("a.sql", 1), ("none.SQL", 0)]
    assert run() == first
    assert run() == first
    (tmp_path / "in" / "a.sql").write_text("SELECT a FROM t")
    (tmp_path / "moved").write_text("SELECT * FROM u")
    os.utime(tmp_path / "moved", (1, 1))
    os.replace(tmp_path / "moved", tmp_path / "in" / "deep" / "b.sql")
    assert run() == sorted([*first, ("a.sql", 0), ("b.sql", 1)])
