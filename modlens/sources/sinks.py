"""Writing results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.operators.graph import graph_edges, graph_nodes
from modlens.plans import documents, tables
from modlens.session import ship_package
from modlens.sources import versions
from modlens.sources.config import RuleConfig
from modlens.sources.stores import open_store


def write_traces(traces: DataFrame, folder: str, mode: str = "errorifexists") -> DataFrame:
    """Store traces as Parquet by snapshot and return them as read back.

    The analysis runs once here; tables derived from the result scan columns instead.
    """
    target = f"{folder}/traces"
    traces.write.mode(mode).partitionBy("snapshot").parquet(target)
    return traces.sparkSession.read.schema(traces.schema).parquet(target)


def write_tables(
    traces: DataFrame,
    folder: str,
    config: RuleConfig | None = None,
    mode: str = "errorifexists",
) -> None:
    """Traces and all their tables, one folder each; module tables by snapshot."""
    stored = write_traces(traces, folder, mode)
    for name, (table, by) in _all_tables(stored, config).items():
        table.write.mode(mode).partitionBy(*by).parquet(f"{folder}/{name}")


def _all_tables(
    stored: DataFrame, config: RuleConfig | None
) -> dict[str, tuple[DataFrame, tuple[str, ...]]]:
    """Tables of stored traces, with the columns whose values are folders."""
    keep = ("snapshot",)
    return {
        "procedures": (tables.procedures(stored, keep), keep),
        "parameters": (tables.parameters(stored, keep), keep),
        "statements": (tables.statements(stored, keep), keep),
        "dependencies": (tables.dependencies(stored, keep), keep),
        "temp_tables": (tables.temp_tables(stored, keep), keep),
        "findings": (tables.findings(stored, config, keep), keep),
        "module_index": (tables.module_index(stored, keep), keep),
        "graph_nodes": (graph_nodes(stored), ()),
        "graph_edges": (graph_edges(stored), ()),
    }


def publish_tables(traces: DataFrame, folder: str, config: RuleConfig | None = None) -> int:
    """Traces and all their tables as one set that replaces the former at once; its number.

    Until the last table is written readers have the former set, also if this fails on the way: see
    ``sources/versions.py``. Read with :func:`published_table`.
    """
    spark = traces.sparkSession
    number, _ = versions.current(spark, folder)
    place = versions.new_place(folder)
    stored = write_traces(traces, place)
    found = _all_tables(stored, config)
    for name, (table, by) in found.items():
        table.write.partitionBy(*by).parquet(f"{place}/{name}")
    forms = {"traces": stored.schema, **{name: table.schema for name, (table, _) in found.items()}}
    versions.commit(spark, folder, number + 1, {name: f"{place}/{name}" for name in forms}, forms)
    return number + 1


def published_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the latest complete set."""
    _, parts = versions.current(spark, folder)
    if name not in parts:
        raise ValueError(f"{folder} has no published table {name}")
    return spark.read.schema(versions.schemas(spark, folder)[name]).parquet(parts[name])


def write_reports(
    traces: DataFrame,
    folder: str,
    config: RuleConfig | None = None,
    mode: str = "errorifexists",
) -> None:
    """Report texts as rows with their output key, so equal names overwrite nothing."""
    documents.report_md(traces, config).write.mode(mode).parquet(folder)


def write_trace_json(
    traces: DataFrame,
    folder: str,
    config: RuleConfig | None = None,
    mode: str = "errorifexists",
) -> None:
    """Trace documents as text, one JSON document per line."""
    documents.trace_json(traces, config).select("trace_json").write.mode(mode).text(folder)


def write_files(rows: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """One file per row below a folder, at the path that column ``name`` gives; path and length of each.

    Folders are made as needed. A file is there whole or not at all, and rows written again by a
    task that is run again replace their own files. ``content`` is a string or binary column; null
    is empty. Names must be unique: two rows of one name would race. The files are written when
    the result is used.
    """
    ship_package(rows.sparkSession)
    chosen = rows.select(
        F.col(name).alias("name"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = open_store(folder)
        for batch in batches:
            names, lengths = batch.column(0).to_pylist(), []
            for path, value in zip(names, batch.column(1), strict=True):
                data = value.as_py()
                if ".." in path.split("/"):
                    raise ValueError(f"{path} is not below the folder")
                store.write(f"{store.root}/{path}", data)
                lengths.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(lengths, pa.int64())], names=["name", "length"]
            )

    return chosen.mapInArrow(write, "name string, length long")
