"""The registered queries: each operator over corpora made from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.functions import identifiers, text
from modlens.operators import diff, graph, verify
from modlens.operators.statements import classify
from modlens.plans import chunks, corpus, documents, tables
from modlens.plans.analyze import analyze, prepare
from modlens.plans.shared import analyze_shared
from modlens.session import shared_folder
from modlens.sources.config import RuleConfig
from modlens.sources.modules import scan_module_files
from modlens.sources.sinks import (
    publish_tables,
    published_table,
    write_files,
    write_reports,
    write_tables,
)
from modlens.streaming.incremental import (
    append_traces,
    arriving_files,
    arriving_modules,
    latest_traces,
)
from modlens.streaming.store import TraceStore, keep_traces

Query = Callable[[SparkSession, str], DataFrame]

# The settings of the query on rule configuration.
CONFIG = {
    "select_star": False,
    "nolock_used": "High",
    "dynamic_sql": "low",
    "update_without_where": True,
    "hardcoded_date": "MEDIUM",
    "no_such_rule": False,
}


def _traces(spark: SparkSession, folder: str) -> DataFrame:
    return analyze(corpus.short_modules(spark, folder))


def _on_traces(table: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: table(_traces(spark, folder))


def _on_edges(table: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: table(analyze(corpus.edge_modules(spark, folder)))


def _on_modules(**columns: str) -> Query:
    """Columns computed from the prepared short modules, given as SQL text."""
    return lambda spark, folder: prepare(corpus.short_modules(spark, folder)).select(
        "module_id", *[F.expr(e).alias(name) for name, e in columns.items()]
    )


def _per_statement(**columns: str) -> Query:
    """As above per statement ``s``, numbered from 1."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = prepare(corpus.short_modules(spark, folder)).select(
            "module_id", F.posexplode_outer("statement_texts").alias("pos", "s")
        )
        return rows.filter(F.col("s").isNotNull()).select(
            "module_id",
            (F.col("pos") + 1).alias("stmt_index"),
            *[F.expr(e).alias(name) for name, e in columns.items()],
        )

    return query


def _statement_list(traces: DataFrame) -> DataFrame:
    return tables.statements(traces).withColumn("sources", F.array_join("sources", ","))


def _index(traces: DataFrame) -> DataFrame:
    return tables.ranked_index(traces).withColumn("risk_rules", F.array_join("risk_rules", ","))


def _findings_with_config(spark: SparkSession, folder: str) -> DataFrame:
    config = RuleConfig(CONFIG)
    return tables.findings(analyze(corpus.short_modules(spark, folder), config), config).select(
        "module_id", "rule_id", "severity", "rank"
    )


def _summary_with_config(spark: SparkSession, folder: str) -> DataFrame:
    return tables.risk_summary(analyze(corpus.short_modules(spark, folder), RuleConfig(CONFIG)))


def _statement_kinds(traces: DataFrame) -> DataFrame:
    return tables.statements(traces).groupBy("kind").agg(F.count("*").alias("statements"))


def _external_dependencies(traces: DataFrame) -> DataFrame:
    return (
        tables.dependencies(traces)
        .filter("is_external")
        .select("module_id", "object", "operation", "source")
    )


def _module_metrics(traces: DataFrame) -> DataFrame:
    return traces.select("module_id", "metrics.*")


def _snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    return diff.diff_modules(*corpus.snapshots(spark, folder))


def _diff_documents(spark: SparkSession, folder: str) -> DataFrame:
    labels = ("concat('before/', pair_id)", "concat('after/', pair_id)")
    return documents.diff_documents(_snapshot_diff(spark, folder), *labels)


def _shared_texts(spark: SparkSession, folder: str) -> DataFrame:
    traces = analyze_shared(corpus.repeated_modules(spark, folder), hot_texts=1000)
    return traces.select(
        "module_id",
        "procedure",
        "metrics.statement_count",
        "metrics.read_count",
        "metrics.write_count",
        "metrics.risk_level",
        F.array_join("rule_ids", ",").alias("rules"),
        "copies",
    )


def _module_diff(spark: SparkSession, folder: str) -> DataFrame:
    sets = [f"{c}_{change}" for c in diff.CATEGORIES for change in ("added", "removed")]
    return _snapshot_diff(spark, folder).withColumns({s: F.array_join(s, " | ") for s in sets})


def _pair_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Each module paired with the one before it and all with module 1: a hot key."""
    keys = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey")
    key = F.col("o_orderkey")
    pairs = keys.select(
        F.explode(
            F.array(
                F.struct(
                    F.concat(F.lit("n"), key.cast("string")).alias("pair_id"),
                    (key - 1).cast("string").alias("before_id"),
                    key.cast("string").alias("after_id"),
                ),
                F.struct(
                    F.concat(F.lit("h"), key.cast("string")).alias("pair_id"),
                    F.lit("1").alias("before_id"),
                    key.cast("string").alias("after_id"),
                ),
            )
        ).alias("p")
    ).select("p.*")
    result = diff.diff_pairs(_traces(spark, folder), pairs, hot_pairs=1000)
    return result.select(
        "pair_id",
        "presence",
        "statement_delta",
        "read_delta",
        "write_delta",
        "temp_table_delta",
        "risk_delta",
        F.array_join("tables_read_added", ",").alias("tables_read_added"),
        F.array_join("tables_read_removed", ",").alias("tables_read_removed"),
    )


def _long_findings(spark: SparkSession, folder: str) -> DataFrame:
    return tables.findings(analyze(corpus.long_modules(spark, folder))).select(
        "module_id", "rule_id", "severity"
    )


def _long_text(spark: SparkSession, folder: str) -> DataFrame:
    prepared = prepare(corpus.long_modules(spark, folder))
    return prepared.select(
        "module_id",
        F.length("code").alias("code_chars"),
        F.md5("code").alias("code_md5"),
        F.length("body").alias("body_chars"),
        F.size("statement_texts").alias("statements"),
    )


def _chunked_text(spark: SparkSession, folder: str) -> DataFrame:
    """Long modules in chunks of 3,000 characters, put together again."""
    found = chunks.whole_texts(chunks.chunked_code(corpus.long_modules(spark, folder), 3000), "code", "blanked")
    return found.select("module_id", F.length("code").alias("code_chars"), F.md5("code").alias("code_md5"), F.md5("blanked").alias("blanked_md5"))


def _long_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    traces = analyze(corpus.long_modules(spark, folder))
    return tables.dependencies(traces).select("module_id", "ord", "object", "operation", "source")


def _dense_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    traces = analyze(corpus.dense_modules(spark, folder))
    return tables.dependencies(traces).select("module_id", "ord", "object", "operation", "source")


def _dense_usage(spark: SparkSession, folder: str) -> DataFrame:
    return tables.object_usage(analyze(corpus.dense_modules(spark, folder))).drop("is_external")


def _report_keys(spark: SparkSession, folder: str) -> DataFrame:
    parts = spark.read.parquet(f"{folder}/part.parquet")
    return parts.select(
        "p_partkey",
        F.expr(identifiers.report_key("concat('[', p_name, '] #', p_type, '.', p_brand)")).alias(
            "report_key"
        ),
        F.expr(identifiers.file_stem("concat('/srv/', p_brand, '/', p_name, '.v1.sql')")).alias(
            "file_stem"
        ),
    )


def _duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return verify.duplicate_keys(lines, ["l_orderkey", "l_partkey"])


def _duplicate_brands(spark: SparkSession, folder: str) -> DataFrame:
    return verify.duplicate_keys(spark.read.parquet(f"{folder}/part.parquet"), ["p_brand"])


def _preview_target(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return verify.preview(orders, 100, ["o_orderkey"]).select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


def _join_inflation(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet").withColumnRenamed("o_orderkey", "key")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").withColumnRenamed("l_orderkey", "key")
    return verify.join_inflation(orders, lines, ["key"], "o_totalprice").select(
        "key",
        "n",
        F.round("detail_sum", 2).alias("detail_sum"),
        F.round("joined_sum", 2).alias("joined_sum"),
    )


def arrive(spark: SparkSession, folder: str) -> str:
    """Four arrivals, each analyzed and appended by a run of its own; the folder of the traces."""
    out = shared_folder(spark, "incremental")
    for modules in corpus.arrivals(spark, folder):
        modules.write.mode("append").parquet(f"{out}/modules")
        stream = arriving_modules(spark, f"{out}/modules")
        append_traces(stream, f"{out}/traces", f"{out}/checkpoint").awaitTermination()
    return f"{out}/traces"


def _arrived(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return latest_traces(spark.read.parquet(arrive(spark, folder)), columns)


def kept_store(spark: SparkSession, folder: str) -> TraceStore:
    """The same arrivals, and the first once more, taken into a store by module."""
    out = shared_folder(spark, "store")
    store = TraceStore(spark, f"{out}/traces", buckets=8)
    arrivals = corpus.arrivals(spark, folder)
    again = arrivals[0].where(F.col("module_id").cast("long") % 10 != 0)
    for modules in (*arrivals, again):
        modules.write.mode("append").parquet(f"{out}/modules")
        keep_traces(arriving_modules(spark, f"{out}/modules"), store, f"{out}/checkpoint").awaitTermination()
    return store


def _kept_findings(spark: SparkSession, folder: str) -> DataFrame:
    return tables.findings(kept_store(spark, folder).traces()).select("module_id", "rule_id", "severity", "rank")


def _kept_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of the store by kind, added up from its buckets' summaries."""
    store = kept_store(spark, folder)
    levels = store.risk_summary().select(F.expr("stack(4, 'scanned', scanned, 'High', high, 'Medium', medium, 'Low', low) AS (key, modules)"))
    rules = store.findings_by_rule().select(F.col("rule_id").alias("key"), "modules")
    uses = store.object_usage().select(F.expr("stack(3, 'Read', readers, 'Write', writers, 'Execute', callers) AS (kind, modules)"), "object")
    uses = uses.where("modules > 0").select(F.concat_ws(" ", "kind", "object").alias("key"), "modules")
    return levels.unionByName(rules).unionByName(uses)


def _arrived_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files taken into a store in two runs, the second after some came again, some of them changed."""
    out = shared_folder(spark, "files")
    store = TraceStore(spark, f"{out}/store", buckets=8)
    files = corpus.module_files(spark, folder)
    number = F.regexp_extract("name", "m([0-9]+)[.]", 1).cast("long")
    changed = F.when(number % 3 == 0, F.lit(b"DELETE FROM gone")).otherwise(F.col("content"))
    for rows in (files, files.where(number % 2 == 0).withColumn("content", changed)):
        write_files(rows, f"{out}/sql", "name", "content").write.mode("append").parquet(f"{out}/listing")
        keep_traces(arriving_files(spark, f"{out}/sql", settle_ms=0), store, f"{out}/checkpoint").awaitTermination()
    inner = F.substring_index("path", out.rsplit("/", 1)[1] + "/sql/", -1)
    return store.traces().select(inner.alias("path"), "procedure", F.array_join("rule_ids", ",").alias("rules"))


def _incremental_findings(spark: SparkSession, folder: str) -> DataFrame:
    return tables.findings(_arrived(spark, folder, "rule_ids")).select(
        "module_id", "rule_id", "severity", "rank"
    )


def _latest_index(spark: SparkSession, folder: str) -> DataFrame:
    return tables.module_index(_arrived(spark, folder, "path", "procedure", "temp_tables", "rule_ids", "metrics")).select(
        "module_id", "procedure", "statement_count", "read_count", "write_count", "risk_level"
    )


def _nested_parameters(spark: SparkSession, folder: str) -> DataFrame:
    return tables.parameters(analyze(corpus.nested_modules(spark, folder)))


def _stored_index(spark: SparkSession, folder: str) -> DataFrame:
    """All tables written by snapshot; the index as read back."""
    out = shared_folder(spark, "tables")
    write_tables(_traces(spark, folder), out)
    index = spark.read.parquet(f"{out}/module_index").drop("snapshot")
    return index.withColumn("risk_rules", F.array_join("risk_rules", ","))


def _published_index(spark: SparkSession, folder: str) -> DataFrame:
    """All tables published twice, as one set each time; the index of the latter."""
    out = shared_folder(spark, "tables")
    before, after = corpus.snapshots(spark, folder)
    for modules in (before, after):
        publish_tables(analyze(modules), out)
    index = published_table(spark, out, "module_index").drop("snapshot")
    return index.withColumn("risk_rules", F.array_join("risk_rules", ","))


def _stored_reports(spark: SparkSession, folder: str) -> DataFrame:
    out = shared_folder(spark, "reports")
    write_reports(_traces(spark, folder), out)
    return spark.read.parquet(out)


def _scanned(spark: SparkSession, folder: str) -> DataFrame:
    """Modules as files in nested folders, written by Spark and scanned again; paths below the folder."""
    out = shared_folder(spark, "files")
    written = write_files(corpus.module_files(spark, folder), out, "name", "content")
    written.write.parquet(f"{out}/out/listing")
    found = scan_module_files(spark, out, skip=f"{out}/out")
    inner = F.substring_index("path", out.rsplit("/", 1)[1] + "/", -1)
    return found.withColumns({"module_id": inner, "path": inner})


def _folder_scan(spark: SparkSession, folder: str) -> DataFrame:
    traces = analyze(_scanned(spark, folder).where("sql IS NOT NULL"))
    return traces.select(
        "path",
        "procedure",
        F.col("metrics.statement_count").alias("statement_count"),
        F.array_join("rule_ids", ",").alias("rules"),
    )


def _folder_bad_files(spark: SparkSession, folder: str) -> DataFrame:
    return _scanned(spark, folder).where("sql IS NULL").select("path")


QUERIES: dict[str, Query] = {
    # text
    "comment_stripping": _on_modules(code="code"),
    "whitespace_collapse": _on_modules(text=text.collapse_whitespace("sql")),
    "identifier_parts": _on_modules(
        from_name=text.normalize_identifier("concat('[dbo].[', coalesce(name, 'x'), '] ;')")
    ),
    "statement_split": _per_statement(statement="s"),
    "literal_masking": _on_modules(masked=text.blank_literals("body")),
    "rule_statements": _per_statement(
        cleaned=f"nullif({text.clean_for_rules(text.drop_literals('s'))}, '')"
    ),
    "summary_statements": _per_statement(
        cleaned=text.clean_for_summary("s"), kind=classify(text.clean_for_summary("s"))
    ),
    "report_keys": _report_keys,
    # extraction
    "module_names": _on_traces(lambda t: t.select("module_id", "name", "procedure")),
    "module_bodies": _on_traces(lambda t: t.select("module_id", "body")),
    "parameter_list": _on_traces(tables.parameters),
    "nested_parameters": _nested_parameters,
    "dependency_list": _on_traces(tables.dependencies),
    "temp_table_list": _on_traces(tables.temp_tables),
    "statement_list": _on_traces(_statement_list),
    "statement_kinds": _on_traces(_statement_kinds),
    # rules
    "findings_by_module": _on_traces(tables.findings),
    "findings_by_rule": _on_traces(tables.findings_by_rule),
    "findings_with_config": _findings_with_config,
    "risk_summary_with_config": _summary_with_config,
    # aggregation
    "module_metrics": _on_traces(_module_metrics),
    "module_index": _on_traces(_index),
    "risk_summary": _on_traces(tables.risk_summary),
    "object_usage": _on_traces(tables.object_usage),
    "object_lists": _on_traces(documents.object_lists),
    "external_dependencies": _on_traces(_external_dependencies),
    # texts at the edges of the rules
    "edge_text": lambda spark, folder: prepare(corpus.edge_modules(spark, folder)).select(
        "module_id", "code", "body", F.array_join("statement_texts", "|").alias("statements")
    ),
    "edge_names": _on_edges(lambda t: t.select("module_id", "name", F.array_join("temp_tables", ",").alias("temps"))),
    "edge_parameters": _on_edges(tables.parameters),
    "edge_statements": _on_edges(lambda t: _statement_list(t)),
    "edge_dependencies": _on_edges(tables.dependencies),
    "edge_findings": _on_edges(tables.findings),
    # graph
    "graph_nodes": _on_traces(graph.graph_nodes),
    "graph_edges": _on_traces(graph.graph_edges),
    # diff
    "module_diff": _module_diff,
    "diff_changes": lambda spark, folder: diff.diff_changes(_snapshot_diff(spark, folder)),
    "pair_diff": _pair_diff,
    "diff_documents": _diff_documents,
    # texts that many modules share
    "shared_texts": _shared_texts,
    # documents
    "questions": _on_traces(documents.questions),
    "suggested_queries": _on_traces(documents.suggested_queries),
    "execution_flow": _on_traces(documents.flows),
    "diagrams": _on_traces(documents.diagrams),
    "trace_json": _on_traces(documents.trace_json),
    "context_json": _on_traces(documents.context_json),
    "report_md": _on_traces(documents.report_md),
    "context_text": _on_traces(documents.context_text),
    # long modules
    "long_module_text": _long_text,
    "chunked_text": _chunked_text,
    "long_module_findings": _long_findings,
    "long_module_dependencies": _long_dependencies,
    "dense_module_dependencies": _dense_dependencies,
    "dense_module_usage": _dense_usage,
    # checks on data
    "duplicate_keys": _duplicate_keys,
    "duplicate_brands": _duplicate_brands,
    "preview_target": _preview_target,
    "join_inflation": _join_inflation,
    # streaming
    "incremental_findings": _incremental_findings,
    "latest_index": _latest_index,
    "kept_findings": _kept_findings,
    "kept_summary": _kept_summary,
    "arrived_files": _arrived_files,
    # folders
    "folder_scan": _folder_scan,
    "folder_bad_files": _folder_bad_files,
    # sinks
    "stored_index": _stored_index,
    "published_index": _published_index,
    "stored_reports": _stored_reports,
}
