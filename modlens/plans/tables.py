"""Child tables of the traces, and corpus-wide summaries.

Arrays are taken apart with the ``_outer`` generators: for the plain ones Catalyst infers a
filter on the array's size and pushes it below the analysis, which would run twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.functions.identifiers import is_external, report_key
from modlens.functions.patterns import FIELD
from modlens.operators.rules import rule_catalog
from modlens.schemas import SEVERITY_RANK
from modlens.sources.config import RuleConfig


def _exploded(traces: DataFrame, array: str, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = traces.select("module_id", *keep, F.posexplode_outer(array).alias("pos", "item"))
    return rows.filter(F.col("item").isNotNull()).withColumn("pos", F.col("pos") + 1)


def procedures(traces: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return traces.select("module_id", *keep, "name", "procedure", "body")


def parameters(traces: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _exploded(traces, "parameters", keep).select("module_id", *keep, "pos", "item.*")


def statements(traces: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _exploded(traces, "statements", keep).select("module_id", *keep, "item.*")


def dependencies(traces: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _exploded(traces, "dependencies", keep).select(
        "module_id",
        *keep,
        F.col("pos").alias("ord"),
        "item.*",
        F.expr(is_external("item.object")).alias("is_external"),
    )


def temp_tables(traces: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _exploded(traces, "temp_tables", keep).select(
        "module_id", *keep, F.col("item").alias("name")
    )


def findings(
    traces: DataFrame, config: RuleConfig | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per module and broken rule. Give the ``config`` the traces were made with."""
    catalog = rule_catalog(traces.sparkSession, config)
    return (
        _exploded(traces, "rule_ids", keep)
        .select("module_id", *keep, F.col("item").alias("rule_id"))
        .join(F.broadcast(catalog), "rule_id")  # a row per rule, 14 at most
        .select("module_id", *keep, "rule_id", "severity", "rank", "message", "suggestion")
    )


def findings_by_rule(traces: DataFrame, config: RuleConfig | None = None) -> DataFrame:
    """Modules per rule. A module has a rule once, so counting rows counts modules."""
    counts = _exploded(traces, "rule_ids").groupBy(F.col("item").alias("rule_id")).agg(
        F.count("*").alias("modules")
    )
    catalog = rule_catalog(traces.sparkSession, config).select("rule_id", "severity", "rank")
    return counts.join(F.broadcast(catalog), "rule_id").select(
        "rule_id", "severity", "rank", "modules"
    )


def severity_rank(level: Column) -> Column:
    rank = F.lit(0)
    for severity, value in SEVERITY_RANK.items():
        rank = F.when(level == severity, value).otherwise(rank)
    return rank


def module_index(traces: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per module, unordered; :func:`ranked_index` orders it."""
    return traces.select(
        "module_id",
        *keep,
        F.coalesce("path", "module_id").alias("source_file"),
        F.concat(F.expr(report_key("procedure")), F.lit(".md")).alias("report_file"),
        "procedure",
        F.col("metrics.statement_count").alias("statement_count"),
        F.col("metrics.read_count").alias("read_count"),
        F.col("metrics.write_count").alias("write_count"),
        F.size("temp_tables").alias("temp_table_count"),
        F.size("rule_ids").alias("risk_count"),
        F.col("metrics.risk_level").alias("risk_level"),
        F.col("rule_ids").alias("risk_rules"),
    )


def ranked_index(traces: DataFrame) -> DataFrame:
    """The index ordered by risk level down, procedure, file.

    A range sort first samples its input. The small index rows are therefore exchanged
    before it: the sample reads them from shuffle files instead of analyzing all text twice.
    """
    return (
        module_index(traces)
        .repartition("module_id")
        .orderBy(severity_rank(F.col("risk_level")).desc(), "procedure", "source_file")
    )


def risk_summary(traces: DataFrame) -> DataFrame:
    level = F.col("metrics.risk_level")
    return traces.select(level.alias("level")).agg(
        F.count("*").alias("scanned"),
        F.count_if(F.col("level") == "High").alias("high"),
        F.count_if(F.col("level") == "Medium").alias("medium"),
        F.count_if(F.col("level") == "Low").alias("low"),
    )


def object_usage(traces: DataFrame) -> DataFrame:
    """Modules that read, write and execute each object.

    A pair (object, operation) is made unique inside its module before it leaves the row. So
    plain counts are enough: they combine before the shuffle, and an object that every
    module uses costs one row per task.
    """
    # Strings are made distinct by hash, structs pairwise.
    pairs = F.expr(
        "array_distinct(transform(dependencies,"
        f" d -> concat(d.object, '{FIELD}', d.operation)))"
    )
    used = traces.select(F.explode_outer(pairs).alias("pair")).filter(F.col("pair").isNotNull())
    used = used.select(F.split("pair", FIELD).alias("pair")).select(
        F.struct(F.col("pair")[0].alias("object"), F.col("pair")[1].alias("operation")).alias("use")
    )

    def modules(operation: str):
        return F.count_if(F.col("use.operation") == operation)

    return (
        used.groupBy(F.col("use.object").alias("object"))
        .agg(
            modules("Read").alias("readers"),
            modules("Write").alias("writers"),
            modules("Execute").alias("callers"),
        )
        .withColumn("is_external", F.expr(is_external("object")))
    )
