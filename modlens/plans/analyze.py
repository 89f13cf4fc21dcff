"""The analysis: one narrow projection from module text to one nested trace per module."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.functions.core import each, where
from modlens.functions.identifiers import file_stem
from modlens.functions.text import split_code
from modlens.operators.dependencies import module_dependencies, statement_hits, temp_tables_of
from modlens.operators.procedures import parameters_of, restored, with_header
from modlens.operators.rules import risk_level, rule_ids, with_rule_inputs
from modlens.operators.statements import is_summarized, summarize
from modlens.sources.config import RuleConfig


def prepare(modules: DataFrame) -> DataFrame:
    """Header, body and statement texts, each computed once in a named column."""
    for optional in ("path", "snapshot"):
        if optional not in modules.columns:
            modules = modules.withColumn(optional, F.lit(None).cast("string"))
    return with_header(modules).withColumn("statement_texts", F.expr(split_code("body")))


def _restored_parameter(p: str) -> str:
    fields = [f"'{f}', {restored(f'{p}.{f}')}" for f in ("name", "data_type", "default_value")]
    return f"named_struct({', '.join(fields)})"


def analyze(
    modules: DataFrame, config: RuleConfig | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One trace per module: ``module_id, path, snapshot, name, procedure, body, parameters,
    dependencies, temp_tables, statements, rule_ids, metrics``, and the columns of ``keep``.

    Every step looks at one module only, so the whole analysis is one map stage without a
    shuffle, and columns a query does not use are pruned with their computation. It also
    runs on a streaming DataFrame. To derive several tables from a large corpus, write the
    result once and read it back.
    """
    found = with_rule_inputs(
        prepare(modules)
        .withColumns(
            {
                "parameters": F.expr(parameters_of("parameter_block")),
                "hits": F.expr(
                    each("statement_texts", lambda s, i: statement_hits(s, f"{i} + 1"), index=True)
                ),
                "temp_tables": F.expr(temp_tables_of("body")),
            }
        )
    )
    traces = found.withColumns(
            {
                "dependencies": F.expr(module_dependencies("hits")),
                "statements": F.expr(summarize("statement_texts", "hits")),
                "rule_ids": rule_ids(config),
                # As many as summaries, without making them where only the count is used.
                "statement_count": F.expr(f"size({where('statement_texts', is_summarized)})"),
            }
        )

    def count_of(operation: str):
        return F.expr(f"size(filter(dependencies, d -> d.operation = '{operation}'))")

    return traces.select(
        "module_id",
        "path",
        "snapshot",
        "name",
        F.coalesce("name", F.expr(file_stem("coalesce(path, module_id)"))).alias("procedure"),
        F.expr(restored("body")).alias("body"),
        F.expr(each("parameters", _restored_parameter)).alias("parameters"),
        "dependencies",
        "temp_tables",
        "statements",
        "rule_ids",
        F.struct(
            "statement_count",
            count_of("Read").alias("read_count"),
            count_of("Write").alias("write_count"),
            risk_level(F.col("rule_ids"), config).alias("risk_level"),
        ).alias("metrics"),
        *keep,
    )
