"""modlens: analysis of large corpora of T-SQL modules as Spark DataFrames."""

from modlens.plans.analyze import analyze
from modlens.plans.tables import (
    dependencies,
    findings,
    module_index,
    parameters,
    procedures,
    risk_summary,
    statements,
    temp_tables,
)
from modlens.sources.config import RuleConfig
from modlens.sources.modules import read_module_files, read_module_table

__all__ = [
    "RuleConfig",
    "analyze",
    "dependencies",
    "findings",
    "module_index",
    "parameters",
    "procedures",
    "read_module_files",
    "read_module_table",
    "risk_summary",
    "statements",
    "temp_tables",
]
