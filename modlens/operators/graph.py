"""Corpus-wide dependency graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.functions.identifiers import node_id, node_label

UNNAMED = "UNKNOWN_PROC"


def module_node(name: str) -> str:
    return f"coalesce({name}, '{UNNAMED}')"


def graph_nodes(traces: DataFrame) -> DataFrame:
    """``node_id, label`` of all procedures and objects; the least label of an id is kept.

    A module emits its own node and its objects' from one pass over the traces, each once.
    """
    labels = F.expr(
        f"array_distinct(concat(array({module_node('name')}), transform(dependencies, d -> d.object)))"
    )
    return (
        traces.select(F.explode_outer(labels).alias("name"))
        .distinct()  # names repeat: identifiers are made once per name
        .groupBy(F.expr(node_id("name")).alias("node_id"))
        .agg(F.min(F.expr(node_label("name"))).alias("label"))
    )


def graph_edges(traces: DataFrame) -> DataFrame:
    """Distinct ``src, dst, kind``: reads point to the procedure, writes and calls from it."""
    procedure = F.expr(node_id(module_node("name")))
    used = traces.select(
        procedure.alias("procedure"), F.explode_outer("dependencies").alias("d")
    ).filter(F.col("d").isNotNull())
    reads = F.col("d.operation") == "Read"
    target = F.expr(node_id("d.object"))
    return used.select(
        F.when(reads, target).otherwise(F.col("procedure")).alias("src"),
        F.when(reads, F.col("procedure")).otherwise(target).alias("dst"),
        F.col("d.operation").alias("kind"),
    ).distinct()
