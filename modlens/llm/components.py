"""Connected components of a table of links, by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.session import shared_folder


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours move to the smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours, and the node itself, move to the smallest neighbour."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, component (its smallest node), for the nodes of the links (a, b: comparable, not null).

    Every round is written to the shared folder and compared with the last by a hash of its rows; it
    ends when each node points at the smallest of its component, after about log2 of the longest path.
    """
    spark = links.sparkSession
    folder = shared_folder(spark, "components")

    def stored(edges: DataFrame, name: str) -> tuple[DataFrame, object]:
        edges.where("a <> b").distinct().write.parquet(f"{folder}/{name}")
        read = spark.read.parquet(f"{folder}/{name}")
        return read, read.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges, state = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    for number in range(most_rounds):
        if not state[0]:
            break
        edges, after = stored(_small_star(_large_star(edges)), f"round-{number}")
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
