"""Analyze only the modules that arrived since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from modlens import schemas
from modlens.plans.analyze import analyze
from modlens.sources.config import RuleConfig
from modlens.sources.folder import register


def arriving_modules(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the Parquet files of a module folder."""
    return (
        spark.readStream.schema(schemas.MODULES)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def arriving_files(
    spark: SparkSession, folder: str, partitions: int | None = None, settle_ms: int = 2000
) -> DataFrame:
    """Stream of the ``.sql`` files (any case) below a folder that are valid UTF-8, empty ones too.

    Each batch lists and reads in its tasks, as a batch scan does, and takes what changed since the
    last one; a file that is put there again comes again. ``settle_ms``: how old a change must be.
    """
    register(spark)
    wanted = partitions or 2 * spark.sparkContext.defaultParallelism
    files = (
        spark.readStream.format("module_folder")
        .option("path", folder)
        .option("partitions", wanted)
        .option("settle_ms", settle_ms)
        .load()
    )
    found = files.select(
        F.col("path").alias("module_id"),
        "path",
        F.lit(None).cast("string").alias("snapshot"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("sql"),
    )
    return found.where("sql IS NOT NULL")


def append_traces(
    modules: DataFrame,
    out: str,
    checkpoint: str,
    config: RuleConfig | None = None,
    partitions: int | None = None,
) -> StreamingQuery:
    """Analyze what is new in the stream ``modules``, append it to ``out``, then stop.

    Traces get the time of their batch as ``arrived``, and folders by snapshot. A module that
    comes again is appended again: see :func:`latest_traces`.

    The analysis looks at one module at a time, so the stream needs no state and no
    watermark. Files already seen are kept in ``checkpoint``, which must be on shared
    storage, as must ``out``; the file sink writes each batch exactly once. Give
    ``partitions`` when batches are few large files: their rows are then dealt out before
    the compute-bound analysis.
    """
    if partitions:
        modules = modules.repartition(partitions)
    return (
        analyze(modules, config)
        .withColumn("arrived", F.current_timestamp())
        .writeStream.format("parquet")
        .partitionBy("snapshot")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def latest_traces(stored: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Each module's trace that arrived last; of one batch, the one of the greatest path and body.

    Give the ``columns`` that are needed next to ``module_id``: others are then neither read nor shuffled, but for the
    three that decide.
    """
    rest = [c for c in stored.columns if c != "module_id" and (columns is None or c in columns)]
    last = F.max_by(F.struct(*rest), F.struct("arrived", "path", "body"))
    return stored.groupBy("module_id").agg(last.alias("last")).select("module_id", "last.*")
