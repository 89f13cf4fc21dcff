"""Reading modules: folders of .sql files, or a table that holds the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.sources import stores
from modlens.sources.folder import register


def spread(scan: DataFrame, partitions: int | None) -> DataFrame:
    """Deal the rows out over so many partitions; not at all by default, as that shuffles them.

    One compressed row group is one task. A corpus in few large row groups is better cut by
    ``spark.sql.files.maxPartitionBytes`` and rewritten with smaller ones; this is for the rest.
    """
    return scan.repartition(partitions) if partitions else scan


def read_module_table(
    spark: SparkSession,
    path: str,
    text: str = "sql",
    module_id: str = "module_id",
    partitions: int | None = None,
) -> DataFrame:
    """A corpus kept as Parquet. Missing ``path`` / ``snapshot`` columns become null.

    Rows without text are no modules and are left out.
    """
    table = spark.read.parquet(path)

    def optional(name: str):
        column = F.col(name) if name in table.columns else F.lit(None)
        return column.cast("string").alias(name)

    return spread(
        table.select(
            F.col(module_id).cast("string").alias("module_id"),
            optional("path"),
            optional("snapshot"),
            F.col(text).alias("sql"),
        ).where("sql IS NOT NULL"),
        partitions,
    )


def _below(skip: str):
    folder = F.lit(skip.rstrip("/") + "/")
    # Spark gives paths with their scheme ("file:/a/b").
    plain = F.regexp_replace("path", r"\A[A-Za-z][A-Za-z0-9+.-]*+:(?://[^/]*+)?(?=/)", "")
    return F.startswith("path", folder) | F.startswith(plain, folder)


def _scan_through_spark(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` by Spark's own readers, for stores that only these reach.

    They pass over files of zero bytes, so these are taken from the listing that the driver has made.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.[sS][qQ][lL]")
        .load(folder)
    )
    # The listing gives URIs: percent-coded, with an empty authority spelled out.
    same = F.regexp_replace("path", r"\A([A-Za-z][A-Za-z0-9+.-]*+:)///", "$1/")
    same = F.url_decode(F.replace(same, F.lit("+"), F.lit("%2B")))
    listing = spark.createDataFrame([(p,) for p in files.inputFiles()], "path string")
    empty = listing.select(same.alias("path")).join(files.select("path"), "path", "left_anti")
    return files.select("path", "content").unionByName(
        empty.withColumn("content", F.lit(b"").cast("binary"))
    )


def scan_module_files(
    spark: SparkSession,
    folder: str,
    skip: str | None = None,
    snapshot: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """``.sql`` files (any case) at any depth below ``folder``, or one such file.

    ``module_id, path, snapshot, sql``; ``sql`` is null where a file is no valid UTF-8 or may not
    be read, and empty where it has no bytes. Files below ``skip``, e.g. an output folder, are
    left out. The tasks list and read, each its folders (see ``sources/folder.py``); ``partitions``
    is the least number of tasks. Content is read once; to use both :func:`read_module_files`
    and :func:`bad_module_files`, filter this scan on ``sql`` instead.
    """
    if stores.known(folder):
        register(spark)
        source = spark.read.format("module_folder").option("path", folder)
        if skip:
            source = source.option("skip", skip)
        wanted = partitions or 2 * spark.sparkContext.defaultParallelism
        found = source.option("partitions", wanted).load()
    else:
        found = _scan_through_spark(spark, folder)
        if skip:
            found = found.filter(~_below(skip))
    return found.select(
        F.col("path").alias("module_id"),
        "path",
        F.lit(snapshot).cast("string").alias("snapshot"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("sql"),
    )


def read_module_files(
    spark: SparkSession, folder: str, skip: str | None = None, snapshot: str | None = None
) -> DataFrame:
    """The files of :func:`scan_module_files` that are valid UTF-8, empty ones included."""
    return scan_module_files(spark, folder, skip, snapshot).filter(F.col("sql").isNotNull())


def bad_module_files(spark: SparkSession, folder: str, skip: str | None = None) -> DataFrame:
    """Paths of the files that :func:`read_module_files` cannot read as UTF-8."""
    return scan_module_files(spark, folder, skip).filter(F.col("sql").isNull()).select("path")
