"""Analysis by content: each distinct text once, however many modules have it.

Repository dumps, catalog exports of many databases and query logs repeat their texts: deployed copies of
a procedure are equal. So texts are addressed by their SHA-256. Each task drops the repeats it sees before
anything is shuffled, the distinct texts are analyzed and stored, and modules get the traces of their text by
a join on the address. An address that very many modules share is joined in parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.functions.identifiers import file_stem
from modlens.plans.analyze import analyze
from modlens.session import shared_folder
from modlens.sources.config import RuleConfig

#: A text of more modules than this is joined in ``SALTS`` parts.
HOT_TEXTS, SALTS = 100_000, 64


def text_address(sql: str = "sql"):
    """32 bytes that stand for a text."""
    return F.unhex(F.sha2(sql, 256))


def text_traces(modules: DataFrame, config: RuleConfig | None = None) -> DataFrame:
    """One trace per distinct text: ``text_id`` in place of module, path and snapshot.

    The shuffle carries each distinct text once per task that has it.
    """
    texts = modules.select(text_address().alias("text_id"), "sql").dropDuplicates(["text_id"])
    traces = analyze(texts.withColumn("module_id", F.lit("")).drop("path", "snapshot"), config, keep=("text_id",))
    return traces.drop("module_id", "path", "snapshot", "procedure")


def analyze_shared(
    modules: DataFrame,
    config: RuleConfig | None = None,
    folder: str | None = None,
    hot_texts: int = HOT_TEXTS,
) -> DataFrame:
    """What :func:`analyze` gives, and ``copies``, the number of modules with the same text.

    The distinct texts' traces are written to ``folder`` (a new one of the shared folder if none is
    given) and read back, so tables derived from the result do not analyze again. Modules of a
    null text are left out, as a table scan does.
    """
    spark = modules.sparkSession
    folder = folder or shared_folder(spark, "texts")
    for optional in ("path", "snapshot"):
        if optional not in modules.columns:
            modules = modules.withColumn(optional, F.lit(None).cast("string"))
    modules = modules.where("sql IS NOT NULL")
    found = text_traces(modules, config)
    found.write.parquet(folder)
    stored = spark.read.schema(found.schema).parquet(folder)
    named = modules.select("module_id", "path", "snapshot", text_address().alias("text_id"))
    counted = named.groupBy("text_id").agg(F.count("*").alias("copies"))
    # Hot texts are fewer than modules / hot_texts.
    hot = F.broadcast(counted.where(F.col("copies") > hot_texts).select("text_id", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("module_id", "path"), F.lit(SALTS))).otherwise(0)
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = named.join(hot, "text_id", "left").withColumn("salt", salt.cast("int")).drop("hot")
    right = stored.join(counted, "text_id").join(hot, "text_id", "left")
    right = right.withColumn("salt", F.explode(parts)).drop("hot")
    joined = left.join(right.hint("merge"), ["text_id", "salt"])
    return joined.select(
        "module_id",
        "path",
        "snapshot",
        "name",
        F.coalesce("name", F.expr(file_stem("coalesce(path, module_id)"))).alias("procedure"),
        "body",
        "parameters",
        "dependencies",
        "temp_tables",
        "statements",
        "rule_ids",
        "metrics",
        "copies",
    )
