"""Sets of tables that change all at once or not at all.

Parts are written to folders of their own that nothing reads yet. Then one small file is added to the manifest,
which names the folder of each part; Spark's commit shows it whole or not at all. Readers take the
manifest of the highest number, so they see the former set until that moment, and the new one from then on. What a
writer that failed has left behind is named nowhere. There is one writer at a time; should two commit the same
number, the one with the greater name counts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modlens.sources.stores import open_store

MANIFEST = "number long, name string, part string, place string, schema string"


def _manifests(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, folder: str) -> tuple[int, dict[str, str]]:
    """Number of the latest set (-1 if there is none), and the folder of each of its parts.

    A set has few parts: tables, or buckets of a table.
    """
    manifests = _manifests(spark, folder)
    if manifests is None:
        return -1, {}
    last = manifests.agg(F.max(F.struct("number", "name")).alias("last")).first().last
    if last is None:
        return -1, {}
    rows = manifests.where((F.col("number") == last.number) & (F.col("name") == last.name)).collect()
    return last.number, {r.part: f"{folder}/{r.place}" for r in rows}


def new_place(folder: str) -> str:
    """A folder below which parts of a set to come can be written."""
    return f"{folder}/data/{uuid.uuid4().hex}"


def schemas(spark: SparkSession, folder: str) -> dict[str, T.StructType]:
    """The schemas given with the latest set's parts; a table without rows may have no files."""
    number, parts = current(spark, folder)
    rows = _manifests(spark, folder).where((F.col("number") == number) & F.col("schema").isNotNull()).collect() if parts else []
    return {r.part: T.StructType.fromJson(json.loads(r.schema)) for r in rows if f"{folder}/{r.place}" == parts.get(r.part)}


def commit(
    spark: SparkSession,
    folder: str,
    number: int,
    parts: dict[str, str],
    schemas: dict[str, T.StructType] | None = None,
) -> None:
    """Makes the parts, in folders of :func:`new_place`, the set of that number."""
    name = uuid.uuid4().hex
    forms = {part: schema.json() for part, schema in (schemas or {}).items()}
    rows = [(number, name, part, place.removeprefix(f"{folder}/"), forms.get(part)) for part, place in sorted(parts.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Removes the folders that none of the last ``keep`` sets names; their paths.

    To be run while nobody writes, and nobody reads an older set.
    """
    number, _ = current(spark, folder)
    manifests = _manifests(spark, folder)
    if manifests is None:
        return []
    kept = {r.place.split("/")[1] for r in manifests.where(F.col("number") > number - keep).select("place").distinct().collect()}
    store = open_store(folder)
    gone = [e.path for e in store.entries(f"{store.root}/data") if e.folder and e.path.rsplit("/", 1)[1] not in kept]
    for path in gone:
        store.remove(path)
    return gone
