"""The latest trace of every module, kept up to date by arrivals.

Traces lie in buckets by a hash of their module, a bucket in layers: one per set that added to it. A batch of modules first
drops what it has twice, then looks up, in its own buckets only, which modules are there with the same text, path and
snapshot: those are neither analyzed nor written. The others are dealt out as texts, analyzed where they are written, and
become a layer of their buckets; the layers below stay as they are. A layer that brings modules anew has a list of
them next to it, which readers leave out of the layers below. A bucket of ``LAYERS`` layers is written anew as one. One
commit then shows the new layers (see ``sources/versions.py``). So a batch that is run again, because its
first run failed or was not recorded, finds either nothing done or nothing to do.

Summaries are sums: modules by risk level, by rule, and by object and operation, of each layer, less those of the traces it
replaces. Figures of the whole store are added up from them without going over the traces.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from modlens import schemas
from modlens.functions.identifiers import is_external
from modlens.operators.rules import rule_catalog
from modlens.plans.analyze import analyze
from modlens.sources import versions
from modlens.sources.config import RuleConfig

#: What a bucket's summary counts.
SUMMARY = "kind string, key string, modules long"
_KEPT = ("bucket", "state")
#: Modules of which the layers below have older traces.
GONE = "module_id string, gone long"
#: A bucket of so many layers becomes one when it is next added to.
LAYERS = 8
#: Modules that are worth a task, and those that are enough for one.
_FEW, _MANY = 1000, 200_000


class Layer(NamedTuple):
    number: int  # of the set that added it
    replaces: bool  # whether the layers below have traces of its modules
    place: str


Layers = dict[int, list[Layer]]


class TraceStore:
    """Traces by module in ``buckets`` parts; how many is fixed when the folder is first written.

    A bucket is the least that is rewritten: choose as many as make one a task's work (a few
    hundred MB), in the thousands for a corpus of terabytes. ``files`` parts of a bucket's layer, or as many
    more as its modules and the cluster ask for, are written by tasks of their own.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        buckets: int = 64,
        config: RuleConfig | None = None,
        files: int = 1,
    ):
        self.spark, self.folder, self.buckets, self.config, self.files = spark, folder, buckets, config, files
        empty = spark.createDataFrame([], schemas.MODULES)
        fields = analyze(empty, config).schema.fields
        self.schema = T.StructType([*fields, T.StructField("state", T.BinaryType()), T.StructField("arrived", T.TimestampType()), T.StructField("set", T.LongType())])

    def _layers(self) -> tuple[int, Layers]:
        """Number of the latest set, and the layers of each bucket, the oldest first."""
        number, parts = versions.current(self.spark, self.folder)
        if parts and parts.pop("buckets", "").rsplit("/", 1)[-1] != str(self.buckets):
            raise ValueError(f"{self.folder} was written with another number of buckets")
        layers: Layers = {}
        for part, place in parts.items():
            # "3.7r" is what set 7 added to bucket 3 with a list of replaced modules, "3" a bucket of a store without layers.
            bucket, _, added = part.partition(".")
            layers.setdefault(int(bucket), []).append(Layer(int(added.rstrip("r") or -1), added.endswith("r"), place))
        return number, {bucket: sorted(found) for bucket, found in layers.items()}

    def _places(self) -> tuple[int, dict[int, str]]:
        """Number of the latest set, and where each bucket was last added to."""
        number, layers = self._layers()
        return number, {bucket: found[-1].place for bucket, found in layers.items()}

    def _read(self, layers: Layers, kind: str, schema: T.StructType | str, some=None) -> DataFrame:
        chosen = [f"{x.place}/{kind}/bucket={b}" for b, found in layers.items() if some is None or b in some for x in found]
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*chosen)

    def _live(self, layers: Layers, some=None) -> DataFrame:
        """Traces of the buckets that no later layer has replaced."""
        found = self._read(layers, "traces", self.schema, some)
        later = {b: [x for x in of if x.replaces] for b, of in layers.items() if some is None or b in some}
        if not any(later.values()):
            return found
        gone = self._read(later, "gone", GONE).groupBy(F.col("module_id").alias("gone_id")).agg(F.max("gone").alias("gone"))
        older = (F.col("module_id") == F.col("gone_id")) & (F.coalesce("set", F.lit(-1)) < F.col("gone"))
        return found.join(gone, older, "left_anti")

    def _known(self, layers: Layers, some) -> DataFrame:
        """``module_id, former``: the state of the latest trace of each module."""
        found = self._read(layers, "traces", self.schema, some)
        if not any(x.replaces for b in some for x in layers.get(b, ())):
            return found.select("module_id", F.col("state").alias("former"))
        return found.groupBy("module_id").agg(F.max_by("state", F.coalesce("set", F.lit(-1))).alias("former"))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("module_id"), F.lit(self.buckets)).cast("int")

    def traces(self) -> DataFrame:
        """The latest trace of each module, as :func:`modlens.analyze` gives it, with ``arrived``."""
        return self._live(self._layers()[1]).drop("state", "set")

    def upsert(self, modules: DataFrame) -> int:
        """Takes in modules; the number of the store's set after it, the same as before if nothing changed.

        Of rows of one module the one with the greatest path and text counts. Rows without a text
        are left out.
        """
        number, layers = self._layers()
        place, scratch = versions.new_place(self.folder), versions.new_place(self.folder)
        for optional in ("path", "snapshot"):
            if optional not in modules.columns:
                modules = modules.withColumn(optional, F.lit(None).cast("string"))
        one = F.max_by(F.struct("path", "snapshot", "sql"), F.struct("path", "sql", "snapshot")).alias("m")
        fields = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in ("path", "snapshot", "sql")]
        arrived = modules.where("sql IS NOT NULL AND module_id IS NOT NULL").groupBy("module_id").agg(one).select("module_id", "m.*")
        arrived = arrived.withColumns({"state": F.unhex(F.sha2(F.concat(*fields), 256)), "bucket": self._bucket()})
        # A batch is read several times, so it is kept until it is done.
        arrived.write.parquet(f"{scratch}/arrived")
        schema = T.StructType([*schemas.MODULES.fields, T.StructField("state", T.BinaryType()), T.StructField("bucket", T.IntegerType())])
        arrived = self.spark.read.schema(schema).parquet(f"{scratch}/arrived")
        touched = {r.bucket for r in arrived.select("bucket").distinct().collect()}
        changed = arrived.join(self._known(layers, touched), "module_id", "left").where("former IS NULL OR former != state")
        changed = changed.select(*schema.names, F.col("former").isNotNull().alias("old"))
        changed.write.parquet(f"{scratch}/changed")
        changed = self.spark.read.schema(changed.schema).parquet(f"{scratch}/changed")
        counts = changed.groupBy("bucket").agg(F.count("*").alias("modules"), F.max("old").alias("old")).collect()
        rewritten = {r.bucket: r.modules for r in counts}
        if not rewritten:
            return number
        fresh = analyze(self._dealt(changed, rewritten), self.config, keep=_KEPT)
        fresh = fresh.withColumns({"arrived": F.current_timestamp(), "set": F.lit(number + 1).cast("long")})
        fresh.write.partitionBy("bucket").parquet(f"{place}/traces")
        full = {b for b in rewritten if len(layers.get(b, ())) >= LAYERS}
        again = changed.where("old").select("module_id", "bucket")
        if full:
            left = self._live(layers, full).join(again.select("module_id"), "module_id", "left_anti").withColumn("bucket", self._bucket())
            left.repartition("bucket", self._share(self.files)).write.mode("append").partitionBy("bucket").parquet(f"{place}/traces")
        replaced = {r.bucket for r in counts if r.old} - full
        if replaced:
            gone = again.where(F.col("bucket").isin(replaced)).withColumn("gone", F.lit(number + 1).cast("long"))
            gone.repartition("bucket").write.partitionBy("bucket").parquet(f"{place}/gone")
        added = {b: Layer(number + 1, b in replaced, place) for b in rewritten}
        former = self._live(layers, replaced).join(again.select("module_id"), "module_id", "left_semi") if replaced else None
        self._summarize({b: [x] for b, x in added.items()}, former, place)
        layers = {**layers, **{b: [*([] if b in full else layers.get(b, ())), x] for b, x in added.items()}}
        parts = {
            f"{b}.{x.number}{'r' * x.replaces}" if x.number >= 0 else str(b): x.place for b, found in layers.items() for x in found
        }
        versions.commit(self.spark, self.folder, number + 1, parts | {"buckets": f"{self.folder}/data/{self.buckets}"})
        return number + 1

    def _share(self, files: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(1), "module_id"), F.lit(files)).cast("int")

    def _dealt(self, changed: DataFrame, rewritten: dict[int, int]) -> DataFrame:
        """Texts in the tasks that analyze and write them, each of one bucket; it is they that are shuffled, not traces."""
        most, cores = max(rewritten.values()), self.spark.sparkContext.defaultParallelism
        wanted = max(math.ceil(2 * cores / len(rewritten)), math.ceil(most / _MANY))
        files = max(self.files, min(math.ceil(most / _FEW), wanted))
        places = {b: k for k, b in enumerate(sorted(rewritten))}
        # An array with a place for each bucket, so that each finds its own by its number.
        first = F.get(F.lit([places.get(b, 0) * files for b in range(self.buckets)]), F.col("bucket"))
        dealt = changed.drop("old").repartitionById(len(rewritten) * files, first + self._share(files))
        # Sorted already, as the writer wants it: it would sort the traces.
        return dealt.sortWithinPartitions("bucket")

    def _summarize(self, added: Layers, former: DataFrame | None, out: str) -> None:
        """Sums of the layers, less those of the traces they replace."""
        counted = self._read(added, "traces", self.schema).withColumn("n", F.lit(1))
        if former is not None:
            counted = counted.unionByName(former.withColumn("n", F.lit(-1)))
        entries = F.concat(
            F.array(F.struct(F.lit("level").alias("kind"), F.col("metrics.risk_level").alias("key"))),
            F.transform("rule_ids", lambda r: F.struct(F.lit("rule").alias("kind"), r.alias("key"))),
            # A module counts once for an object and operation, however often it has them.
            F.transform(
                F.array_distinct(F.transform("dependencies", lambda d: F.concat(d["operation"], F.lit(" "), d["object"]))),
                lambda d: F.struct(F.substring_index(d, " ", 1).alias("kind"), F.substring_index(d, " ", -1).alias("key")),
            ),
        )
        rows = counted.select(self._bucket().alias("bucket"), "n", F.explode(entries).alias("e")).select("bucket", "n", "e.*")
        sums = rows.groupBy("bucket", "kind", "key").agg(F.sum("n").alias("modules"))
        # Sums of nothing stay, so that each layer has a summary.
        sums.write.partitionBy("bucket").parquet(f"{out}/summary")

    def _summary(self) -> DataFrame:
        return self._read(self._layers()[1], "summary", SUMMARY)

    def risk_summary(self) -> DataFrame:
        """As of all traces: modules, and those of each level."""
        level = self._summary().where("kind = 'level'")
        counts = {"scanned": F.lit(True), **{n.lower(): F.col("key") == n for n in ("High", "Medium", "Low")}}
        return level.agg(*[F.coalesce(F.sum(F.when(c, F.col("modules"))), F.lit(0)).alias(n) for n, c in counts.items()])

    def findings_by_rule(self) -> DataFrame:
        counts = self._summary().where("kind = 'rule'").groupBy(F.col("key").alias("rule_id")).agg(F.sum("modules").alias("modules"))
        catalog = rule_catalog(self.spark, self.config).select("rule_id", "severity", "rank")
        return counts.where("modules > 0").join(F.broadcast(catalog), "rule_id").select("rule_id", "severity", "rank", "modules")

    def object_usage(self) -> DataFrame:
        """Modules that read, write and execute each object."""
        uses = {"readers": "Read", "writers": "Write", "callers": "Execute"}
        found = self._summary().where(F.col("kind").isin(*uses.values())).groupBy(F.col("key").alias("object"))
        sums = [F.coalesce(F.sum(F.when(F.col("kind") == o, F.col("modules"))), F.lit(0)).alias(n) for n, o in uses.items()]
        counts = found.agg(*sums).where("readers > 0 OR writers > 0 OR callers > 0")
        return counts.withColumn("is_external", F.expr(is_external("object")))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes what the last ``keep`` sets do not name, arrivals that are taken in among it."""
        return versions.vacuum(self.spark, self.folder, keep)


def keep_traces(modules: DataFrame, store: TraceStore, checkpoint: str) -> StreamingQuery:
    """Takes all that is new in the stream ``modules`` into the store, batch by batch, then stops.

    What was seen is kept in ``checkpoint``, on shared storage as the store.
    """
    return (
        modules.writeStream.foreachBatch(lambda batch, _: store.upsert(batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
