"""A training corpus from raw documents: toxicity, exact dedup, near dedup, mixing, BPE.

Each stage takes the documents that its predecessor kept, is written as Parquet, and read again.

* `toxicity` drops the documents that op4 calls toxic, from the same score on (null texts stay).
* `exact_dedup` keeps the row of the largest doc_id of equal texts, of repeated rows one.
* `near_dedup` keeps the document of the smallest doc_id of each component of linked texts.
* `source_mix` repeats each document as often as the mix takes its words, to the nearest whole number, so
  that texts stay whole; documents without words, of which a mix takes nothing, stay once.
* `bpe` adds the ids of each text; its decoded form is stored as a digest.

An empty table passes all stages. Columns besides those of documents pass through the first four, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modlens.llm import bpe as bpe_codec
from modlens.llm import exact, mixing, ngram_join
from modlens.llm import toxicity as toxic
from modlens.llm.bpe import unused
from modlens.llm.queries import TOXIC_FROM, held_out, vocabulary
from modlens.session import shared_folder, ship_package
from modlens.sources import stores

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

def keyed(docs: DataFrame, name: str = "__key") -> tuple[DataFrame, str]:
    """With a key of the row's id and text, as ids need not be unique; and the key's name, which the table lacks."""
    name = unused(docs, name)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in ("doc_id", "text")]
    return docs.withColumn(name, F.md5(F.concat_ws("\x00", *parts))), name


def first_of(rows: DataFrame, key: str) -> Column:
    """Rank of a row among those of its key, by the columns of documents."""
    return F.row_number().over(Window.partitionBy(key).orderBy("source", "lang", "n_chars"))


def chosen(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of each key of keys (a single column)."""
    rows, key = keyed(docs)
    rows = rows.join(keys.toDF(key).distinct(), key, "left_semi")
    first = unused(rows, "__first")
    return rows.withColumn(first, first_of(rows, key)).where(F.col(first) == 1).select(*docs.columns)


def kept_keys(docs: DataFrame, operator: Callable[..., DataFrame], kept: str) -> DataFrame:
    """The keys of the rows that a dedup operator keeps: it gets id and key as the id, and the text."""
    rows, key = keyed(docs)
    done = operator(rows.select(F.struct("doc_id", F.col(key).alias("key")).alias("row"), "text"), "row").where(kept)
    return done.select("doc_id.key")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    score = unused(docs, "__toxicity")
    scored = toxic.toxicity_scores(docs, toxic.train(docs, labels), score=score)
    return scored.where(F.col(score) < TOXIC_FROM).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return chosen(docs, kept_keys(docs, exact.exact_duplicates, "kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return chosen(docs, kept_keys(docs, ngram_join.ngram_components, "keeper"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    sizes = mixing.document_sizes(rows, content=F.col(key))
    targets = mixing.source_targets(sizes)
    taken = mixing.taken_words(sizes, targets, mixing.mix(sizes, targets))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5))
    all_copies, all_rows, own, copy = (unused(rows, f"__{n}") for n in ("copies", "rows", "own", "copy"))
    totals = taken.groupBy(F.col("content").alias(key)).agg(F.sum(copies).alias(all_copies), F.count("*").alias(all_rows))
    rows = rows.join(totals, key)
    extra = F.when(first_of(rows, key) <= F.col(all_copies) % F.col(all_rows), 1).otherwise(0)
    rows = rows.withColumn(own, (F.floor(F.col(all_copies) / F.col(all_rows)) + extra).cast("int"))
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(own)))).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    coded = bpe_codec.bpe_round_trip(docs.select("doc_id", "source", "lang", "text"), vocabulary("word_bpe_49k.json"))
    return coded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe", bpe),
]

#: SQL can express neither the classifier nor BPE; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the rows of the last.

    What a stage has written is removed when the next one has used it, on stores that the driver can open.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    former = None
    for number, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if former and stores.known(former):
            store = stores.open_store(former)
            store.remove(store.root)
        former = out
    return docs
