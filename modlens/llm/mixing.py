"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

1. Sizes: the words of every document; the sizes of the sources; their targets by weight, where a source
   gives at most `most_repeats` times its size and the excess is reshared by weight.
2. Blocks: the documents of a source, in an order shuffled by a hash, form a stream that repeats as often
   as the target needs. Its words are cut into blocks of `block_words`.
3. Schedule: slot i takes the point frac(i * golden ratio) (as a 32-bit integer), which falls into one of the
   intervals of the cumulative targets; the slots of each source are ranked. A source has as many slots
   as its target has blocks: later slots are left out, lacking ones follow at the end.
4. The slot of rank r of a source joins block r of its stream; the last block ends at the target.

So each source gives its target to the word, and any part of the schedule is near the targets.

Nothing is kept per source in one task but sums: running sums over the documents of a source and ranks over
its slots go in two levels (within a bucket, then over bucket sums), so a source may hold any share.
One window runs over all sources (a row per source); the number of sources is small against the documents.

Defined results: a null text has no words; a null source is a source, the last; documents without words
are in no slot; rows of equal ids are different documents, equal rows are alike; an empty table gives an
empty mix. Columns besides id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modlens.session import shared_folder

BLOCK_WORDS = 4096
MOST_REPEATS = 3
#: 2**32 divided by the golden ratio: the step of the schedule's points.
GOLDEN_STEP = 2654435769
POINTS = 1 << 32
#: The points' range is cut into so many cells for the join with the sources' intervals.
CELLS = 4096
#: Slots ranked in one window.
CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def document_sizes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", content: Column | None = None) -> DataFrame:
    """A small stored row per document: row (unique), doc_id, source, size, content (of the caller, else a hash of the text)."""
    spark = df.sparkSession
    folder = shared_folder(spark, "mix-sizes")
    df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        words(text).alias("size"),
        (F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))) if content is None else content).alias("content"),
    ).write.parquet(folder)
    return spark.read.parquet(folder)


def source_targets(sizes: DataFrame, weights: Column | None = None, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, weight, target (double), goal (its whole words). weights: of `number`, the source's rank from 0."""
    weights = F.col("number") % 3 + 1 if weights is None else weights
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    sources = sources.withColumn("weight", weights.cast("long")).withColumn("most", F.lit(most_repeats) * F.col("source_size"))
    # By rising room per weight, sources fill up one after the other; the level of the rest is the largest one met.
    order = Window.orderBy(F.col("most") / F.col("weight"), "number")
    everything = Window.partitionBy()
    filled = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("level", (F.sum("source_size").over(everything) - filled) / open_weight)
    target = F.least(F.col("most").cast("double"), F.max("level").over(everything) * F.col("weight"))
    return sources.withColumn("target", target).select("source", "number", "source_size", "weight", "target", F.round("target").cast("long").alias("goal"))


def streams(sizes: DataFrame, seed: int) -> DataFrame:
    """Documents with words, with their place [start, start + size) in the shuffled stream of their source."""
    rows = sizes.where("size > 0").withColumn("order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))))
    rows = rows.withColumn("bucket", F.substring("order", 1, 3))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    base = sums.select("source", "bucket", (F.sum("total").over(Window.partitionBy("source").orderBy("bucket")) - F.col("total")).alias("base"))
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size", "content", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    joined = rows.withColumn("inside", inside).alias("r").join(base.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bucket") == F.col("b.bucket")))
    return joined.select("r.row", "r.doc_id", "r.source", "r.size", (F.col("b.base") + F.col("r.inside")).alias("start"))


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """Slots: position, source, rank."""
    spark = targets.sparkSession
    quotas = targets.where("goal > 0").withColumn("quota", F.ceil(F.col("goal") / block_words).cast("long"))
    slots = quotas.agg(F.sum("quota")).first()[0] or 0
    below = F.sum("goal").over(Window.orderBy("number"))
    scale = F.lit(POINTS).cast("decimal(20,0)") / F.sum("goal").over(Window.partitionBy()).cast("decimal(20,0)")
    low, high = (F.floor((x.cast("decimal(20,0)") * scale)).cast("long") for x in (below - F.col("goal"), below))
    cell = POINTS // CELLS
    intervals = quotas.withColumn("low", low).withColumn("high", high).where("high > low")
    intervals = intervals.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell)))).select("source", "quota", "low", "high", "cell")
    i = F.col("id") % POINTS  # the product below stays under 2**63 in two halves
    point = ((F.floor(i / 65536) * GOLDEN_STEP % 65536) * 65536 + i % 65536 * GOLDEN_STEP) % POINTS
    points = spark.range(slots).withColumn("point", point.cast("long")).withColumn("cell", F.floor(F.col("point") / cell))
    drawn = points.join(intervals, "cell").where("low <= point and point < high").withColumn("chunk", F.floor(F.col("id") / CHUNK))
    counts = drawn.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    base = counts.select("source", "chunk", (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("base"))
    ranked = drawn.withColumn("inside", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("id")) - 1).alias("r")
    ranked = ranked.join(base.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.chunk") == F.col("b.chunk")))
    ranked = ranked.select(F.col("r.id").alias("position"), "r.source", (F.col("b.base") + F.col("r.inside")).alias("rank"), "r.quota").where("rank < quota")
    got = counts.groupBy("source").agg(F.sum("n").alias("got")).alias("g")
    short = quotas.alias("q").join(got, F.col("q.source").eqNullSafe(F.col("g.source")), "left").select("q.source", "q.number", "q.quota", F.coalesce("g.got", F.lit(0)).alias("got")).where("got < quota")
    late = F.lit(slots) + F.coalesce(F.sum(F.col("quota") - F.col("got")).over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("got")
    lacking = short.withColumn("late", late).withColumn("rank", F.explode(F.sequence("got", F.col("quota") - 1)))
    return ranked.select("position", "source", "rank").unionByName(lacking.select((F.col("late") + F.col("rank")).alias("position"), "source", "rank"))


def mix(sizes: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """The mix, a row per document and block: position, source, block, row, doc_id, repeat, first_word, n_words."""
    slots = schedule(targets, block_words)
    t = targets.where("goal > 0").select("source", "source_size", "goal").alias("t")
    rows = streams(sizes, seed).alias("s").join(t, F.col("s.source").eqNullSafe(F.col("t.source")))
    rows = rows.select("s.row", "s.doc_id", "s.source", "s.size", "s.start", "t.source_size", "t.goal").where("start < goal")
    rows = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("goal") - 1 - F.col("start")) / F.col("source_size")))))
    rows = rows.withColumn("from", F.col("start") + F.col("repeat") * F.col("source_size"))
    rows = rows.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("goal")))
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block_words), F.floor((F.col("to") - 1) / block_words)))).alias("p")
    slots = slots.alias("k")
    joined = rows.join(slots, F.col("p.source").eqNullSafe(F.col("k.source")) & (F.col("p.block") == F.col("k.rank")))
    begin, end = F.greatest("p.from", F.col("p.block") * block_words), F.least("p.to", (F.col("p.block") + 1) * block_words)
    return joined.select("k.position", "p.source", "p.block", "p.row", "p.doc_id", "p.repeat", (begin - F.col("p.from")).alias("first_word"), (end - begin).alias("n_words"))


def taken_words(sizes: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """Every document with the words the mix takes of it."""
    taken = mixed.groupBy("row").agg(F.sum("n_words").alias("taken"))
    t = targets.select("source", "source_size", "target").alias("t")
    rows = sizes.join(taken, "row", "left").alias("s").join(t, F.col("s.source").eqNullSafe(F.col("t.source")))
    return rows.select("s.row", "s.doc_id", "s.source", "s.content", "s.size", "t.source_size", "t.target", F.coalesce("s.taken", F.lit(0)).alias("taken"))
