"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is described at each resolution by the mean and the deviation of its segments. For two
segments of m components, the inner product is at most m * mean * mean + deviation * deviation (the norms of
what is left when the mean is taken off), so the sum over the segments is an upper bound of
the score: the lower bound of the distance |q|^2 + |v|^2 - 2 <q, v>. Bounds go from coarse to fine; what can
still reach a query's k-th best score is computed exactly.

The queries are stored in files of `BLOCK` rows at most. Each task holds `CHUNK` rows of the table, goes
over the query files one after the other, and returns its k best per query that beat what is known: a query starts
with its k-th best score among the queries themselves, where these are rows of the table. A window
over (query) then takes the best k of all tasks; Spark cuts it to k per task before the shuffle.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows
without id; only vectors of equal length are compared (of no components: score 0); a row never finds rows of its
own id; repeated query rows count once if equal in all components; ties go to the smaller id; fewer than k
candidates give fewer rows; an empty table gives none. Scores must fit into 2**53, else an error is raised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modlens.llm.files import open_store
from modlens.session import shared_folder

BLOCK = 2048
CHUNK = 32_768
#: Queries whose bounds are worked out together.
TOGETHER = 64
#: Segments of the resolutions, coarse to fine.
SEGMENTS = (2, 8)
HITS = "query bigint, query_id bigint, vec_id bigint, score bigint"


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and the vector as doubles, of the rows that take part."""
    odd = F.exists(F.col(f"`{embedding}`"), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.where(F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{embedding}`").isNotNull()).where(~odd)
    return rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))


def quantized(rows: DataFrame, scale: int) -> DataFrame:
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")))


def matrices(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, places and rows of the vectors of each length."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield int(n), at, flat.reshape(len(at), int(n))


def statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """Means (times the root of the segment's length) and deviations, so that dot products are bounds."""
    parts = np.array_split(np.arange(rows.shape[1]), min(segments, max(1, rows.shape[1])))
    out = []
    for p in parts:
        some = rows[:, p]
        mean = some.mean(axis=1) if len(p) else np.zeros(len(rows))
        out += [mean * np.sqrt(len(p)), np.sqrt(((some - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(out, axis=1)


def search_chunk(queries: np.ndarray, own: np.ndarray, floors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, and ids and scores of the k best rows that reach its floor."""
    resolutions = [(statistics(queries, s), statistics(rows, s)) for s in SEGMENTS]
    for a in range(0, len(queries), TOGETHER):
        coarse = resolutions[0][0][a : a + TOGETHER] @ resolutions[0][1].T
        for i, bound in enumerate(coarse, start=a):
            floor = floors[i]
            allowed = ids != own[i]
            if np.isneginf(floor):
                # No score is known: that of the rows that look best is a floor for the others.
                first = np.flatnonzero(allowed)
                if len(first) > 4 * k:
                    first = first[np.argpartition(-bound[first], 4 * k)[: 4 * k]]
                known = np.sort(rows[first] @ queries[i])
                floor = known[-k] if len(known) >= k else floor
            left = np.flatnonzero(allowed & (bound + 1e-6 * (1 + np.abs(bound)) >= floor))
            for of_queries, of_rows in resolutions[1:]:
                finer = of_rows[left] @ of_queries[i]
                left = left[finer + 1e-6 * (1 + np.abs(finer)) >= floor]
            scores = rows[left] @ queries[i]
            good = scores >= floor
            left, scores = left[good], scores[good]
            if len(left) > k:
                near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                left, scores = left[near], scores[near]
            order = np.lexsort((ids[left], -scores))[:k]
            yield i, ids[left][order], scores[order]


def hits(rows: DataFrame, folder: str, k: int) -> DataFrame:
    """The best rows of each chunk for each stored query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith(".parquet"))

        def against(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = chunk.column("vec_id").to_numpy()
            sorted_rows = {n: (ids[at], v) for n, at, v in matrices(chunk.column("v").combine_chunks())}
            largest = {n: np.abs(v).max(initial=0) for n, (_, v) in sorted_rows.items()}
            for file in files:
                block = pq.ParquetFile(store.open_input_file(file)).read()
                numbers, names, floors = (block.column(c).to_numpy() for c in ("query", "query_id", "floor"))
                for n, at, queries in matrices(block.column("q").combine_chunks()):
                    if n not in sorted_rows:
                        continue
                    if n * largest[n] * np.abs(queries).max(initial=0) >= 2**53:
                        raise ValueError("scores are too large to be exact")
                    found = [(at[i], got, s) for i, got, s in search_chunk(queries, names[at], floors[at], sorted_rows[n][1], sorted_rows[n][0], k) if len(got)]
                    if found:
                        of = np.concatenate([np.full(len(got), i) for i, got, _ in found])
                        columns = [numbers[of], names[of], np.concatenate([got for _, got, _ in found]), np.concatenate([s for *_, s in found]).astype(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "query_id", "vec_id", "score"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                yield from against(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from against(pa.Table.from_batches(held))

    return rows.mapInArrow(run, HITS)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, queries: DataFrame, k: int, queries_are_rows: bool) -> DataFrame:
    """query_id, rank, vec_id, score. rows, queries: of usable() and quantized()."""
    spark = rows.sparkSession
    folder = shared_folder(spark, "top-k")
    stored = queries.distinct().select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.lit(float("-inf")).alias("floor"))
    stored.write.option("maxRecordsPerFile", BLOCK).parquet(f"{folder}/first")
    use = f"{folder}/first"
    if queries_are_rows:
        # The k-th best score among the queries is one that the whole table reaches, too.
        first = spark.read.parquet(use)
        kth = best(hits(first.select(F.col("query_id").alias("vec_id"), F.col("q").alias("v")), use, k), k).where(F.col("rank") == k).select("query", F.col("score").cast("double").alias("known"))
        use = f"{folder}/queries"
        first.join(kth, "query", "left").select("query", "query_id", "q", F.coalesce("known", "floor").alias("floor")).write.option("maxRecordsPerFile", BLOCK).parquet(use)
    return best(hits(rows, use, k), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
