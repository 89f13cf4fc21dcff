"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Every part sends the sorted 64-bit fingerprints of its texts to their owners (see exchange.py).
2. The owners answer with a class for each (0: one row has it; higher: more than one).
3. Each part finds its suspects. Equal suspects of a task, compared as texts, are
   represented by one of them, so a group of copies sends one text per task, whatever its size.
4. Only the representatives' texts are shuffled, and grouped by their bytes. Other rows move without text.

Texts are equal when their code points are; a null text counts as empty. The row of the largest id stays; a
null id is the smallest; of repeated rows with that id one stays. Ids need not be unique. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.exchange import SENT, Answers, answers, owner_count, sender, with_parts
from modlens.session import shared_folder

#: Rows of a part, each with one fingerprint.
PART_ROWS = 1 << 18
#: Characters of representatives that a task holds; beyond, it starts anew with further ones.
HELD_CHARS = 24_000_000


def digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def fingerprint(text: str) -> np.ndarray:
    return np.frombuffer(digest(text), dtype=">u8", count=1).astype(np.uint64)


def find_suspects(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A stored row per document: row, doc_id, sha256, and for suspects same_as (row of the representative) and its text."""
    spark = df.sparkSession
    folder = shared_folder(spark, "exact-dedup")
    texts = with_parts(df, [F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{doc_id}`").alias("doc_id")], PART_ROWS, folder)
    owners = owner_count(texts, texts.count())  # counted from the files' footers
    sent = texts.select("part", "text").mapInArrow(sender(fingerprint, owners, 64), SENT)
    answers(sent, f"{folder}/answers", shared_only=False)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Answers(f"{folder}/answers")
        number = TaskContext.get().partitionId() << 33
        held: dict[str, int] = {}
        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                some = batch.slice(start, 1000)
                parts, texts = some.column(0).to_pylist(), some.column(1).to_pylist()
                digests = [digest(t) for t in texts]
                values = np.array([int.from_bytes(d[:8], "big") for d in digests], dtype=np.uint64)
                same, sent_texts = [], []
                for i, (part, t) in enumerate(zip(parts, texts, strict=True)):
                    known, classes = got.of(part)
                    at = int(np.searchsorted(known, values[i]))
                    if at == len(known) or known[at] != values[i]:
                        raise ValueError("the table changed while it was read")
                    row, first = number + i, False
                    if classes[at]:
                        if size > HELD_CHARS:
                            held, size = {}, 0
                        row = held.setdefault(t, row)
                        first = row == number + i
                        size += len(t) if first else 0
                    same.append(row if classes[at] else None)
                    sent_texts.append(t if first else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(number, number + len(texts))), some.column(2), pa.array([d.hex() for d in digests], pa.string()), pa.array(same, pa.int64()), pa.array(sent_texts, pa.string())],
                    names=["row", "doc_id", "sha256", "same_as", "text"],
                )
                number += len(texts)

    kind = df.schema[doc_id].dataType.simpleString()
    texts.mapInArrow(mark, f"row long, doc_id {kind}, sha256 string, same_as long, text string").write.parquet(f"{folder}/rows")
    return spark.read.parquet(f"{folder}/rows")


def exact_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = find_suspects(df, doc_id, text)
    suspects = rows.where("same_as IS NOT NULL")
    members = suspects.groupBy("same_as").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("last"))
    speakers = suspects.where("text IS NOT NULL").select(F.col("row").alias("same_as"), "sha256", "text").join(members, "same_as")
    groups = speakers.groupBy("sha256", "text").agg(F.sum("n").alias("group_size"), F.max("last").alias("keep"))
    verified = speakers.select("same_as", "sha256", "text").join(groups, ["sha256", "text"]).select("same_as", "group_size", "keep")
    alone = rows.where("same_as IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha256").alias("text_sha256"))
    together = suspects.select("row", "doc_id", "sha256", "same_as").join(verified, "same_as")
    return alone.unionByName(together.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("keep.row") == F.col("row")).alias("kept"), F.col("sha256").alias("text_sha256")))
