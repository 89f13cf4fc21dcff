"""Token ids as length-delimited binary records, with an offset index apart.

A shard file is a sequence of frames: length (8 bytes), masked CRC-32C of the length, the record, masked
CRC-32C of the record; all little-endian. This is the framing that training readers know as TFRecord. A
record holds the document's id (8 bytes, signed), a byte that says whether there is an id, the bytes
per token id (1 byte) and the token ids.

The index is a Parquet table with a row per record: file, offset, length, doc_id, n_tokens and start
(ids before the record). It is written by Spark, so it lists only the files of tasks that ended well: a
task that is run again writes a file of another name, and what a lost attempt left is never read. A
reader can shuffle the index and fetch records in any order.

Defined results: a null text counts as empty and gives the end id only; rows with a null id come first;
rows of equal ids lie by text, and equal rows lie side by side; an empty table gives an empty index.
Other columns are not stored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modlens.llm import memory, pieces
from modlens.llm.bpe import text_slices
from modlens.llm.crc32c import crc32c, masked
from modlens.llm.files import open_store

#: Bytes of text per block that is encoded and written at once.
BLOCK_BYTES = 2_000_000
HEAD = "<qBB"
INDEX = "shard int, line long, file string, offset long, length long, doc_id long, n_tokens long"


def frame(records: list[bytes]) -> list[bytes]:
    """Records with lengths and masked checksums."""
    lengths = [struct.pack("<Q", len(r)) for r in records]
    checks = masked(crc32c([*lengths, *records])).astype("<u4")
    n = len(records)
    return [lengths[i] + checks[i].tobytes() + records[i] + checks[n + i].tobytes() for i in range(n)]


def unframe(frames: list[bytes]) -> list[bytes]:
    """The records of frames; raises if a length or checksum is wrong."""
    lengths = [struct.unpack_from("<Q", f)[0] for f in frames]
    if any(len(f) != n + 16 for f, n in zip(frames, lengths, strict=True)):
        raise ValueError("a record is cut off")
    records = [f[12:-4] for f in frames]
    stored = [struct.unpack_from("<I", f, 8)[0] for f in frames] + [struct.unpack_from("<I", f, len(f) - 4)[0] for f in frames]
    if (masked(crc32c([*(f[:8] for f in frames), *records])) != np.array(stored, dtype=np.uint32)).any():
        raise ValueError("a record fails its checksum")
    return records


def write_token_records(df: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes shards in ascending order of the ids and the index; the index. One shuffle, by range of the id."""
    spark = df.sparkSession
    rows = (
        df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.only("pieces", pieces.load.cache_clear)
        bpe = pieces.load(tokenizer)
        shard = TaskContext.get().partitionId()
        first = next(batches, None)
        if first is None:
            return
        store, root = open_store(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec"
        store.create_dir(root, recursive=True)
        line = offset = 0
        end = np.array([end_id], dtype=bpe.wide).tobytes()
        with store.open_output_stream(f"{root}/{name}") as out:
            for batch in (b for some in ([first], batches) for b in some):
                keys, texts = batch.column(0).to_pylist(), batch.column(1)
                for a, b in text_slices(texts, BLOCK_BYTES):
                    coded = [c + end for c in bpe.ids(texts.slice(a, b - a).to_pylist())]
                    frames = frame([struct.pack(HEAD, k or 0, k is not None, bpe.wide.itemsize) + c for k, c in zip(keys[a:b], coded, strict=True)])
                    lengths = np.array([len(f) for f in frames], dtype=np.int64)
                    out.write(b"".join(frames))
                    n = b - a
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, shard, dtype=np.int32)),
                            pa.array(np.arange(line, line + n)),
                            pa.array([name] * n, pa.string()),
                            pa.array(offset + np.cumsum(lengths) - lengths),
                            pa.array(lengths),
                            pa.array(keys[a:b], pa.int64()),
                            pa.array(np.array([len(c) // bpe.wide.itemsize for c in coded], dtype=np.int64)),
                        ],
                        names=["shard", "line", "file", "offset", "length", "doc_id", "n_tokens"],
                    )
                    line, offset = line + n, offset + int(lengths.sum())

    rows.mapInArrow(write, INDEX).write.parquet(f"{folder}/parts")
    parts = spark.read.schema(INDEX).parquet(f"{folder}/parts")
    # Ids before each shard: one row per shard is added up, then the records of a shard on their own.
    shards = parts.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("line")) - F.col("n_tokens")
    index = parts.withColumn("inside", inside).join(shards, "shard").select("shard", "line", "file", "offset", "length", "doc_id", "n_tokens", (F.col("base") + F.col("inside")).alias("start"))
    index.write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX + ", start long").parquet(f"{folder}/index")


def read_token_records(index: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """The records that the index rows name, checked: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array of int)."""
    # The rows of a file lie together, so that a task opens few files and reads each from front to back. The
    # number of partitions is given, as the index is small against the records that its rows stand for.
    partitions = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = index.select("file", "offset", "length", "start").repartition(partitions, "file").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        name, source = None, None
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                files, offsets, lengths, starts = (c.to_pylist() for c in part.columns)
                frames = []
                for file, offset, length in zip(files, offsets, lengths, strict=True):
                    if file != name:
                        if source:
                            source.close()
                        name, source = file, store.open_input_file(f"{root}/{file}")
                    source.seek(offset)
                    frames.append(source.read(length))
                keys, ids = [], []
                for record in unframe(frames):
                    key, there, width = struct.unpack_from(HEAD, record)
                    keys.append(key if there else None)
                    ids.append(np.frombuffer(record, dtype=f"<u{width}", offset=struct.calcsize(HEAD)).astype("<u4"))
                columns = {
                    "doc_id": pa.array(keys, pa.int64()),
                    "start": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                }
                if with_ids:
                    ends = np.zeros(len(ids) + 1, dtype=np.int32)
                    np.cumsum([len(i) for i in ids], out=ends[1:])
                    columns["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)
        if source:
            source.close()

    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
