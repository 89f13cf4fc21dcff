"""Golomb-coded exchange of fingerprints between the parts of a table and their owners.

Each part of a table sends every owner (a range of fingerprint values) its distinct fingerprints in that
range, sorted and Golomb-coded with Rice parameters, and how often it has each. An owner merges
what it gets and answers each part. Texts and ids stay where they are.

A part is so many rows on end of one Parquet file, so the answers find their part again however Spark cuts
files into tasks, then and later. A table that is no plain scan of Parquet files is stored first. Answers are
stored in the shared folder, a directory per part; a task reads those of the parts it works on, nothing larger.

An answer names the fingerprints again, Golomb-coded, with a byte each for how often they are; a bitmap in the order of
what was sent would do for duplicates alone. A part without rows with text sends nothing and gets nothing; a
table without rows has no parts, no messages and no answers.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.llm.files import open_store

#: Fingerprints that a task gathers before it sends: a bound of memory, not of results.
RUN = 1_500_000
#: Codes that are packed or unpacked at once.
STEP = 65_536
#: Fingerprints that one owner is to merge, about: a bound of memory, not of results.
OWNER_PRINTS = 8_000_000
SENT = "part string, owner long, codes binary, counts binary"
ANSWER = "part string, owner long, codes binary, classes binary"


def in_files(df: DataFrame) -> bool:
    """Whether the rows are those of Parquet files, in their order: projections and filters of one scan."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.getClass().getSimpleName() in ("Project", "Filter") and plan.deterministic():
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return False
    try:
        return df.select(df.metadataColumn("_metadata")["row_index"]).schema is not None
    except AnalysisException:  # no Parquet
        return False


def with_parts(df: DataFrame, columns: list[Column], rows: int, folder: str) -> DataFrame:
    """The columns after the part of each row; a part has at most so many rows."""
    if not in_files(df):
        df.select(*columns).write.parquet(f"{folder}/table")
        df = df.sparkSession.read.parquet(f"{folder}/table")
        columns = [df[f"`{name}`"] for name in df.columns]
    place = df.metadataColumn("_metadata")
    number = F.floor(place["row_index"] / rows).cast("string")
    return df.select(F.md5(F.concat_ws(" ", number, place["file_path"])).alias("part"), *columns)


def _pack(values: np.ndarray, bits: int) -> bytes:
    """The low bits of each value, one after the other."""
    if not bits:
        return b""
    out = []
    for a in range(0, len(values), STEP):  # STEP values fill whole bytes
        wide = values[a : a + STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        out.append(np.packbits(np.unpackbits(wide, axis=1)[:, 64 - bits :]).tobytes())
    return b"".join(out)


def _unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(n, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    raw = np.frombuffer(data, dtype=np.uint8)
    for a in range(0, n, STEP):
        count = min(STEP, n - a)
        flat = np.unpackbits(raw[a * bits // 8 : -(-(a + count) * bits // 8)])[: count * bits].reshape(count, bits)
        wide = np.zeros((count, 64), dtype=np.uint8)
        wide[:, 64 - bits :] = flat
        out[a : a + count] = np.packbits(wide, axis=1).view(">u8")[:, 0]
    return out


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted, distinct unsigned 64-bit values: the gaps' quotients in unary, then their remainders."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    gaps[1:] -= np.uint64(1)
    head = int(values[0])
    gaps[0] = 0
    mean = int(values[-1] - values[0]) // n
    bits = max(0, mean.bit_length() - 1)
    ends = np.cumsum((gaps >> np.uint64(bits)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, dtype=np.uint8)
    unary[ends] = 1
    packed = np.packbits(unary).tobytes()
    meta = np.array([n, bits, len(packed)], dtype="<u4").tobytes() + np.array([head], dtype="<u8").tobytes()
    return meta + packed + _pack(gaps & np.uint64((1 << bits) - 1), bits)


def golomb_decode(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    n, bits, size = (int(x) for x in np.frombuffer(data, dtype="<u4", count=3))
    head = np.frombuffer(data, dtype="<u8", count=1, offset=12)[0]
    unary = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=size, offset=20))
    ends = np.flatnonzero(unary)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    gaps = (quotients.astype(np.uint64) << np.uint64(bits)) | _unpack(data[20 + size :], n, bits)
    gaps[1:] += np.uint64(1)
    return head + np.cumsum(gaps, dtype=np.uint64)


def owner_count(df: DataFrame, prints: float) -> int:
    """How many owners share about so many fingerprints: no fewer than there are shuffle partitions."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, -(-int(prints) // OWNER_PRINTS))


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that a table of :func:`with_parts` is read from."""
    return int(str(df._jdf.queryExecution().optimizedPlan().collectLeaves().head().stats().sizeInBytes()))


def owner_of(values: np.ndarray, owners: int, bits: int) -> np.ndarray:
    """The owner of each value of so many bits (32 at least): equal ranges in the order of the values."""
    return ((values >> np.uint64(bits - 32)) * np.uint64(owners)) >> np.uint64(32)


def send(part: str, values: list[np.ndarray], owners: int, bits: int) -> pa.RecordBatch:
    """The messages of a part, a row per owner that it has fingerprints for."""
    distinct, counts = np.unique(np.concatenate(values), return_counts=True)
    ends = np.searchsorted(owner_of(distinct, owners, bits), np.arange(owners), side="right")
    rows = []
    start = 0
    for owner, end in enumerate(ends.tolist()):
        if end > start:
            rows.append((owner, golomb_encode(distinct[start:end]), zlib.compress(counts[start:end].astype("<u4").tobytes(), 1)))
        start = end
    return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "owner", "codes", "counts"])


def sender(fingerprints: Callable[[str], np.ndarray], owners: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows of (part, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = None, [], 0
        for batch in batches:
            parts = batch.column(0).to_pylist()
            for i, text in enumerate(batch.column(1)):
                if held and (parts[i] != part or size >= RUN):
                    yield send(part, held, owners, bits)
                    held, size = [], 0
                part = parts[i]
                found = fingerprints(text.as_py())
                if len(found):
                    held.append(found)
                    size += len(found)
        if held:
            yield send(part, held, owners, bits)

    return run


def answers(sent: DataFrame, folder: str, shared_only: bool) -> None:
    """Owners merge the messages and store their answers below the folder.

    classes: log2 of the number of rows with the fingerprint, a byte each. With shared_only,
    fingerprints of one row are left out.
    """

    def own(group: pd.DataFrame) -> pd.DataFrame:
        lists = [golomb_decode(c) for c in group["codes"]]
        values, place = np.unique(np.concatenate(lists), return_inverse=True)
        counts = np.frombuffer(b"".join(zlib.decompress(c) for c in group["counts"]), dtype="<u4")
        total = np.bincount(place, weights=counts).astype(np.int64)
        classes = (np.frexp(total.astype(np.float64))[1] - 1).astype(np.uint8)
        ends = np.cumsum([len(x) for x in lists])
        rows = []
        messages: dict[str, list[np.ndarray]] = {}
        for part, start, end in zip(group["part"], [0, *ends[:-1]], ends, strict=True):
            messages.setdefault(part, []).append(place[start:end])
        for part, places in messages.items():
            at = np.unique(np.concatenate(places)) if len(places) > 1 else places[0]
            if shared_only:
                at = at[total[at] > 1]
            if len(at):
                rows.append((part, int(group["owner"].iloc[0]), golomb_encode(values[at]), zlib.compress(classes[at].tobytes(), 1)))
        return pd.DataFrame(rows, columns=["part", "owner", "codes", "classes"])

    sent.groupBy("owner").applyInPandas(own, ANSWER).repartition("part").write.partitionBy("part").parquet(folder)


class Answers:
    """The answers of the parts that a task works on."""

    def __init__(self, folder: str):
        self.store, self.root = open_store(folder)
        self.part: str | None = None
        self.values = np.zeros(0, dtype=np.uint64)
        self.classes = np.zeros(0, dtype=np.uint8)

    def of(self, part: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their classes."""
        if part != self.part:
            rows: list[tuple[int, bytes, bytes]] = []
            for file in self.store.get_file_info(fs.FileSelector(f"{self.root}/part={part}", allow_not_found=True)):
                if file.path.endswith(".parquet"):
                    t = pq.ParquetFile(self.store.open_input_file(file.path)).read(columns=["owner", "codes", "classes"])
                    rows += zip(*(t.column(c).to_pylist() for c in ("owner", "codes", "classes")), strict=True)
            rows.sort(key=lambda r: r[0])
            none = [np.zeros(0, dtype=np.uint64)], [b""]
            lists, classes = ([golomb_decode(r[1]) for r in rows], [zlib.decompress(r[2]) for r in rows]) if rows else none
            self.part, self.values, self.classes = part, np.concatenate(lists), np.frombuffer(b"".join(classes), dtype=np.uint8)
        return self.values, self.classes
