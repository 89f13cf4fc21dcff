"""A data source of the `.sql` files below a folder, listed and read by the tasks.

The driver lists folders from the top only until it knows as many as there shall be partitions, and keeps no files. A
partition is then one folder (and, for the last level listed, all below it): its task lists it, reads its files and gives rows.
Where there are fewer folders than partitions, several tasks list the same folder and each reads its own share of the
files, by a hash of their names; so a flat folder of a million files is read by all tasks.

Files of no bytes are rows with an empty content. A file that may not be read has a null content, a file or folder that went
since it was listed has no row, and every other error fails the task, which Spark runs again.

As a stream, every batch has the files whose latest change lies between the last batch and now. A file must be put in place
in one step (written elsewhere and moved, or uploaded), as for Spark's own file streams.
"""

from __future__ import annotations

import time
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from modlens.session import ship_package
from modlens.sources.stores import Entry, Local, Remote, open_store

#: Bytes of content in one batch of rows: a bound of memory (a single file may be larger).
BATCH_BYTES = 8_000_000
SCHEMA = "path string, length long, content binary"
ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])


class Share(InputPartition):
    """Every `of`-th file (number `number`) of a folder, or of all below it; since, until: times of change."""

    def __init__(self, folder: str, below: bool, number: int, of: int, since: int, until: int | None):
        self.folder, self.below, self.number, self.of, self.since, self.until = folder, below, number, of, since, until


class Folder:
    """What readers of both kinds do."""

    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.skip = options.get("skip")
        self.wanted = max(1, int(options.get("partitions", 64)))
        self.suffix = options.get("suffix", ".sql").lower()

    def skipped(self, store: Local | Remote) -> str | None:
        return open_store(self.skip).root if self.skip else None

    def named(self, entry: Entry) -> bool:
        name = entry.path.rsplit("/", 1)[-1]
        return name.lower().endswith(self.suffix) and len(name) > len(self.suffix)

    def shares(self, since: int = -1, until: int | None = None) -> list[Share]:
        store = open_store(self.uri)
        top = store.entry(store.root)
        if top is None:
            raise FileNotFoundError(f"there is no {self.uri}")
        if not top.folder:
            return [Share(store.root, False, 0, 1, since, until)]
        skip = self.skipped(store)
        listed, waiting = [], deque([store.root])
        while waiting and len(listed) + len(waiting) < self.wanted:
            folder = waiting.popleft()
            listed.append(folder)
            waiting.extend(e.path for e in store.entries(folder) if e.folder and e.path != skip)
        folders = [(f, False) for f in listed] + [(f, True) for f in waiting]
        of = -(-self.wanted // len(folders))
        return [Share(f, below, k, of, since, until) for f, below in folders for k in range(of)]

    def files(self, store: Local | Remote, share: Share) -> Iterator[Entry]:
        top = store.entry(share.folder)
        if top is None:
            return
        if not top.folder:
            yield top
            return
        skip, waiting = self.skipped(store), [share.folder]
        while waiting:
            for entry in store.entries(waiting.pop()):
                if entry.folder:
                    if share.below and entry.path != skip:
                        waiting.append(entry.path)
                elif self.named(entry) and zlib.crc32(entry.path.encode("utf-8", "surrogateescape")) % share.of == share.number:
                    yield entry

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        store = open_store(self.uri)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)

        for entry in self.files(store, share):
            if entry.changed <= share.since or (share.until is not None and entry.changed > share.until):
                continue
            try:
                content = store.read(entry.path)
            except FileNotFoundError:
                continue
            except PermissionError:
                content = None
            shown = store.shown(entry.path).encode("utf-8", "surrogateescape").decode("utf-8", "replace")
            rows.append((shown, entry.length if content is None else len(content), content))
            size += len(content or b"")
            if size >= BATCH_BYTES or len(rows) >= 5000:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class FolderReader(Folder, DataSourceReader):
    def partitions(self) -> list[Share]:
        return self.shares()


class FolderStream(Folder, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        #: Files younger than this wait for the next batch, as others of the same instant may yet appear.
        self.settle = int(options.get("settle_ms", 2000)) * 1_000_000

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - self.settle}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return self.shares(start["until"], end["until"])


class ModuleFolder(DataSource):
    """Options: path (folder or file), skip (a folder left out), partitions, suffix; as a stream also settle_ms."""

    @classmethod
    def name(cls) -> str:
        return "module_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, once, and the package to its workers."""
    ship_package(spark)
    if not getattr(spark, "_module_folder_known", False):
        spark.dataSource.register(ModuleFolder)
        spark._module_folder_known = True
