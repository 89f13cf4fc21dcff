"""Folders and files that tasks list, read and write themselves, on the stores pyarrow knows."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from typing import NamedTuple

#: Schemes that are other names for what pyarrow knows.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


class Entry(NamedTuple):
    path: str
    folder: bool
    length: int
    changed: int  # nanoseconds


class Local:
    """Files all nodes share under the same path. Links are not followed, so a folder is never entered twice."""

    def __init__(self, root: str):
        self.root = root

    def shown(self, path: str) -> str:
        return f"file:{path}"

    def entry(self, path: str) -> Entry | None:
        try:
            found = os.stat(path)
        except FileNotFoundError:
            return None
        return Entry(path, os.path.isdir(path), found.st_size, max(found.st_mtime_ns, found.st_ctime_ns))

    def entries(self, folder: str) -> Iterator[Entry]:
        try:
            with os.scandir(folder) as listing:
                for e in listing:
                    try:
                        if e.is_dir(follow_symlinks=False):
                            yield Entry(e.path, True, 0, 0)
                        elif e.is_file(follow_symlinks=False):
                            found = e.stat(follow_symlinks=False)
                            # A file that was moved here has an old time of its content, but a new one of its entry.
                            yield Entry(e.path, False, found.st_size, max(found.st_mtime_ns, found.st_ctime_ns))
                    except FileNotFoundError:
                        pass
        except (FileNotFoundError, PermissionError):
            pass  # a folder that went meanwhile, or may not be entered, has no files

    def read(self, path: str) -> bytes:
        with open(path, "rb") as f:
            return f.read()

    def write(self, path: str, content: bytes) -> None:
        """The file is there whole or not at all; an attempt that is lost leaves one with another ending."""
        os.makedirs(os.path.dirname(path), exist_ok=True)
        staged = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(staged, "wb") as f:
            f.write(content)
        os.replace(staged, path)

    def remove(self, folder: str) -> None:
        shutil.rmtree(folder)


class Remote:
    """A store of pyarrow's. A write there shows the file only when it is closed."""

    def __init__(self, uri: str):
        from pyarrow import fs

        scheme, rest = uri.split("://", 1)
        self.prefix = f"{scheme}://"
        self.store, self.root = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
        if scheme in ("hdfs", "viewfs"):
            self.prefix += rest.split("/", 1)[0]

    def shown(self, path: str) -> str:
        return self.prefix + path

    def entry(self, path: str) -> Entry | None:
        from pyarrow import fs

        found = self.store.get_file_info(path)
        return None if found.type == fs.FileType.NotFound else Entry(found.path, found.type == fs.FileType.Directory, found.size or 0, found.mtime_ns or 0)

    def entries(self, folder: str) -> Iterator[Entry]:
        from pyarrow import fs

        for found in self.store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            yield Entry(found.path, found.type == fs.FileType.Directory, found.size or 0, found.mtime_ns or 0)

    def read(self, path: str) -> bytes:
        with self.store.open_input_stream(path) as f:
            return f.read()

    def write(self, path: str, content: bytes) -> None:
        self.store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.store.open_output_stream(path) as f:
            f.write(content)

    def remove(self, folder: str) -> None:
        self.store.delete_dir(folder)


def open_store(uri: str) -> Local | Remote:
    """The store of a folder; its `root` is the folder's path there."""
    local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", uri)
    if local or "://" not in uri:
        return Local(os.path.abspath(local[1] if local else uri).rstrip("/") or "/")
    return Remote(uri.rstrip("/"))


def known(uri: str) -> bool:
    """Whether tasks can open the store; others only Spark's own readers reach."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://", uri)
    return scheme is None or SCHEMES.get(scheme[1], scheme[1]) in ("file", "hdfs", "s3", "gs", "gcs", "abfs")
