"""Files that tasks write and read themselves, on whatever store Spark's shared folder is."""

from __future__ import annotations

import re

from pyarrow import fs

from modlens.sources.stores import SCHEMES


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it. Spark's names of schemes (s3a, say) are understood."""
    if "://" in uri or uri.startswith("file:"):
        uri = re.sub(r"\A([a-z0-9]+)(?=://)", lambda m: SCHEMES.get(m[1], m[1]), uri)
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri
