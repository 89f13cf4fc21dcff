"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings this package is tuned for.

    On a cluster leave ``master`` unset, so that spark-submit decides.
    """
    builder = SparkSession.builder.appName("modlens")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to the machine's temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="modlens-")
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session, once, as spark-submit's --py-files would."""
    context = spark.sparkContext
    if getattr(context, "_modlens_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="modlens-"), "modlens.zip")  # the driver serves it to the executors
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._modlens_shipped = True
