"""Getting the package to the executors' Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    top = Path(__file__).resolve().parent
    if top.suffix == ".zip" or ".zip" in str(top):
        return
    handle, path = tempfile.mkstemp(prefix="cuewright-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(path)
    atexit.register(os.unlink, path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share.

    Where it is unset, a local master gets a temporary folder; on a cluster that is an error, since
    executors could not read each other's files there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="cuewright-shared-")
        atexit.register(shutil.rmtree, _LOCAL[context.applicationId], ignore_errors=True)
    return "file://" + _LOCAL[context.applicationId]


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; see ``remove_at_exit``."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a path, which must exist by now, when the driver's JVM ends."""
    files, at = hadoop_path(spark, path)
    files.deleteOnExit(at)
