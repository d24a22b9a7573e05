"""Where staged tables and saved models go: the folder the cluster shares."""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one in the warehouse, which all
    executors share too."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    return folder.rstrip("/") if folder else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.tallybird"


def working_folder(spark: SparkSession, name: str) -> str:
    """A folder nobody has used, in the shared one."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/work/{name}-{uuid.uuid4().hex[:12]}"


def mounted_path(path: str) -> str:
    """The path as workers open it without Spark."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: workers open these files themselves, {CHECKPOINT_DIR} must name a mounted folder")
    return unquote(parts.path)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Let iterative jobs cut their lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _path(spark, path)
    return fs.exists(hadoop_path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True if a job wrote ``path`` to the end."""
    return path_exists(spark, f"{path}/_SUCCESS")


def move_into_place(spark: SparkSession, draft: str, path: str) -> None:
    """Make the complete folder ``draft`` the one at ``path``; an incomplete one there goes."""
    fs, target = _path(spark, path)
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(_path(spark, draft)[1], target):
        raise RuntimeError(f"{draft} could not be moved to {path}")


def fingerprint(spark: SparkSession, folder: str) -> str:
    """Changes when a file in ``folder``, at any depth, is added, removed or rewritten."""
    fs, hadoop_path = _path(spark, folder)
    listing, files = [], fs.listFiles(hadoop_path, True)
    while files.hasNext():
        s = files.next()
        listing.append(f"{s.getPath().toString()}:{s.getLen()}:{s.getModificationTime()}")
    listing.sort()
    return hashlib.sha1("\n".join([folder, *listing]).encode()).hexdigest()[:12]


def remove_staged(spark: SparkSession) -> None:
    """Delete what this application has staged; call it when no result is read any more."""
    fs, path = _path(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    fs.delete(path, True)


def staging_path(spark: SparkSession, source_folder: str) -> str:
    """Working folder of this application for one input folder in its present state."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{application}/{fingerprint(spark, source_folder)}"
