"""Small file-system helpers on the cluster's own file system."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Last folder level of landed rows: the load that they came with.
LOAD = "landed_by"
#: Digits of the hash of a header at the end of a load's name.
HEADER_DIGITS = 16


def load_name(run_id: str | None, columns: Sequence[str] = ()) -> str:
    """Name of a load: the run and a hash of its files' header, so that a run may land files of several headers. Without a
    run every load has a name of its own."""
    header = hashlib.sha256("\x1f".join(columns).encode()).hexdigest()[:HEADER_DIGITS]
    return f"{run_id or f'load-{uuid.uuid4().hex}'}-{header}"


def header_of(load: str) -> str | None:
    """The hash of the header in a load's name."""
    found = re.search(f"-([0-9a-f]{{{HEADER_DIGITS}}})$", load)
    return found and found[1]


def landing(rows: DataFrame, folders: Sequence[str], load: str):
    """Writer into ``folders`` and a folder of the load, which it replaces: a load repeated after a failure doubles nothing."""
    return (
        rows.withColumn(LOAD, F.lit(load))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folders, LOAD)
    )


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths that match a glob pattern; empty when there are none."""
    fs, p = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(p) or []))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as a scan names it."""
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toString()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Put a finished folder in the place of another."""
    fs, p = _fs(spark, source)
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs.delete(to, True)
    if not fs.rename(p, to):
        raise OSError(f"cannot move {source} to {target}")
