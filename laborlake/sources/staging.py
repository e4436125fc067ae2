"""Cutting a plan at a written table in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from laborlake.sources import files

_scopes = threading.local()


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end, but for those to ``keep``: for steps that need them no longer then."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            files.remove(spark, path)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on local masters."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="laborlake-"))
    return context.getCheckpointDir()


def staged(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """Write ``df`` once and read it back. Inside ``freed`` the table goes at its end; with ``keep``, at that of the one around.

    Several outputs can then be derived without recomputing the input, columns
    are still pruned per output, and a lost executor costs no lineage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/laborlake/{name}-{uuid.uuid4().hex}"
    scopes = getattr(_scopes, "open", [])[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
