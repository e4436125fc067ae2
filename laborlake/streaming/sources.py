"""Streams of landed records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from laborlake.sources import bronze, schemas, tables


def bronze_stream(
    spark: SparkSession,
    root: str,
    *,
    array_files: bool = True,
    schema: T.StructType = schemas.BRONZE,
    max_files_per_trigger: int = 1000,
) -> DataFrame:
    """New Bronze files as they land, with ``_file`` and ``_seq`` as in the batch reader."""
    return (
        spark.readStream.schema(schema)
        .option("multiLine", array_files)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", bronze.ARRAY_FILES if array_files else bronze.LINE_FILES)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(root)
        .select("*", F.col("_metadata.file_path").alias("_file"))
    )


def first_seen(hashed: DataFrame, event_time: str, horizon: str | None, key: str = "raw_hash") -> DataFrame:
    """The first record of each key.

    With a horizon, repeats within it go and the state stays bounded; records
    dated before the watermark go too, seen or not. Postings often carry old
    dates: ``horizon=None`` keeps every key in the state and loses none. For a
    check against all of history use the Silver sink. ``start_first_seen``
    keeps all keys without keeping them in memory.
    """
    if horizon is None:
        return hashed.dropDuplicates([key])
    return hashed.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark([key])


_STATE = "spark.sql.streaming.stateStore"
#: State on the executors' disks behind a cache of one bounded size per executor; a micro-batch looks up its own keys and
#: stores what it changed.
DISK_STATE = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STATE}.rocksdb.trackTotalNumberOfRows": "false",
}

_PARTITIONS = "spark.sql.shuffle.partitions"
#: Parts of the state that are enough on any cluster of up to half as many cores.
FEW_PARTS = 32


def state_parts(spark: SparkSession) -> int:
    """Parts of a new state: two a core, not more than the session's shuffle partitions. Each micro-batch opens and commits
    every part and writes a file of each, however few rows it has, so its cost grows with them."""
    return min(int(spark.conf.get(_PARTITIONS)), max(FEW_PARTS, 2 * spark.sparkContext.defaultParallelism))


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state on disk, in ``state_parts`` parts if it is new (an old one keeps its own);
    the session's settings are as before at the end."""
    wanted = DISK_STATE | {_PARTITIONS: str(state_parts(spark))}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def start_first_seen(hashed: DataFrame, folder: str, checkpoint: str, key: str = "raw_hash") -> StreamingQuery:
    """Write the first record of each key to ``folder`` for everything that has landed so far, then stop.

    Exact over all starts with one checkpoint: no key is lost or repeated, however late it comes. Memory stays bounded,
    disk grows with the number of keys. A micro-batch that is repeated after a failure is written once.
    """
    with state_on_disk(hashed.sparkSession):
        return (
            first_seen(hashed, "", None, key)
            .writeStream.format("parquet")
            .option("path", folder)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def daily_count_writer(root: str, event_time: str, entity: str, prefix: str = "stream") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: the postings per day and entity of one micro-batch, stored as a run of their own.

    Readers add the runs up (``daily_counts``), so a record counts however late
    it comes, and no state is held. A repeated batch replaces its own run.
    Rows without a time are on no day and are left out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        days = batch.filter(F.col(event_time).isNotNull()).groupBy(F.to_date(event_time).alias("date"), F.col(entity))
        tables.write_run(days.agg(F.count("*").alias("job_count")), root, "run_id", f"{prefix}-{batch_id:012d}")

    return write


def daily_counts(spark: SparkSession, root: str, entity: str) -> DataFrame:
    """Postings per day and entity over all micro-batches stored under ``root``."""
    schema = T.StructType().add("date", "date").add(entity, "string").add("job_count", "long")
    return tables.read_runs(spark, root, schema).groupBy("date", entity).agg(F.sum("job_count").alias("job_count"))
