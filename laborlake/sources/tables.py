"""Stored tables: run-wise appends with commits, versions, keyed upserts of whole tables or of the folders they touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laborlake.operators.upsert import merge_upsert
from laborlake.sources import files
from laborlake.sources.staging import freed, staged

# Natural keys of the aggregate tables.
GOLD_KEYS = {
    "daily_role_demand": ("date", "role"),
    "daily_skill_demand": ("date", "skill"),
    "salary_summary": ("role", "country"),
    "remote_vs_onsite": ("date", "role"),
    "skill_cooccurrence": ("skill_a", "skill_b"),
    "market_alerts": ("alert_date", "entity_type", "entity_name"),
}

#: Tables without a date are cut into this many folders, by a hash of their key.
BUCKETS = 64
FOLDER = "folder"


def folder_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    """Folder of a row: its month if the first key column is a date, else a bucket of the key.

    The names start with a letter, so that they are read back as text.
    """
    if keys[0] in ("date", "alert_date"):
        return F.concat(F.lit("m"), F.date_format(keys[0], "yyyy-MM"))
    return F.concat(F.lit("b"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string"))


def write_run(
    df: DataFrame, root: str, run_column: str, run_id: str, *, partition_by: Sequence[str] = ()
) -> None:
    """Append one run. Repeating a run replaces its own folder and nothing else."""
    (
        df.drop(run_column)
        .write.mode("overwrite")
        .partitionBy(*partition_by)
        .parquet(f"{root}/{run_column}={run_id}")
    )


def read_runs(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    run_column: str | None = None,
    *,
    except_run: str | None = None,
) -> DataFrame:
    """All appended runs, optionally without one of them (its folder is not read)."""
    if run_column and run_column not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField(run_column, T.StringType())])
    if not files.matching(spark, f"{root}/*"):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(root)
    if except_run is not None:
        df = df.filter(F.col(run_column) != except_run)
    return df.select(*schema.names)


COMMITS = T.StructType([T.StructField("run_id", T.StringType())])


def commit(spark: SparkSession, root: str, run_id: str) -> None:
    """Say that all tables of a run are written. The last thing a run does."""
    spark.range(1).select(F.lit(run_id).alias("run_id")).coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/{run_id}")


def uncommit(spark: SparkSession, root: str, run_id: str) -> None:
    """Take a run out of sight before its tables are written, so that readers never see half of it."""
    files.remove(spark, f"{root}/commits/{run_id}")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """Ids of the runs whose tables are all written."""
    if not files.matching(spark, f"{root}/commits/*/part-*"):
        return spark.createDataFrame([], COMMITS)
    return spark.read.schema(COMMITS).parquet(f"{root}/commits/*")


def read_committed(spark: SparkSession, root: str, table: str, schema: T.StructType, *, except_run: str | None = None) -> DataFrame:
    """Rows of a table of ``root`` from committed runs, with their ``run_id``.

    The list of commits has one short row per run. Spark joins it by partition value, so that folders of other runs
    are not read.
    """
    rows = read_runs(spark, f"{root}/{table}", schema, "run_id", except_run=except_run)
    return rows.join(committed(spark, root).distinct(), "run_id", "left_semi").select(*rows.columns)


def _versions(spark: SparkSession, root: str) -> list[str]:
    """Finished versions, oldest first."""
    done = files.matching(spark, f"{root}/v=*/_SUCCESS")
    return sorted((p[: -len("/_SUCCESS")] for p in done), key=lambda p: int(p.rsplit("=", 1)[1]))


def current(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The newest finished version of a table, or no rows."""
    versions = _versions(spark, root)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(versions[-1]).select(*schema.names)


def publish(df: DataFrame, root: str, *, folder: Column | None = None) -> str:
    """Write the next version, cut into folders if one is given. Readers see it only when it is complete."""
    spark = df.sparkSession
    taken = [int(p.rsplit("=", 1)[1]) for p in files.matching(spark, f"{root}/v=*")]
    path = f"{root}/v={max(taken, default=0) + 1}"
    if folder is None:
        df.write.parquet(path)
    else:
        _in_folders(df.withColumn(FOLDER, folder)).parquet(path)
    return path


def _in_folders(df: DataFrame):
    """Writer of rows by folder; rebalancing keeps files large and splits a folder that is too large for one task."""
    return df.hint("rebalance", FOLDER).write.partitionBy(FOLDER)


def merge(
    spark: SparkSession,
    root: str,
    incoming: DataFrame,
    keys: Sequence[str],
    schema: T.StructType,
    *,
    folder: Column | None = None,
    scope: DataFrame | None = None,
) -> str:
    """Insert or replace by key, rewriting only the folders of the newest version that are touched.

    ``scope`` names the keys that the incoming rows speak for: those that do not come in go away. Without it these are
    the incoming keys alone. Folders are replaced one by one when all are written (Spark's dynamic partition overwrite);
    after a failure in between, the same merge again gives the whole result. The driver gets the names of the touched
    folders: months, or at most ``BUCKETS``.
    """
    cut = folder_of(keys) if folder is None else folder
    with freed(spark):
        rows = staged(incoming.select(*schema.names).withColumn(FOLDER, cut), "merge-incoming")
        said = rows.select(*keys, FOLDER)
        if scope is not None:
            said = staged(scope.select(*keys).withColumn(FOLDER, cut).unionByName(said), "merge-scope")
        versions = _versions(spark, root)
        if not versions or not files.matching(spark, f"{versions[-1]}/{FOLDER}=*"):  # nothing yet, or not cut into folders
            before = current(spark, root, schema)
            return publish(before.join(said, list(keys), "left_anti").unionByName(rows.drop(FOLDER)), root, folder=cut)
        path = versions[-1]
        touched = [r[0] for r in said.select(FOLDER).distinct().collect()]
        cut_schema = T.StructType([*schema.fields, T.StructField(FOLDER, T.StringType())])
        before = spark.read.schema(cut_schema).parquet(path).where(F.col(FOLDER).isin(touched))
        kept = before.join(said, [FOLDER, *keys], "left_anti").select(*cut_schema.names)
        after = staged(kept.unionByName(rows), "merge-after")
        left = {r[0] for r in after.select(FOLDER).distinct().collect()}
        if left:
            _in_folders(after).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        for name in set(touched) - left:
            files.remove(spark, f"{path}/{FOLDER}={name}")
        return path


def drop_old_versions(spark: SparkSession, root: str, keep: int = 2) -> None:
    for path in _versions(spark, root)[:-keep]:
        files.remove(spark, path)


def upsert(
    spark: SparkSession, root: str, incoming: DataFrame, keys: Sequence[str], schema: T.StructType
) -> str:
    """Insert or replace by key: rows not coming in stay as they are."""
    return publish(merge_upsert(current(spark, root, schema), incoming, keys), root)


def upsert_gold(
    spark: SparkSession,
    gold_root: str,
    table: str,
    incoming: DataFrame,
    schema: T.StructType,
    *,
    min_sample: int = 3,
    scope: DataFrame | None = None,
) -> str:
    """Upsert one aggregate table by its natural key; small salary samples never get in."""
    if table == "salary_summary":
        incoming = incoming.filter(F.col("sample_size") >= min_sample)
    return merge(spark, f"{gold_root}/{table}", incoming, GOLD_KEYS[table], schema, scope=scope)
