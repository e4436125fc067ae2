"""Streaming writers: Silver appends and Gold refresh, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from laborlake.plans import deltas, gold, silver
from laborlake.sources import tables


def silver_writer(silver_root: str, prefix: str = "stream", ledger_root: str | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: the batch build against everything stored before.

    The run id comes from the batch id, a run's folder is replaced as a whole and committed last, so a batch repeated
    after a failure leaves no duplicates. With ``ledger_root`` each micro-batch is a run of the ledger, with its counts,
    or 'failed'.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("_seq", F.monotonically_increasing_id())
        silver.ingest(batch.sparkSession, numbered, silver_root, f"{prefix}-{batch_id:012d}", ledger_root)

    return write


def start_silver(stream: DataFrame, silver_root: str, checkpoint: str, ledger_root: str | None = None) -> StreamingQuery:
    """Take in everything that has landed so far, then stop."""
    return (
        stream.writeStream.foreachBatch(silver_writer(silver_root, ledger_root=ledger_root))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _touching(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of the touched entities."""
    return rows.join(touched, touched.columns, "left_semi")


def _role_rows(jobs: DataFrame, touched: DataFrame) -> DataFrame:
    """All postings of the touched roles (and countries), labelled as in the aggregate tables."""
    labels = {
        "role": F.coalesce("title_normalized", F.lit("Other")),
        "country": F.coalesce("country", F.lit("UNKNOWN")),
    }
    labelled = jobs.withColumns({f"_{c}": labels[c] for c in touched.columns})
    keys = touched.select(*[F.col(c).alias(f"_{c}") for c in touched.columns])
    return _touching(labelled, keys).select(*jobs.columns)


def rebuild(
    table: str, jobs: DataFrame, job_skills: DataFrame, touched: DataFrame, *, fx: DataFrame | None = None
) -> DataFrame:
    """All rows of an aggregate table for the touched entities, from the whole of Silver.

    The averages run over the days present of an entity, so one new day can
    change later days: entities are recomputed as a whole, others are left out.
    """
    if table == "daily_role_demand":
        return gold.daily_role_demand(_role_rows(jobs, touched))
    if table == "remote_vs_onsite":
        return gold.remote_vs_onsite(_role_rows(jobs, touched))
    if table == "salary_summary":
        return gold.salary_summary(_role_rows(jobs, touched), fx)
    if table == "daily_skill_demand":
        skills = touched.select(F.col("skill").alias("skill_name"))
        return gold.daily_skill_demand(
            jobs, _touching(job_skills, skills), job_key="raw_hash"
        )
    raise ValueError(f"{table} has no entities of its own; use gold.refresh")


# Aggregate tables that can be refreshed by entity, and the columns that name one.
ENTITIES = {
    "daily_role_demand": ("role",),
    "remote_vs_onsite": ("role",),
    "salary_summary": ("role", "country"),
    "daily_skill_demand": ("skill",),
}


def touched_entities(table: str, new_jobs: DataFrame, job_skills: DataFrame) -> DataFrame:
    """Distinct entities of newly stored postings."""
    if table == "daily_skill_demand":
        keys = new_jobs.select(F.col("raw_hash").alias("job_id"))
        return _touching(job_skills, keys).select(F.col("skill_name").alias("skill")).distinct()
    labels = {
        "role": F.coalesce("title_normalized", F.lit("Other")).alias("role"),
        "country": F.coalesce("country", F.lit("UNKNOWN")).alias("country"),
    }
    return new_jobs.select(*[labels[c] for c in ENTITIES[table]]).distinct()


def gold_writer(silver_root: str, gold_root: str, **options) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function over commits (or postings) of Silver runs: refresh all six tables by what the runs add.

    A run that comes again replaces what it added before, so repeating a batch changes nothing. The driver gets the ids
    of the micro-batch's runs. ``options`` are those of ``deltas.refresh``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        runs = sorted(r.run_id for r in batch.select("run_id").distinct().collect())
        if runs:
            deltas.refresh_from_silver(batch.sparkSession, silver_root, gold_root, runs, **options)

    return write


def start_gold(
    spark: SparkSession, silver_root: str, gold_root: str, checkpoint: str, *, max_runs: int = 100, **options
) -> StreamingQuery:
    """Refresh the aggregate tables for all Silver runs committed since the last time, then stop.

    The stream reads commits, not postings: a run counts when all its tables are written, and again when it is replaced.
    """
    commits = spark.readStream.schema(tables.COMMITS).option("maxFilesPerTrigger", max_runs).parquet(f"{silver_root}/commits/*")
    return (
        commits.writeStream.foreachBatch(gold_writer(silver_root, gold_root, **options))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
