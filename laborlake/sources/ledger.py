"""Run ledger and error log."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlake.sources import schemas, tables


def start_run(spark: SparkSession, root: str, run_id: str, started_at: datetime | None = None) -> None:
    """Open a run as 'running'."""
    row = {
        "run_id": run_id,
        "started_at": started_at or datetime.now(timezone.utc),
        "status": "running",
    }
    _store(spark, root, row)


def finish_run(
    spark: SparkSession,
    root: str,
    run_id: str,
    summary: Mapping,
    jobs_total: int,
    status: str = "completed",
    completed_at: datetime | None = None,
) -> None:
    """Close a run with the counts of its summary. An unknown run is left alone."""
    known = runs(spark, root).filter(F.col("run_id") == run_id).head()
    if known is None:
        return
    _store(
        spark,
        root,
        {
            "run_id": run_id,
            "started_at": known.started_at,
            "completed_at": completed_at or datetime.now(timezone.utc),
            "status": status,
            "source_counts": dict(summary.get("by_source", {})),
            "jobs_inserted": summary.get("total_inserted", 0),
            "jobs_skipped": summary.get("total_skipped", 0),
            "duplicates_removed": summary.get("duplicates_removed", 0),
            "errors_count": summary.get("total_errors", 0),
            "jobs_total": jobs_total,
        },
    )


def runs(spark: SparkSession, root: str) -> DataFrame:
    return tables.current(spark, root, schemas.PIPELINE_RUNS)


def _store(spark: SparkSession, root: str, row: Mapping) -> None:
    full = tuple(row.get(f.name) for f in schemas.PIPELINE_RUNS)
    incoming = spark.createDataFrame([full], schemas.PIPELINE_RUNS)
    tables.upsert(spark, root, incoming, ["run_id"], schemas.PIPELINE_RUNS)
    tables.drop_old_versions(spark, root)


def error_rows(rejects: DataFrame, run_id: str, stage: str) -> DataFrame:
    """Rejected records as error-log rows (message cut to 500, record id to 250 characters)."""
    return rejects.select(
        F.lit(run_id).alias("run_id"),
        F.lit(stage).alias("stage"),
        F.col("error_type"),
        F.substring("error_message", 1, 500).alias("error_message"),
        F.substring("record_id", 1, 250).alias("record_id"),
    )
