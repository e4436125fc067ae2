"""Bulk CSV files -> landed records and raw tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlake.functions import infer, lexicons as lx, parse, text
from laborlake.sources import bronze, files, tabular


def bulk_envelope(rows: DataFrame, dataset_key: str, slug: str, year: int | None) -> DataFrame:
    """Rows of a bulk file as landed records; rows without a title are dropped."""
    columns = tabular.bulk_columns(rows.columns)

    def get(field: str) -> Column:
        name = columns[field]
        return parse.strip(text.or_blank(F.col(f"`{name}`"))) if name else F.lit("")

    def amount(field: str) -> Column:
        return parse.money_k(get(field))

    def or_single(field: str) -> Column:
        return F.coalesce(F.when(amount(field) != 0, amount(field)), amount("sal_single"))

    job_type = get("job_type")
    if columns["remote"]:
        by_text = parse.boolean_bulk(get("remote"))
    else:
        by_text = infer.remote_by_job_type(job_type)
    remote = by_text
    if columns["remote_ratio"]:
        ratio = amount("remote_ratio")
        remote = F.when(ratio.isNotNull(), ratio >= 50).otherwise(by_text)
    if dataset_key in lx.DATASETS_WITHOUT_SKILLS:
        skills = F.array().cast("array<string>")
    else:
        skills = parse.bulk_skills(get("skills"))
    static_year = F.lit(year).cast("int")
    row_year = amount("work_year").try_cast("int")
    id_column = next((c for c in lx.BULK_ID_COLUMNS if c in rows.columns), None)
    missing = F.lit(None).cast("string")

    return rows.select(
        F.lit(lx.SOURCE_BULK).alias("source"),
        (text.or_blank(F.col(f"`{id_column}`")) if id_column else F.lit("")).alias("external_id"),
        get("title").alias("title"),
        F.lit("").alias("title_normalized_hint"),
        get("company").alias("company"),
        get("location").alias("location"),
        parse.null_if_empty(get("country")).alias("country"),
        get("description").alias("description"),
        or_single("sal_min").alias("salary_min"),
        or_single("sal_max").alias("salary_max"),
        remote.alias("remote"),
        skills.alias("skills_extracted"),
        get("posted_at").alias("posted_at"),
        F.lit(slug).alias("dataset_slug"),
        F.coalesce(F.when(row_year != 0, row_year), static_year).alias("dataset_year"),
        infer.work_type(remote).alias("work_type"),
        (get("experience_level") if columns["experience_level"] else missing).alias("experience_level"),
        (
            get("employment_type") if columns["employment_type"] else parse.null_if_empty(job_type)
        ).alias("employment_type"),
        (get("company_size") if columns["company_size"] else missing).alias("company_size"),
        F.lit(dataset_key).alias("dataset_key"),
    ).filter(F.col("title") != "")


def normalise_dataset(
    spark: SparkSession,
    folder: str,
    dataset_key: str,
    *,
    bronze_root: str,
    raw_root: str,
    ingest_date: str,
    run_id: str | None = None,
    slug: str | None = None,
    year: int | None = None,
    multi_line: bool = True,
) -> dict:
    """Load all CSV files of a dataset: job files to Bronze and raw, the others to raw only. A load repeated under its
    ``run_id`` replaces what it landed before."""
    known_slug, known_year = lx.DATASETS.get(dataset_key, (dataset_key, None))
    paths = files.matching(spark, f"{folder}/*.csv")
    if not paths:
        raise FileNotFoundError(f"no CSV files in {folder}")
    job_groups, raw_groups = tabular.route_by_header(spark, paths, multi_line=multi_line)
    for header, group in job_groups.items():
        rows = tabular.read_csv(spark, group, multi_line=multi_line)
        envelopes = bulk_envelope(rows, dataset_key, slug or known_slug, year or known_year)
        bronze.write_bronze(envelopes, bronze_root, ingest_date, load=files.load_name(run_id, header))
    for group in (*job_groups.values(), *raw_groups.values()):
        tabular.land_raw(spark, group, raw_root, dataset_key, run_id, multi_line=multi_line)
    return {
        "dataset_key": dataset_key,
        "job_files": sum(len(g) for g in job_groups.values()),
        "raw_only_files": sum(len(g) for g in raw_groups.values()),
    }


def load_datasets(spark: SparkSession, folders: dict[str, str], **options) -> dict[str, Sequence]:
    """Load several datasets; one that fails does not stop the others."""
    loaded, failed = [], []
    for key, folder in folders.items():
        try:
            loaded.append(normalise_dataset(spark, folder, key, **options))
        except Exception as error:  # each dataset stands alone
            failed.append((key, str(error)[:500]))
    return {"loaded": loaded, "failed": failed}
