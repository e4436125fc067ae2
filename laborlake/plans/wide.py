"""Raw tables and landed records -> one wide staging table with quality and duplicate flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlake.functions import infer, lexicons as lx, parse, text
from laborlake.operators.dedup import flag_all_but_best
from laborlake.sources import bronze, schemas, tables, tabular
from laborlake.sources.staging import staged


def from_raw_tables(rows: DataFrame) -> DataFrame:
    """Rows of raw tables with the same columns, under canonical names.

    The first alias present wins, even where its value is NULL.
    """
    a = lx.RAW_ALIASES

    def pick(field: str) -> Column:
        return tabular.first_present(rows, a[field])

    def words(field: str) -> Column:
        return text.clean(pick(field))

    low = F.coalesce(parse.money(pick("salary_min")), parse.money(pick("salary_single")))
    posted = words("posted_at")
    return rows.select(
        F.lit(lx.SOURCE_BULK).alias("source"),
        text.clean(F.col("dataset_key")).alias("dataset_key"),
        text.clean(F.col("source_file")).alias("source_file"),
        words("source_record_id").alias("source_record_id"),
        F.col("raw_table"),
        F.col("row_number").alias("raw_row_number"),
        text.clean(F.col("run_id")).alias("run_id"),
        words("title").alias("title"),
        words("company").alias("company_name"),
        words("location").alias("location_raw"),
        words("country").alias("country"),
        parse.boolean_wide(pick("remote")).alias("remote_flag"),
        posted.alias("posted_at_raw"),
        low.alias("salary_min"),
        F.coalesce(parse.money(pick("salary_max")), low).alias("salary_max"),
        F.coalesce(words("currency"), F.lit("USD")).alias("salary_currency"),
        words("employment_type").alias("employment_type"),
        words("description").alias("description"),
        words("skills").alias("skills_text"),
        F.concat_ws("/", F.lit("1"), "raw_table", F.coalesce("run_id", F.lit("")),
                    F.coalesce(F.col("ingested_at").cast("string"), F.lit(""))).alias("_place"),
    )


def from_bronze(source: str, records: DataFrame, rank: int) -> DataFrame:
    """Landed records (with file name, path and row) under canonical names."""

    def filled(name: str) -> Column:
        return parse.null_if_empty(F.col(name))

    listed = F.from_json("skills_extracted", "array<string>")
    posted = text.clean(F.col("posted_at"))
    return records.select(
        F.lit(source).alias("source"),
        F.lit(None).cast("string").alias("dataset_key"),
        text.clean(F.col("_name")).alias("source_file"),
        text.clean(F.coalesce(filled("external_id"), filled("id"), filled("url"))).alias("source_record_id"),
        F.lit(f"bronze_{source}").alias("raw_table"),
        F.col("_row").alias("raw_row_number"),
        F.lit(None).cast("string").alias("run_id"),
        text.clean(F.col("title")).alias("title"),
        text.clean(F.col("company")).alias("company_name"),
        text.clean(F.col("location")).alias("location_raw"),
        text.clean(F.col("country")).alias("country"),
        parse.boolean_wide(F.col("remote")).alias("remote_flag"),
        posted.alias("posted_at_raw"),
        parse.money(F.col("salary_min")).alias("salary_min"),
        parse.money(F.col("salary_max")).alias("salary_max"),
        F.lit("USD").alias("salary_currency"),
        text.clean(F.coalesce(filled("job_type"), filled("contract_type"))).alias("employment_type"),
        text.clean(F.col("description")).alias("description"),
        F.array_join(listed, ", ").alias("skills_text"),
        F.concat_ws("/", F.lit(str(rank)), "_path").alias("_place"),
    )


def quality_score(title: Column, company: Column, location: Column, posted: Column,
                  description: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Points (0-100) for what a posting states, and a comma list of what it lacks."""
    parts = (
        (title.isNotNull(), 35, "missing_title"),
        (company.isNotNull(), 15, "missing_company"),
        (location.isNotNull(), 15, "missing_location"),
        (posted.isNotNull(), 10, "missing_posted_at"),
        (F.coalesce(F.length(description) >= 80, F.lit(False)), 15, "short_description"),
        (low.isNotNull() | high.isNotNull(), 10, "missing_salary"),
    )
    score = reduce(lambda a, b: a + b, (F.when(ok, points).otherwise(0) for ok, points, _ in parts))
    lacks = F.concat_ws(",", *[F.when(~ok, F.lit(name)) for ok, _, name in parts])
    return score, parse.null_if_empty(lacks)


def wide_rows(canonical: DataFrame, normalization_run_id: str) -> DataFrame:
    """Derived columns of the wide table: city, country, role family, quality, dedup key."""
    posted = parse.timestamp(F.col("posted_at_raw"), strip_first=True)
    located = canonical.withColumn("posted_at", posted)
    title, company, location = (F.col(c) for c in ("title", "company_name", "location_raw"))
    score, lacks = quality_score(
        title, company, location, F.col("posted_at"),
        F.col("description"), F.col("salary_min"), F.col("salary_max"),
    )
    return located.withColumns(
        {
            "normalization_run_id": F.lit(normalization_run_id),
            "title_norm": title,
            "country": F.coalesce("country", infer.country_wide(location)),
            "city": infer.city(location),
            "role_family": infer.role_family(title),
            "quality_score": score,
            "quality_flags": lacks,
            "dedup_key": text.dedup_key(title, company, location, F.col("posted_at")),
        }
    )


def flag_duplicates(rows: DataFrame) -> DataFrame:
    """Mark all but the best-scored row of each dedup key; ties go to the earlier row."""
    best_first = [-F.col("quality_score"), F.col("_place"), F.col("raw_row_number")]
    return flag_all_but_best(
        rows, "dedup_key", best_first, ["_place", "raw_row_number"], "is_exact_duplicate"
    )


def union_sources(raw: Sequence[DataFrame], landed: Mapping[str, DataFrame]) -> DataFrame:
    """All raw tables and landed sources under canonical names."""
    parts = [from_raw_tables(rows) for rows in raw]
    parts += [from_bronze(s, df, rank) for rank, (s, df) in enumerate(landed.items(), start=2)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def build(
    raw: Sequence[DataFrame], landed: Mapping[str, DataFrame], normalization_run_id: str
) -> DataFrame:
    """All sources in one wide table. The rows are written once before duplicates are flagged."""
    rows = staged(wide_rows(union_sources(raw, landed), normalization_run_id), "wide-rows")
    return flag_duplicates(rows).select(*schemas.WIDE.names)


def raw_to_wide(
    spark: SparkSession,
    raw_root: str,
    bronze_root: str,
    wide_root: str,
    normalization_run_id: str,
    *,
    run_date: str | None = None,
    truncate: bool = False,
) -> dict:
    """Build the wide table from storage and append it as one normalization run."""
    landed = {
        s: bronze.read_array_files(spark, bronze_root, s, run_date)
        for s in (lx.SOURCE_BOARD, lx.SOURCE_REMOTE)
    }
    wide = build(tabular.raw_tables(spark, raw_root), landed, normalization_run_id)
    if truncate:
        wide.drop("normalization_run_id").withColumn(
            "normalization_run_id", F.lit(normalization_run_id)
        ).write.mode("overwrite").partitionBy("normalization_run_id").parquet(wide_root)
    else:
        tables.write_run(wide, wide_root, "normalization_run_id", normalization_run_id)
    stored = spark.read.parquet(wide_root).filter(
        F.col("normalization_run_id") == normalization_run_id
    )
    counts = stored.agg(
        F.count("*").alias("rows"), duplicates_flagged().alias("flagged")
    ).head()
    return {
        "stage": "raw_to_wide",
        "normalization_run_id": normalization_run_id,
        "rows_inserted": counts.rows,
        "duplicates_flagged": counts.flagged,
        "run_date_scope": run_date or "all_dates",
    }


def duplicates_flagged() -> Column:
    return F.count_if(F.col("is_exact_duplicate"))
