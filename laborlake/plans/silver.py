"""Landed records -> canonical postings, their skills and source details."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from laborlake.functions import infer, lexicons as lx, parse, text
from laborlake.operators.dedup import first_per_key, not_yet_stored
from laborlake.sources import ledger, schemas, tables
from laborlake.sources.staging import freed, staged

#: Longer list entries are no skills; they are left out and the posting stays.
LONGEST_SKILL = 100
_DATES = ("posted_at", "date_posted", "job_posted_date", "date_time", "first_seen")


def clean(bronze: DataFrame) -> DataFrame:
    """Trimmed texts, one date column, usable salaries, three-valued remote; untitled rows dropped."""
    low, high = parse.money(F.col("salary_min")), parse.money(F.col("salary_max"))
    trimmed = {c: parse.strip(text.or_blank(F.col(c))) for c in ("title", "company", "location")}
    return (
        bronze.withColumns(
            {
                **trimmed,
                "description": parse.strip(text.or_blank(F.col("description"))),
                "posted_at": F.coalesce(*_DATES),
                "salary_min": low,
                "salary_max": repaired_max(low, high),
                "remote": parse.boolean_wide(F.col("remote")),
            }
        )
        .filter(F.length("title") > 0)
        .drop(*_DATES[1:])
    )


def repaired_max(low: Column, high: Column) -> Column:
    """An upper bound below the lower bound is raised to it; missing bounds stay missing."""
    return F.when(high < low, low).otherwise(high)


def with_hash(cleaned: DataFrame) -> DataFrame:
    return cleaned.withColumn(
        "raw_hash",
        text.posting_hash(F.col("title"), F.col("company"), F.col("posted_at"), F.col("source")),
    )


def dedup_batch(hashed: DataFrame) -> DataFrame:
    """The first record of each content hash, by file and place in the file."""
    return first_per_key(hashed, ["raw_hash"], [F.col("_file"), F.col("_seq")])


def canonical(hashed: DataFrame, *, country_names: bool = False) -> DataFrame:
    """All columns of the posting and its detail rows, plus ``skills`` and a reject reason. With ``country_names`` the
    names of known countries become their codes, and so decide the currency."""
    title = text.clean(F.col("title"))
    location, description = F.col("location"), F.col("description")
    country = infer.country_choice(F.col("country"), location, names=country_names)
    given = parse.skill_list(F.col("skills_extracted"))
    skills = F.filter(infer.skill_choice(given, description), lambda s: F.length(s) <= LONGEST_SKILL)
    everything = F.concat_ws(" ", title, location, description)
    out = hashed.withColumns({"_skills": skills, "_country": country})
    skills, country = F.col("_skills"), F.col("_country")
    return out.select(
        "raw_hash",
        "source",
        F.coalesce(
            text.clean(F.col("external_id")), F.substring("raw_hash", 1, 32)
        ).alias("external_id"),
        title.alias("title"),
        F.coalesce(
            parse.null_if_empty(F.col("title_normalized_hint")),
            infer.canonical_title(title, F.col("category")),
        ).alias("title_normalized"),
        text.or_blank(text.clean(F.col("company"))).alias("company_name"),
        location.alias("location"),
        country.alias("country"),
        infer.city(location).alias("city"),
        F.coalesce("remote", infer.remote_by_words(everything)).alias("remote"),
        "salary_min",
        "salary_max",
        infer.currency_of(country).alias("salary_currency"),
        (F.col("salary_min").isNull() & F.col("salary_max").isNull()).alias("salary_missing"),
        (F.size(skills) == 0).alias("skill_missing"),
        description.alias("description"),
        parse.timestamp(F.col("posted_at")).alias("posted_at"),
        skills.alias("skills"),
        F.col("external_id").alias("_record_id"),
        _reject_reason().alias("_reject"),
        *_detail_columns(),
    )


def _reject_reason() -> Column:
    """Why a record cannot be stored, NULL when it can."""
    return F.when(F.col("source").isNull(), F.lit("missing_source"))


def _detail_columns() -> list[Column]:
    def filled(name: str) -> Column:
        return text.clean(F.col(name)).alias(f"d_{name}")

    area = F.array_join(F.from_json("location_area", "array<string>"), ", ")
    return [
        *[filled(c) for c in ("contract_type", "contract_time", "category", "category_tag", "job_type", "salary_raw", "dataset_slug")],
        *[filled(c) for c in ("work_type", "experience_level", "employment_type", "company_size")],
        parse.boolean_wide(F.col("salary_is_predicted")).alias("d_salary_is_predicted"),
        text.clean(F.lower(text.or_blank(F.col("country")))).alias("d_country_code"),
        text.clean(F.coalesce(area, F.col("location_area"))).alias("d_location_area"),
        parse.null_if_empty(F.col("url")).alias("d_source_url"),
        parse.integer(F.col("dataset_year")).alias("d_dataset_year"),
    ]


@dataclass(frozen=True)
class SilverBatch:
    """The tables one batch adds, and its counters."""

    jobs: DataFrame
    job_skills: DataFrame
    board_details: DataFrame
    remote_details: DataFrame
    bulk_details: DataFrame
    rejects: DataFrame
    summary: dict


def build(
    bronze: DataFrame, stored_jobs: DataFrame | None, run_id: str, *, country_names: bool = False
) -> SilverBatch:
    """One batch of landed records as Silver rows not stored before.

    The records are parsed once: deduplicated canonical rows are written to the
    shared folder, reduced by what is already stored, and every output is a
    projection of that written table.
    """
    seen = Observation()
    counted = bronze.observe(
        seen,
        F.count("*").alias("total"),
        *[F.count_if(F.col("source") == s).alias(s) for s in _SOURCES],
    )
    titled = Observation()
    hashed = with_hash(clean(counted)).observe(titled, F.count("*").alias("rows"))
    batch = staged(canonical(dedup_batch(hashed), country_names=country_names), "silver-batch")
    in_batch = batch.count()
    fresh = batch if stored_jobs is None else staged(
        not_yet_stored(batch, stored_jobs, "raw_hash"), "silver-fresh"
    )
    counts = fresh.agg(
        F.count_if(F.col("_reject").isNull()).alias("good"), F.count("_reject").alias("bad")
    ).head()
    rows = titled.get["rows"]
    by_source = {s: seen.get[s] for s in _SOURCES if seen.get[s]}
    others = seen.get["total"] - sum(by_source.values())
    summary = {
        "stage": "bronze_to_silver",
        "total_raw": seen.get["total"],
        "duplicates_removed": rows - in_batch,
        "already_in_db": in_batch - counts.good - counts.bad,
        "total_inserted": counts.good,
        "total_skipped": 0,
        "total_errors": counts.bad,
        "by_source": by_source | ({"other": others} if others else {}),
    }
    return split(fresh, run_id, summary)


_SOURCES = (lx.SOURCE_BOARD, lx.SOURCE_REMOTE, lx.SOURCE_BULK)


def split(fresh: DataFrame, run_id: str, summary: dict | None = None) -> SilverBatch:
    """Route canonical rows to jobs, skills, the source's detail table, or rejects."""
    good = fresh.filter(F.col("_reject").isNull()).withColumn("run_id", F.lit(run_id))

    def details(keep: Column, schema) -> DataFrame:
        columns = [F.col(f"d_{f.name}").alias(f.name) for f in schema if f.name != "job_id"]
        return good.filter(keep).select(F.col("raw_hash").alias("job_id"), *columns)

    source = F.col("source")
    return SilverBatch(
        jobs=good.select(*schemas.JOBS.names),
        job_skills=job_skills(good),
        board_details=details(source == lx.SOURCE_BOARD, schemas.BOARD_DETAILS),
        remote_details=details(source == lx.SOURCE_REMOTE, schemas.REMOTE_DETAILS),
        bulk_details=details(source.startswith(lx.SOURCE_BULK), schemas.BULK_DETAILS),
        rejects=ledger.error_rows(
            fresh.filter(F.col("_reject").isNotNull()).select(
                F.col("_reject").alias("error_type"),
                F.concat_ws(": ", F.col("_reject"), text.or_blank(source)).alias("error_message"),
                F.col("_record_id").alias("record_id"),
            ),
            run_id,
            "bronze_to_silver",
        ),
        summary=summary or {},
    )


def job_skills(jobs: DataFrame, key: str = "raw_hash") -> DataFrame:
    """One row per posting and distinct skill."""
    return jobs.select(
        F.col(key).alias("job_id"), F.explode(F.array_distinct("skills")).alias("skill_name")
    )


def write(batch: SilverBatch, root: str, run_id: str) -> None:
    """Store a batch. Its commit comes last: ``stored`` shows a run's postings, skills and details together or not at all.

    Jobs are sorted by date inside each file, so that date ranges skip row groups.
    """
    spark = batch.jobs.sparkSession
    tables.uncommit(spark, root, run_id)
    for name in ("job_skills", "board_details", "remote_details", "bulk_details", "rejects"):
        tables.write_run(getattr(batch, name), f"{root}/{name}", "run_id", run_id)
    jobs = batch.jobs.sortWithinPartitions("source", "posted_at")
    tables.write_run(jobs, f"{root}/jobs", "run_id", run_id, partition_by=["source"])
    tables.commit(spark, root, run_id)


#: Tables of a Silver folder.
SCHEMAS = {
    "jobs": schemas.JOBS,
    "job_skills": schemas.JOB_SKILLS,
    "board_details": schemas.BOARD_DETAILS,
    "remote_details": schemas.REMOTE_DETAILS,
    "bulk_details": schemas.BULK_DETAILS,
    "rejects": schemas.PIPELINE_ERRORS,
}


def stored(spark: SparkSession, root: str, table: str, *, except_run: str | None = None) -> DataFrame:
    """A table of a Silver folder, committed runs only, with their ``run_id``."""
    return tables.read_committed(spark, root, table, SCHEMAS[table], except_run=except_run)


def ingest(
    spark: SparkSession, bronze: DataFrame, root: str, run_id: str, ledger_root: str | None = None, *, country_names: bool = False
) -> dict:
    """Landed records into Silver as one run: build against what is stored, write, commit, and keep the ledger.

    The run is 'running' in the ledger until it is committed, then 'completed' with its counts; one that raises is
    left as 'failed' and shows no rows. The same run id again replaces the run.
    """
    if ledger_root:
        ledger.start_run(spark, ledger_root, run_id)
    try:
        with freed(spark):
            batch = build(bronze, stored(spark, root, "jobs", except_run=run_id), run_id, country_names=country_names)
            write(batch, root, run_id)
    except Exception:
        if ledger_root:
            ledger.finish_run(spark, ledger_root, run_id, {}, 0, status="failed")
        raise
    if ledger_root:
        ledger.finish_run(spark, ledger_root, run_id, batch.summary, stored(spark, root, "jobs").count())
    return batch.summary


def relabel_currency(jobs: DataFrame, source: str = lx.SOURCE_BOARD) -> DataFrame:
    """Keep salaries as found in backup columns and set one source's currency by country."""
    mapped = infer.currency_of(F.col("country"))
    known = F.col("country").isin(*[c for c in lx.COUNTRY_CURRENCY if c != "US"])
    return jobs.withColumns(
        {
            "salary_min_original": F.col("salary_min"),
            "salary_max_original": F.when(F.col("salary_min").isNotNull(), F.col("salary_max")),
            "salary_currency": F.when(
                (F.col("source") == source) & known, mapped
            ).otherwise(F.col("salary_currency")),
        }
    )


def currency_report(jobs: DataFrame) -> DataFrame:
    """Postings by source, country and currency."""
    return (
        jobs.groupBy("source", "country", "salary_currency")
        .agg(F.count("*").alias("job_count"))
        .orderBy("source", "country", "salary_currency")
    )


def source_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source").agg(F.count("*").alias("record_count"))
