"""Schemas of landed records and of the tables built from them."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "counts": T.MapType(T.StringType(), T.LongType()),
}


def _schema(spec: str) -> T.StructType:
    """Schema from 'name type, name type'; works before any session exists."""
    fields = (f.split() for f in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


def _with(schema: T.StructType, **nested: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in nested.items()]])


# One landed record of any source. Fields whose JSON type differs between
# writers are read as text and parsed later.
BRONZE = _schema(
    "source string, external_id string, title string, title_normalized_hint string, "
    "company string, location string, country string, description string, "
    "salary_min string, salary_max string, remote string, skills_extracted string, "
    "posted_at string, date_posted string, job_posted_date string, date_time string, "
    "first_seen string, category string, source_url string, contract_type string, "
    "contract_time string, adref string, salary_is_predicted string, category_tag string, "
    "location_area string, source_attribution string, job_type string, salary_raw string, "
    "url string, id string, dataset_slug string, dataset_year string, work_type string, "
    "experience_level string, employment_type string, company_size string"
)

# Provider records before flattening.
BOARD_RECORD = _with(
    _schema(
        "id string, title string, description string, created string, redirect_url string, "
        "contract_type string, contract_time string, salary_min double, salary_max double, "
        "salary_is_predicted string"
    ),
    company=_schema("display_name string"),
    location=_with(_schema("display_name string"), area=T.ArrayType(T.StringType())),
    category=_schema("label string, tag string"),
)
REMOTE_RECORD = _schema(
    "id string, title string, company_name string, category string, job_type string, "
    "candidate_required_location string, salary string, description string, url string, "
    "publication_date string"
)

JOBS = _schema(
    "raw_hash string, source string, external_id string, run_id string, title string, "
    "title_normalized string, company_name string, location string, country string, "
    "city string, remote boolean, salary_min double, salary_max double, "
    "salary_currency string, salary_missing boolean, skill_missing boolean, "
    "description string, posted_at timestamp_ntz"
)
JOB_SKILLS = _schema("job_id string, skill_name string")
BOARD_DETAILS = _schema(
    "job_id string, contract_type string, contract_time string, salary_is_predicted boolean, "
    "category string, category_tag string, country_code string, location_area string"
)
REMOTE_DETAILS = _schema(
    "job_id string, job_type string, category string, salary_raw string, source_url string"
)
BULK_DETAILS = _schema(
    "job_id string, dataset_slug string, dataset_year int, work_type string, "
    "experience_level string, employment_type string, company_size string"
)
WIDE = _schema(
    "normalization_run_id string, source string, dataset_key string, source_file string, "
    "source_record_id string, raw_table string, raw_row_number bigint, run_id string, "
    "title string, title_norm string, company_name string, location_raw string, "
    "country string, city string, remote_flag boolean, posted_at_raw string, "
    "posted_at timestamp_ntz, salary_min double, salary_max double, salary_currency string, "
    "employment_type string, description string, skills_text string, role_family string, "
    "quality_score int, quality_flags string, dedup_key string, is_exact_duplicate boolean"
)

DAILY_ROLE_DEMAND = _schema(
    "date date, role string, job_count bigint, moving_avg_7d double, moving_avg_30d double"
)
DAILY_SKILL_DEMAND = _schema(
    "date date, skill string, job_count bigint, moving_avg_7d double, moving_avg_30d double"
)
SALARY_SUMMARY = _schema(
    "role string, country string, sample_size bigint, salary_median double, "
    "salary_p25 double, salary_p75 double, salary_p90 double"
)
REMOTE_VS_ONSITE = _schema(
    "date date, role string, remote_count bigint, onsite_count bigint, "
    "unknown_count bigint, remote_ratio double"
)
SKILL_COOCCURRENCE = _schema("skill_a string, skill_b string, co_count bigint")
MARKET_ALERTS = _schema(
    "alert_date date, entity_type string, entity_name string, demand_7d_avg double, "
    "demand_30d_avg double, spike_ratio double"
)

PIPELINE_RUNS = _schema(
    "run_id string, started_at timestamp, completed_at timestamp, status string, "
    "source_counts counts, jobs_inserted bigint, jobs_skipped bigint, "
    "duplicates_removed bigint, errors_count bigint, jobs_total bigint"
)
PIPELINE_ERRORS = _schema(
    "run_id string, stage string, error_type string, error_message string, record_id string"
)
