"""Provider records -> the common record every source is landed as."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlake.functions import infer, lexicons as lx, parse
from laborlake.functions.text import or_blank


def _truthy(c: Column) -> Column:
    """True for anything but a missing, zero or false value."""
    return ~F.coalesce(F.lower(c.cast("string")), F.lit("0")).isin("0", "false", "")


def board_envelope(records: DataFrame, country: Column) -> DataFrame:
    """Flatten job-board records; nested names become plain columns."""
    title, description = or_blank(F.col("title")), or_blank(F.col("description"))
    location = or_blank(F.col("location.display_name"))
    return records.select(
        F.lit(lx.SOURCE_BOARD).alias("source"),
        or_blank(F.col("id")).alias("external_id"),
        title.alias("title"),
        or_blank(F.col("company.display_name")).alias("company"),
        location.alias("location"),
        F.coalesce("location.area", F.array().cast("array<string>")).alias("location_area"),
        F.upper(country).alias("country"),
        description.alias("description"),
        F.col("salary_min"),
        F.col("salary_max"),
        _truthy(F.col("salary_is_predicted")).alias("salary_is_predicted"),
        or_blank(F.col("contract_type")).alias("contract_type"),
        or_blank(F.col("contract_time")).alias("contract_time"),
        or_blank(F.col("category.label")).alias("category"),
        or_blank(F.col("category.tag")).alias("category_tag"),
        infer.remote_by_patterns(title, description, location).alias("remote"),
        or_blank(F.col("redirect_url")).alias("url"),
        or_blank(F.col("created")).alias("posted_at"),
    )


def remote_envelope(records: DataFrame) -> DataFrame:
    """Rename remote-board fields, read the free-text salary; every record is remote."""
    pay = parse.salary_range(F.col("salary"))
    return records.select(
        F.lit(lx.SOURCE_REMOTE).alias("source"),
        F.lit(lx.REMOTE_ATTRIBUTION).alias("source_attribution"),
        or_blank(F.col("id")).alias("external_id"),
        or_blank(F.col("title")).alias("title"),
        or_blank(F.col("company_name")).alias("company"),
        or_blank(F.col("category")).alias("category"),
        or_blank(F.col("job_type")).alias("job_type"),
        F.coalesce("candidate_required_location", F.lit("Worldwide")).alias("location"),
        F.lit(None).cast("string").alias("country"),
        or_blank(F.col("description")).alias("description"),
        or_blank(F.col("salary")).alias("salary_raw"),
        pay["low"].alias("salary_min"),
        pay["high"].alias("salary_max"),
        F.lit(True).alias("remote"),
        or_blank(F.col("url")).alias("url"),
        or_blank(F.col("publication_date")).alias("posted_at"),
    )


def keep_tech(
    records: DataFrame,
    categories: Sequence[str] | None = None,
    words: Sequence[str] = lx.TECH_CATEGORY_WORDS,
    *,
    when_none_match: str = "keep",
) -> DataFrame:
    """Records of the wanted categories.

    With a list: exact (lower-case) match. Without: any category holding one of
    the words. If no record of the whole input does, every record is kept, as
    one fetch is filtered; ``when_none_match="drop"`` judges each record by
    itself, so the outcome doesn't depend on how records are batched.
    """
    if when_none_match not in ("keep", "drop"):
        raise ValueError(f"unknown choice {when_none_match!r}")
    category = or_blank(F.lower("category"))
    if categories:
        return records.filter(category.isin(*categories))
    match = infer.contains_any(category, words)
    if when_none_match == "drop":
        return records.filter(match)
    any_match = records.agg(F.coalesce(F.bool_or(match), F.lit(False)).alias("any_match"))
    return records.filter(match | ~any_match.scalar())
