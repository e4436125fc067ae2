"""Data-quality suites. Each returns one row per check: layer, position, name, status, detail."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laborlake.functions.text import has_text
from laborlake.sources import bronze

STATUSES = ("passed", "warned", "failed")  # in order of severity


def check(name: str | Column, passed: Column, detail: Column, *, warn_only: bool = False) -> Column:
    bad = "warned" if warn_only else "failed"
    return F.struct(
        (F.lit(name) if isinstance(name, str) else name).alias("name"),
        F.when(passed, F.lit("passed")).otherwise(F.lit(bad)).alias("status"),
        detail.alias("detail"),
    )


def _rows(layer: str, measured: DataFrame, checks: Column, first: int = 1) -> DataFrame:
    return measured.select(F.posexplode(checks).alias("_i", "_c")).select(
        F.lit(layer).alias("layer"),
        (F.col("_i") + first).alias("position"),
        F.col("_c.name").alias("name"),
        F.col("_c.status").alias("status"),
        F.col("_c.detail").alias("detail"),
    )


def overall(checks: DataFrame) -> DataFrame:
    """Worst status of each layer."""
    severity = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    return checks.groupBy("layer").agg(
        F.max_by("status", severity).alias("overall"), F.count("*").alias("check_count")
    )


def bronze_checks(spark: SparkSession, root: str, run_date: str) -> DataFrame:
    """Are there sources, did each land files on the day, does every file parse, is there data?"""
    sources = sorted(
        {p.rsplit("/source=", 1)[1].split("/", 1)[0] for p in bronze.day_folders(spark, root)}
    )
    text = bronze.read_whole_files(spark, root, None, run_date)
    if text is None:
        text = spark.createDataFrame([], "value string, _path string, _name string, _source string")
    parsed = F.from_json("value", T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    files = text.select("_source", F.size(parsed).alias("_n")).select(
        "_source",
        F.coalesce(F.greatest("_n", F.lit(0)), F.lit(0)).alias("records"),
        (F.coalesce("_n", F.lit(-1)) < 0).alias("broken"),
    )
    measured = files.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.count_if("broken").alias("broken"),
        *[F.count_if(F.col("_source") == s).alias(f"n_{i}") for i, s in enumerate(sources)],
    )
    found = f"Found sources: {', '.join(sources)}" if sources else "No bronze sources found"
    checks = [check("bronze_sources_exist", F.lit(bool(sources)), F.lit(found))]
    for i, s in enumerate(sources):
        checks.append(
            check(
                f"bronze_{s}_partition",
                F.col(f"n_{i}") > 0,
                F.format_string("%d JSON files", F.col(f"n_{i}")),
                warn_only=True,
            )
        )
    checks += [
        check(
            "bronze_json_valid",
            F.col("broken") == 0,
            F.format_string("%d records loaded, %d parse errors", "records", "broken"),
        ),
        check(
            "bronze_records_nonzero",
            F.col("records") > 0,
            F.format_string("Total raw records: %d", "records"),
            warn_only=True,
        ),
    ]
    return _rows("bronze", measured, F.array(*checks))


FILL_RATES = (("title", 0.99), ("source", 1.0), ("raw_hash", 1.0), ("posted_at", 0.7))


def silver_measures(jobs: DataFrame) -> DataFrame:
    """Everything the Silver suite looks at, as one row.

    All counters are numbers, so the pass over the postings aggregates by hash.
    Sources are counted apart, from that column alone.
    """
    sources = jobs.groupBy("source").count().agg(F.count("*").alias("sources"))
    counters = jobs.agg(
        F.count("*").alias("total"),
        *[F.count_if(has_text(F.col(c))).alias(f"filled_{c}") for c, _ in FILL_RATES],
        F.countDistinct("raw_hash").alias("hashes"),
        F.count_if(F.col("salary_max") < F.col("salary_min")).alias("bad_salary"),
        F.count_if(~F.col("salary_missing")).alias("with_salary"),
        F.count_if(~F.col("skill_missing")).alias("with_skills"),
    )
    return _one_row([counters, sources])


def _one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """One-row tables side by side: stacked and folded, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def silver_checks(jobs: DataFrame) -> DataFrame:
    """Fill rates, unique hashes, salary logic and coverage, sources, skill coverage."""
    total = F.col("total")

    def share(c: str) -> Column:
        return F.col(c) / F.nullif(total, F.lit(0))

    def percent(c: str, text: str) -> Column:
        return F.format_string(text, share(c) * 100)

    later = [
        check(
            f"silver_{c}_fill_rate",
            share(f"filled_{c}") >= threshold,
            percent(f"filled_{c}", f"%.1f%% filled (threshold {threshold:.0%}%)"),
            warn_only=threshold < 1.0,
        )
        for c, threshold in FILL_RATES
    ]
    later += [
        check(
            "silver_raw_hash_unique",
            F.col("hashes") == total,
            F.format_string("%d duplicate hashes found", total - F.col("hashes")),
        ),
        check(
            "silver_salary_min_lte_max",
            F.col("bad_salary") == 0,
            F.format_string("%d rows where salary_max < salary_min", "bad_salary"),
        ),
        check(
            "silver_salary_coverage",
            share("with_salary") >= 0.20,
            percent("with_salary", "%.1f%% rows have salary data (threshold 20%%)"),
            warn_only=True,
        ),
        check(
            "silver_multiple_sources",
            F.col("sources") >= 2,
            F.format_string("%d sources", "sources"),
            warn_only=True,
        ),
        check(
            "silver_skill_coverage",
            share("with_skills") >= 0.30,
            percent("with_skills", "%.1f%% rows have skills extracted (threshold 30%%)"),
            warn_only=True,
        ),
    ]
    exists = check("silver_jobs_exist", total > 0, F.format_string("%d rows in jobs", total))
    empty = check("silver_jobs_exist", F.lit(False), F.lit("jobs table is empty"))
    return _rows(
        "silver",
        silver_measures(jobs),
        F.when(total > 0, F.array(exists, *later)).otherwise(F.array(empty)),
    )


def gold_measures(
    role_demand: DataFrame, skill_demand: DataFrame, salary_summary: DataFrame, market_alerts: DataFrame
) -> DataFrame:
    """Everything the Gold suite looks at: one aggregate per table, folded into one row."""
    week, month = F.col("moving_avg_7d"), F.col("moving_avg_30d")
    parts: Sequence[DataFrame] = (
        role_demand.agg(
            F.count("*").alias("role_rows"),
            F.count_if((week < 0) | (month < 0)).alias("bad_average"),
            F.count_if((F.col("job_count") > 5) & (week > F.col("job_count") * 20)).alias("bad_ratio"),
        ),
        skill_demand.agg(F.count("*").alias("skill_rows")),
        salary_summary.agg(
            F.count("*").alias("salary_rows"),
            F.count_if(F.col("salary_median") <= 0).alias("bad_median"),
        ),
        market_alerts.agg(
            F.count("*").alias("alert_rows"),
            F.count_if(F.col("spike_ratio") < 2.0).alias("weak_alerts"),
        ),
    )
    return _one_row(parts)


def gold_checks(
    role_demand: DataFrame, skill_demand: DataFrame, salary_summary: DataFrame, market_alerts: DataFrame
) -> DataFrame:
    """Tables populated, averages and medians plausible, alerts at least twofold."""

    def counted(c: str, text: str) -> Column:
        return F.format_string(f"%d {text}", c)

    def none(c: str) -> Column:
        return F.col(c) == 0

    def some(c: str) -> Column:
        return F.col(c) > 0

    always = F.lit(True)
    suite = (
        (always, check("gold_role_demand_populated", some("role_rows"),
                       counted("role_rows", "rows in daily_role_demand"))),
        (some("role_rows"), check("gold_moving_avgs_nonneg", none("bad_average"),
                                  counted("bad_average", "rows with negative averages"))),
        (some("role_rows"), check("gold_moving_avg_plausible", none("bad_ratio"),
                                  counted("bad_ratio", "rows with implausible 7d avg"), warn_only=True)),
        (always, check("gold_skill_demand_populated", some("skill_rows"),
                       counted("skill_rows", "rows in daily_skill_demand"))),
        (always, check("gold_salary_summary_populated", some("salary_rows"),
                       counted("salary_rows", "rows in salary_summary"), warn_only=True)),
        (some("salary_rows"), check("gold_salary_median_positive", none("bad_median"),
                                    counted("bad_median", "rows with non-positive median salary"))),
        (always, check("gold_market_alerts_plausible", none("weak_alerts"),
                       counted("alert_rows", "alerts, all spike_ratio >= 2.0"), warn_only=True)),
    )
    measured = gold_measures(role_demand, skill_demand, salary_summary, market_alerts)
    return _rows("gold", measured, F.array_compact(F.array(*[F.when(run, c) for run, c in suite])))
