"""Read queries over the aggregate tables. Dates are parameters; nothing reads the clock."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborlake.operators.percentiles import round_half_up


def date_range(preset: str, today: date) -> tuple[date, date]:
    """Inclusive range of '7d', '30d', '90d', 'ytd' or 'all'; anything else counts as '90d'."""
    if preset == "ytd":
        return today.replace(month=1, day=1), today
    if preset == "all":
        return date(2020, 1, 1), today
    days = {"7d": 7, "30d": 30}.get(preset, 90)
    return today - timedelta(days=days - 1), today


def ordered(start: date, end: date) -> tuple[date, date]:
    return (start, end) if start <= end else (end, start)


def _top(n: int, most: int) -> int:
    if not 1 <= n <= most:
        raise ValueError(f"top_n must be between 1 and {most}, got {n}")
    return n


def _within(start: date, end: date, column: str = "date") -> Column:
    return F.col(column).between(F.lit(start), F.lit(end))


def _named_like(column: str, text: str | None) -> list[Column]:
    return [F.col(column).ilike(f"%{text}%")] if text else []


def _where(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    return df.filter(reduce(and_, conditions)) if conditions else df


# Skills


def trending_skills(demand: DataFrame, start: date, end: date, top_n: int = 20) -> DataFrame:
    """Skills with the highest 7-day average reached in the window."""
    return (
        demand.filter(_within(start, end))
        .groupBy("skill")
        .agg(
            F.sum("job_count").alias("total_jobs"),
            F.max("moving_avg_7d").alias("peak_7d_avg"),
            F.max("moving_avg_30d").alias("peak_30d_avg"),
        )
        .orderBy(F.desc_nulls_last("peak_7d_avg"), "skill")
        .limit(_top(top_n, 100))
    )


def skill_timeseries(
    demand: DataFrame, start: date, end: date, skills: Sequence[str] = ("python", "sql", "spark")
) -> DataFrame:
    return (
        demand.filter(_within(start, end) & F.col("skill").isin(*skills))
        .select("date", "skill", "job_count", "moving_avg_7d")
        .orderBy("skill", "date")
    )


def top_pairs(cooccurrence: DataFrame, top_n: int = 50) -> DataFrame:
    return (
        cooccurrence.select("skill_a", "skill_b", "co_count")
        .orderBy(F.desc("co_count"), "skill_a", "skill_b")
        .limit(_top(top_n, 200))
    )


def _since(demand: DataFrame, first: date | None) -> DataFrame:
    return demand if first is None else demand.filter(F.col("date") >= F.lit(first))


def skill_ranking(demand: DataFrame, since: date | None = None) -> DataFrame:
    """All skills by total postings, from ``since`` on where it is given."""
    return (
        _since(demand, since)
        .groupBy("skill")
        .agg(F.sum("job_count").alias("total_jobs"))
        .orderBy(F.desc("total_jobs"), "skill")
    )


def skills_yearly(demand: DataFrame, compare: str = "top10", since: date | None = None) -> DataFrame:
    """Postings per year and skill, from ``since`` on where it is given: the ten strongest skills, or 'all'."""
    yearly = (
        _since(demand, since)
        .groupBy(F.year("date").alias("year"), "skill")
        .agg(F.sum("job_count").alias("total_jobs"))
    )
    if compare == "top10":
        # Ten rows by construction. Totals come from the yearly sums, not from a second scan.
        strongest = (
            yearly.groupBy("skill")
            .agg(F.sum("total_jobs").alias("_all"))
            .orderBy(F.desc("_all"), "skill")
            .limit(10)
            .select("skill")
        )
        yearly = yearly.join(F.broadcast(strongest), "skill", "left_semi")
    elif compare != "all":
        raise ValueError("compare must be 'top10' or 'all'")
    return yearly.select("year", "skill", "total_jobs").orderBy(
        "year", F.desc("total_jobs"), "skill"
    )


def yearly_chart(yearly: DataFrame, skills: Sequence[str]) -> DataFrame:
    """One row per year and one zero-filled column per skill, in the given order."""
    return (
        yearly.groupBy("year")
        .pivot("skill", list(skills))
        .agg(F.sum("total_jobs"))
        .na.fill(0)
        .select("year", *[F.col(f"`{s}`") for s in skills])
        .orderBy("year")
    )


def chart_ranking(yearly: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` strongest skills over all years: rank from 1, skill and total; ties in name order."""
    totals = yearly.groupBy("skill").agg(F.sum("total_jobs").alias("total_jobs")).orderBy(F.desc("total_jobs"), "skill").limit(k)
    best = Window.orderBy(F.desc("total_jobs"), "skill")  # over k rows
    return totals.select(F.row_number().over(best).alias("rank"), "skill", "total_jobs")


def ranked_chart(yearly: DataFrame, k: int = 10) -> DataFrame:
    """One row per year: its postings over all skills, and those of the ``k`` strongest skills as zero-filled columns
    ``rank_1`` to ``rank_k``. Which skill has a rank says ``chart_ranking``; no names are handed in or fetched."""
    ranked = yearly.join(F.broadcast(chart_ranking(yearly, k).select("skill", "rank")), "skill", "left")
    jobs = F.col("total_jobs")
    places = [F.coalesce(F.sum(F.when(F.col("rank") == n, jobs)), F.lit(0)).alias(f"rank_{n}") for n in range(1, k + 1)]
    return ranked.groupBy("year").agg(F.sum(jobs).alias("total_jobs"), *places).orderBy("year")


# Roles


def role_demand(demand: DataFrame, start: date, end: date, role: str | None = None) -> DataFrame:
    return (
        _where(demand, [_within(start, end), *_named_like("role", role)])
        .select("date", "role", "job_count", "moving_avg_7d", "moving_avg_30d")
        .orderBy("role", "date")
    )


def top_roles(demand: DataFrame, start: date, end: date, top_n: int = 10) -> DataFrame:
    return (
        demand.filter(_within(start, end))
        .groupBy("role")
        .agg(F.sum("job_count").alias("total_jobs"))
        .orderBy(F.desc("total_jobs"), "role")
        .limit(_top(top_n, 50))
    )


# Salaries


def salaries(summary: DataFrame, role: str | None = None, country: str | None = None) -> DataFrame:
    """Salary groups, largest sample first."""
    wanted = _named_like("role", role)
    if country:
        wanted.append(F.col("country") == country.upper())
    return _where(summary, wanted).orderBy(F.desc("sample_size"), "role", "country")


def top_salaries(summary: DataFrame, n: int = 8) -> DataFrame:
    return (
        summary.filter(F.col("salary_median").isNotNull())
        .orderBy(F.desc("salary_median"), "role", "country")
        .limit(n)
    )


def salary_explorer(summary: DataFrame, min_sample: int = 3) -> DataFrame:
    """Groups with enough samples by median; a missing median sorts as zero."""
    return summary.filter(F.col("sample_size") >= min_sample).orderBy(
        F.coalesce("salary_median", F.lit(0.0)).desc(), "role", "country"
    )


def salary_totals(summary: DataFrame, min_sample: int = 3) -> DataFrame:
    """Groups, best-paid group, total sample and number of countries, in one row."""
    best = F.struct(
        F.coalesce("salary_median", F.lit(0.0)).alias("median"), "role", "country"
    )
    return (
        summary.filter(F.col("sample_size") >= min_sample)
        .agg(
            F.count("*").alias("group_count"),
            F.max(best).alias("_best"),
            F.coalesce(F.sum("sample_size"), F.lit(0)).alias("total_sample"),
            F.countDistinct("country").alias("market_count"),
        )
        .select(
            "group_count",
            F.col("_best.role").alias("top_role"),
            F.col("_best.country").alias("top_country"),
            F.col("_best.median").alias("top_median"),
            "total_sample",
            "market_count",
        )
    )


# Remote


def remote_series(remote: DataFrame, start: date, end: date, role: str | None = None) -> DataFrame:
    return (
        _where(remote, [_within(start, end), *_named_like("role", role)])
        .select("date", "role", "remote_count", "onsite_count", "remote_ratio")
        .orderBy("role", "date")
    )


def remote_summary(remote: DataFrame) -> DataFrame:
    """Totals over all roles and days; the share is NULL when nothing is known."""
    return remote.agg(
        F.sum("remote_count").alias("total_remote"), F.sum("onsite_count").alias("total_onsite")
    ).withColumn("remote_pct", _percent(F.col("total_remote"), F.col("total_onsite")))


def _percent(part: Column, other: Column) -> Column:
    return round_half_up(part * 100.0 / F.nullif(part + other, F.lit(0)), 1)


# Alerts and overview


def alerts(market_alerts: DataFrame, alert_date: date, entity_type: str | None = None) -> DataFrame:
    """Alerts of a day, strongest first; only 'role' and 'skill' filter by type."""
    wanted = [F.col("alert_date") == F.lit(alert_date)]
    if entity_type in ("role", "skill"):
        wanted.append(F.col("entity_type") == entity_type)
    return (
        _where(market_alerts, wanted)
        .select("alert_date", "entity_type", "entity_name", "demand_7d_avg", "demand_30d_avg", "spike_ratio")
        .orderBy(F.desc_nulls_last("spike_ratio"), "entity_type", "entity_name")
    )


def alert_counts(market_alerts: DataFrame, end: date) -> DataFrame:
    """Alerts on the day and in the seven days up to it, and the last alert day."""
    day = F.col("alert_date")
    return market_alerts.agg(
        F.count_if(day == F.lit(end)).alias("alerts_today"),
        F.count_if(day.between(F.lit(end - timedelta(days=6)), F.lit(end))).alias("alerts_last_7d"),
        F.max(day).alias("last_alert_date"),
    )


def overview_metrics(
    jobs: DataFrame,
    role_demand: DataFrame,
    skill_demand: DataFrame,
    salary_summary: DataFrame,
    cooccurrence: DataFrame,
    market_alerts: DataFrame,
    remote: DataFrame,
    start: date,
    end: date,
) -> DataFrame:
    """The dashboard's one-row snapshot. Postings are counted in the window, the rest in full.

    Each table is reduced to one row on its own; the rows are stacked and folded
    into one, so nothing is joined.
    """
    start, end = ordered(start, end)
    posted = F.col("posted_at").cast("date")
    one_row = [
        jobs.agg(
            F.count_if(posted.between(F.lit(start), F.lit(end))).alias("jobs_in_window"),
            F.count("*").alias("jobs_total"),
        ),
        role_demand.agg(
            F.min("date").alias("demand_min"),
            F.max("date").alias("demand_max"),
            F.countDistinct("role").alias("distinct_roles"),
        ),
        skill_demand.agg(F.countDistinct("skill").alias("distinct_skills")),
        salary_summary.agg(
            F.count("*").alias("salary_summary_rows"),
            F.countDistinct("country").alias("distinct_countries_salary"),
        ),
        cooccurrence.agg(F.count("*").alias("cooccurrence_rows")),
        alert_counts(market_alerts, end),
        remote.agg(
            F.coalesce(F.sum("remote_count"), F.lit(0)).alias("total_remote"),
            F.coalesce(F.sum("onsite_count"), F.lit(0)).alias("total_onsite"),
        ),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns]).withColumn(
        "remote_pct", _percent(F.col("total_remote"), F.col("total_onsite"))
    )
