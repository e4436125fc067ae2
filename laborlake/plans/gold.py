"""Silver -> the six aggregate tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laborlake.functions.text import currency_code
from laborlake.operators.pairs import frequent_only, pair_counts
from laborlake.operators.percentiles import exact_percentiles, round_half_up
from laborlake.operators.trend import on_or_after, on_or_before, trailing_averages
from laborlake.sources import schemas, tables
from laborlake.sources.fx import fx_table
from laborlake.sources.staging import staged


def _iso(day: str) -> str:
    """The day, checked to be written as YYYY-MM-DD."""
    if len(day) != 10:
        raise ValueError(f"date must be YYYY-MM-DD, got {day!r}")
    return date.fromisoformat(day).isoformat()


def _dated(jobs: DataFrame, as_of: str | None, since: str | None = None) -> DataFrame:
    """Postings with a date up to ``as_of``; the bounds reach the scan as plain comparisons."""
    kind = jobs.schema["posted_at"].dataType
    out = jobs.filter(F.col("posted_at").isNotNull())
    if as_of is not None:
        out = out.filter(on_or_before(F.col("posted_at"), _iso(as_of), kind))
    if since is not None:
        out = out.filter(on_or_after(F.col("posted_at"), _iso(since), kind))
    return out


def _role() -> Column:
    return F.coalesce("title_normalized", F.lit("Other"))


def daily_role_demand(jobs: DataFrame, as_of: str | None = None, *, since: str | None = None) -> DataFrame:
    """Postings per day and role with 7- and 30-day averages over the days present."""
    daily = (
        _dated(jobs, as_of, since)
        .groupBy(F.to_date("posted_at").alias("date"), _role().alias("role"))
        .agg(F.count("*").alias("job_count"))
    )
    return trailing_averages(daily, "role")


def _once_per_job(rows: DataFrame, column: str) -> DataFrame:
    """Distinct (job_id, ``column``), seen in the order of a job's rows. Sorted rows take less memory than a table of all
    pairs, and a join on the job uses the same shuffle and order."""
    own = F.struct(column)
    before = F.lag(own).over(Window.partitionBy("job_id").orderBy(column))
    return rows.withColumn("_again", before.eqNullSafe(own)).where(~F.col("_again")).drop("_again")


def daily_skill_demand(
    jobs: DataFrame,
    job_skills: DataFrame,
    as_of: str | None = None,
    *,
    since: str | None = None,
    job_key: str = "job_id",
    unique_bridge: bool = False,
) -> DataFrame:
    """Distinct postings per day and skill with 7- and 30-day averages.

    Postings and skills meet on the job key, and the distinct count needs no
    further shuffle since each job's rows are already together: repeats go
    before the join, so that what remains is counted map-side. When every
    (job, skill) pair is known to be stored once (``unique_bridge``, true for
    this library's own tables), a plain count gives the same at once.
    """
    jobs = _dated(jobs, as_of, since).select(
        F.col(job_key).alias("job_id"), F.to_date("posted_at").alias("date")
    )
    skills = job_skills.select("job_id", F.col("skill_name").alias("skill"))
    if not unique_bridge:
        jobs, skills = _once_per_job(jobs, "date"), _once_per_job(skills, "skill")
    daily = jobs.join(skills, "job_id").groupBy("date", "skill").agg(F.count("*").alias("job_count"))
    return trailing_averages(daily, "skill")


def mid_salaries(jobs: DataFrame) -> DataFrame:
    """Role, country, currency code and mid salary of postings with both bounds usable."""
    usable = jobs.filter(
        F.col("salary_min").isNotNull()
        & F.col("salary_max").isNotNull()
        & (F.col("salary_min") > 0)
        & (F.col("salary_max") >= F.col("salary_min"))
    )
    return usable.withColumns(
        {
            "role": _role(),
            "country": F.coalesce("country", F.lit("UNKNOWN")),
            "currency": currency_code(F.col("salary_currency")),
            "mid": (F.col("salary_min") + F.col("salary_max")) / 2.0,
        }
    )


#: Join keys that one currency's rows are spread over where the rates are passed in. Each rate is repeated as often.
RATE_SALTS = 64


def in_usd(salaries: DataFrame, fx: DataFrame | None) -> DataFrame:
    """Rows of a known currency with their mid salary in US dollars, by the rates passed in or the built-in ones.

    Most postings share one currency. The built-in table, of ten rows, goes to every task. One that is passed in may be of
    any size: whether it is broadcast is left to Spark, and where it isn't, a currency's rows are spread by their own hash.
    """
    given = default_rates(salaries.sparkSession, fx)
    rates = given.filter(F.col("rate") > 0).select(F.col("currency").alias("_code"), F.col("rate").alias("_rate"))
    on = F.col("currency") == F.col("_code")
    if fx is not None:
        rates = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(RATE_SALTS - 1))))
        own = [c for c in ("raw_hash", "job_id", "role", "country", "mid") if c in salaries.columns]
        on &= F.pmod(F.xxhash64(*own), F.lit(RATE_SALTS)).cast("int") == F.col("_salt")
    return salaries.join(rates, on).withColumn("salary_usd", F.col("mid") / F.col("_rate")).drop("_salt")


def usd_salaries(jobs: DataFrame, fx: DataFrame | None) -> DataFrame:
    """Mid salary in US dollars of postings with both bounds usable and a known currency."""
    return in_usd(mid_salaries(jobs), fx).select("role", "country", "salary_usd")


#: Percentiles of the salary table.
SALARY_PERCENTILES = {"salary_median": 0.5, "salary_p25": 0.25, "salary_p75": 0.75, "salary_p90": 0.9}


def default_rates(spark: SparkSession, fx: DataFrame | None) -> DataFrame:
    """The built-in rate table, of ten rows, goes to every task; one that is passed in is left to Spark's own size check."""
    return F.broadcast(fx_table(spark)) if fx is None else fx


def salary_summary(
    jobs: DataFrame,
    fx: DataFrame | None = None,
    *,
    min_sample: int = 3,
    as_of: str | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Salary quartiles and 90th percentile in USD per role and country, groups of 3 or more.

    Exact by default; ``approximate`` uses mergeable sketches in one pass.
    """
    if as_of is not None:
        jobs = _dated(jobs, as_of)
    salaries = usd_salaries(jobs, fx)
    wanted = SALARY_PERCENTILES
    if not approximate:
        return exact_percentiles(
            salaries, ["role", "country"], "salary_usd", wanted, min_count=min_sample
        )
    sketch = F.approx_percentile("salary_usd", list(wanted.values()), 10_000)
    return (
        salaries.groupBy("role", "country")
        .agg(F.count("*").alias("sample_size"), sketch.alias("_p"))
        .filter(F.col("sample_size") >= min_sample)
        .select(
            "role",
            "country",
            "sample_size",
            *[round_half_up(F.col("_p")[i], 2).alias(n) for i, n in enumerate(wanted)],
        )
    )


def remote_vs_onsite(jobs: DataFrame, as_of: str | None = None) -> DataFrame:
    """Remote, on-site and unknown postings per day and role, and the remote share of the known."""
    counted = _dated(jobs, as_of).groupBy(F.to_date("posted_at").alias("date"), _role().alias("role"))
    return with_remote_ratio(counted.agg(*remote_counts()))


def remote_counts() -> list[Column]:
    return [
        F.count_if(F.col("remote")).alias("remote_count"),
        F.count_if(~F.col("remote")).alias("onsite_count"),
        F.count_if(F.col("remote").isNull()).alias("unknown_count"),
    ]


def with_remote_ratio(counted: DataFrame) -> DataFrame:
    """Add the remote share of the postings whose place is known."""
    remote, onsite = F.col("remote_count"), F.col("onsite_count")
    return counted.withColumn("remote_ratio", round_half_up(remote / F.nullif(remote + onsite, F.lit(0)), 4))


def skill_cooccurrence(
    job_skills: DataFrame, *, min_count: int = 5, top: int | None = None, drop_rare: bool = False
) -> DataFrame:
    """Skill pairs of one posting by frequency; ties in name order; only the first ``top`` if that is given.

    ``drop_rare`` first leaves out skills too rare for any pair that counts. The
    result is the same; it pays when skills are free text with a long tail, not
    for a short lexicon.
    """
    if drop_rare:
        job_skills = frequent_only(job_skills, "skill_name", min_count)
    pairs = (
        pair_counts(job_skills, "job_id", "skill_name", "skill_a", "skill_b", "co_count")
        .filter(F.col("co_count") >= min_count)
        .orderBy(F.desc("co_count"), "skill_a", "skill_b")
    )
    return pairs if top is None else pairs.limit(top)


def spikes(demand: DataFrame, entity: str, as_of: str | None = None, *, ratio: float = 2.0) -> DataFrame:
    """Entities whose 7-day average on the day is at least ``ratio`` times the 30-day one.

    Without ``as_of`` the alerts of every day: the averages only look back, so
    these are the rows a run on each of the days would have given.
    """
    week, month = F.col("moving_avg_7d"), F.col("moving_avg_30d")
    on_day = demand if as_of is None else demand.filter(F.col("date") == F.lit(_iso(as_of)).cast("date"))
    return on_day.filter((month > 0) & (week >= ratio * month)).select(
        F.col("date").alias("alert_date"),
        F.lit(entity).alias("entity_type"),
        F.col(entity).cast("string").alias("entity_name"),
        week.alias("demand_7d_avg"),
        month.alias("demand_30d_avg"),
        round_half_up(week / month, 2).alias("spike_ratio"),
    )


def market_alerts(
    role_demand: DataFrame, skill_demand: DataFrame, as_of: str | None = None, *, ratio: float = 2.0
) -> DataFrame:
    """Role and skill spikes of one day, or of all days."""
    return spikes(role_demand, "role", as_of, ratio=ratio).unionByName(
        spikes(skill_demand, "skill", as_of, ratio=ratio)
    )


def market_alerts_on(
    jobs: DataFrame, job_skills: DataFrame, as_of: str, *, ratio: float = 2.0, **skill_options
) -> DataFrame:
    """Alerts straight from Silver. Only the 30 days the averages look at are read."""
    since = (date.fromisoformat(_iso(as_of)) - timedelta(days=29)).isoformat()
    return market_alerts(
        daily_role_demand(jobs, as_of, since=since),
        daily_skill_demand(jobs, job_skills, as_of, since=since, **skill_options),
        as_of,
        ratio=ratio,
    )


def refresh(
    spark: SparkSession,
    jobs: DataFrame,
    job_skills: DataFrame,
    gold_root: str,
    run_date: str,
    *,
    fx: DataFrame | None = None,
    job_key: str = "raw_hash",
    replace: tuple[str, ...] = ("salary_summary", "skill_cooccurrence"),
) -> dict[str, str]:
    """Build all six tables for a day.

    Dated tables are merged by key. Tables without a date are replaced, so that
    groups which no longer qualify go away; pass ``replace=()`` to merge all.
    Demand is written once and alerts are read from what was written.
    """
    role = staged(daily_role_demand(jobs, run_date), "role-demand")
    skill = staged(
        daily_skill_demand(jobs, job_skills, run_date, job_key=job_key),
        "skill-demand",
    )
    built = {
        "daily_role_demand": (role, schemas.DAILY_ROLE_DEMAND),
        "daily_skill_demand": (skill, schemas.DAILY_SKILL_DEMAND),
        "salary_summary": (salary_summary(jobs, fx), schemas.SALARY_SUMMARY),
        "remote_vs_onsite": (remote_vs_onsite(jobs, run_date), schemas.REMOTE_VS_ONSITE),
        "skill_cooccurrence": (skill_cooccurrence(job_skills), schemas.SKILL_COOCCURRENCE),
        "market_alerts": (market_alerts(role, skill, run_date), schemas.MARKET_ALERTS),
    }
    written = {}
    for name, (df, schema) in built.items():
        df = df.select(*schema.names)
        if name in replace:
            written[name] = tables.publish(df, f"{gold_root}/{name}", folder=tables.folder_of(tables.GOLD_KEYS[name]))
        else:
            written[name] = tables.upsert_gold(spark, gold_root, name, df, schema)
    return written
