"""Aggregate tables and the views over them."""

from __future__ import annotations

from datetime import date

from catalog import proxies as px
from laborlake.operators.upsert import merge_upsert
from laborlake.plans import gold, views

AS_OF = "2001-07-01"
START, END = date(1996, 1, 1), date(2001, 6, 30)
BRANDS = ("Brand#1", "Brand#12", "Brand#25")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", "Other")
_BETWEEN = f"between date '{START}' and date '{END}'"


def _roles(spark, d, as_of=None):
    return gold.daily_role_demand(px.postings(spark, d), as_of)


def _skills(spark, d, as_of=None):
    return gold.daily_skill_demand(
        px.postings(spark, d), px.job_skills(spark, d), as_of, unique_bridge=True
    )


def _alerts(spark, d):
    return gold.market_alerts(
        gold.daily_role_demand(px.supplier_postings(spark, d)), _skills(spark, d)
    )


def _salaries(spark, d):
    return gold.salary_summary(px.jobs(spark, d))


def _pairs(spark, d):
    return gold.skill_cooccurrence(px.job_skills(spark, d))


def _remote(spark, d):
    return gold.remote_vs_onsite(px.postings(spark, d), AS_OF)


def _overview(spark, d):
    return views.overview_metrics(
        px.postings(spark, d), _roles(spark, d), _skills(spark, d), _salaries(spark, d),
        _pairs(spark, d), _alerts(spark, d), _remote(spark, d), END, START,
    )


def _merged(spark, d):
    """What is stored from an earlier run, replaced by key where a later run has rows."""
    later = _roles(spark, d)
    earlier = _roles(spark, d, "1999-12-31").withColumn("job_count", px.F.lit(0).cast("bigint"))
    newer_part = later.filter(px.F.col("date") >= px.F.lit(date(1998, 1, 1)))
    return merge_upsert(earlier, newer_part, ["date", "role"])


def _role_years(spark, d):
    """Yearly chart over the five role names, which are known in advance."""
    demand = _roles(spark, d).withColumnRenamed("role", "skill")
    return views.yearly_chart(views.skills_yearly(demand, "all"), list(PRIORITIES))


_YEARLY = f"""select cast(year(date) as integer) as year, skill, sum(job_count) as total_jobs
from ({px.skill_demand_sql()}) group by 1, 2"""
_SUMS = ", ".join(
    f"""cast(coalesce(sum(job_count) filter (where role = '{p}'), 0) as bigint) as "{p}" """ for p in PRIORITIES
)

_RANKING = f"""select cast(row_number() over (order by sum(total_jobs) desc, skill) as integer) as rank, skill,
  cast(sum(total_jobs) as bigint) as total_jobs from ({_YEARLY}) group by skill order by 1 limit 12"""
_RANKS = ", ".join(f"cast(coalesce(sum(y.total_jobs) filter (where r.rank = {n}), 0) as bigint) as rank_{n}" for n in range(1, 13))

_OVERVIEW_SQL = f"""with rd as ({px.role_demand_sql()}), sd as ({px.skill_demand_sql()}),
ss as ({px.SALARY_SUMMARY}), co as ({px.COOCCURRENCE}), al as ({px.ALERTS}), rv as ({px.remote_sql(AS_OF)})
select (select count(*) from ({px.POSTINGS}) where cast(posted_at as date) {_BETWEEN}) as jobs_in_window,
  (select count(*) from ({px.POSTINGS})) as jobs_total,
  (select min(date) from rd) as demand_min, (select max(date) from rd) as demand_max,
  (select count(distinct role) from rd) as distinct_roles,
  (select count(distinct skill) from sd) as distinct_skills,
  (select count(*) from ss) as salary_summary_rows,
  (select count(distinct country) from ss) as distinct_countries_salary,
  (select count(*) from co) as cooccurrence_rows,
  (select count(*) from al where alert_date = date '{END}') as alerts_today,
  (select count(*) from al where alert_date between date '{END}' - interval 6 day and date '{END}')
    as alerts_last_7d,
  (select max(alert_date) from al) as last_alert_date,
  (select cast(sum(remote_count) as bigint) from rv) as total_remote,
  (select cast(sum(onsite_count) as bigint) from rv) as total_onsite,
  (select {px.rounded("sum(remote_count) * 100.0 / nullif(sum(remote_count) + sum(onsite_count), 0)", 1)}
    from rv) as remote_pct"""

QUERIES = {
    "daily_role_demand": (lambda s, d: _roles(s, d, AS_OF), px.role_demand_sql(as_of=AS_OF)),
    "daily_skill_demand": (
        lambda s, d: gold.daily_skill_demand(px.postings(s, d), px.job_skills(s, d), AS_OF),
        px.skill_demand_sql(AS_OF),
    ),
    "daily_supplier_demand": (
        lambda s, d: gold.daily_role_demand(px.supplier_postings(s, d)),
        px.role_demand_sql(px.SUPPLIER_POSTINGS),
    ),
    "salary_summary": (_salaries, px.SALARY_SUMMARY),
    "remote_vs_onsite": (_remote, px.remote_sql(AS_OF)),
    "skill_cooccurrence": (_pairs, px.COOCCURRENCE),
    "market_alerts": (_alerts, px.ALERTS),
    "trending_skills": (
        lambda s, d: views.trending_skills(_skills(s, d), START, END, 20),
        f"""select skill, cast(sum(job_count) as bigint) as total_jobs, max(moving_avg_7d) as peak_7d_avg,
          max(moving_avg_30d) as peak_30d_avg from ({px.skill_demand_sql()}) where date {_BETWEEN}
        group by skill order by peak_7d_avg desc nulls last, skill limit 20""",
    ),
    "skill_timeseries": (
        lambda s, d: views.skill_timeseries(_skills(s, d), START, END, BRANDS),
        f"""select date, skill, job_count, moving_avg_7d from ({px.skill_demand_sql()})
        where date {_BETWEEN} and skill in {BRANDS} order by skill, date""",
    ),
    "top_cooccurrence": (
        lambda s, d: views.top_pairs(_pairs(s, d), 50),
        f"select * from ({px.COOCCURRENCE}) order by co_count desc, skill_a, skill_b limit 50",
    ),
    "skill_ranking": (
        lambda s, d: views.skill_ranking(_skills(s, d)),
        f"""select skill, cast(sum(job_count) as bigint) as total_jobs from ({px.skill_demand_sql()})
        group by skill order by total_jobs desc, skill""",
    ),
    "skills_yearly_top10": (
        lambda s, d: views.skills_yearly(_skills(s, d), "top10"),
        f"""with y as ({_YEARLY}), t as (select skill from y group by skill
          order by sum(total_jobs) desc, skill limit 10)
        select year, skill, cast(total_jobs as bigint) as total_jobs from y where skill in (select skill from t)""",
    ),
    "skills_yearly_all": (
        lambda s, d: views.skills_yearly(_skills(s, d), "all"),
        f"select year, skill, cast(total_jobs as bigint) as total_jobs from ({_YEARLY})",
    ),
    "yearly_chart": (
        _role_years,
        f"""select cast(year(date) as integer) as year, {_SUMS} from ({px.role_demand_sql()})
        group by 1""",
    ),
    "yearly_chart_ranking": (
        lambda s, d: views.chart_ranking(views.skills_yearly(_skills(s, d), "all"), 12),
        _RANKING,
    ),
    "yearly_chart_ranked": (
        lambda s, d: views.ranked_chart(views.skills_yearly(_skills(s, d), "all"), 12),
        f"""with y as ({_YEARLY}), r as ({_RANKING})
        select year, cast(sum(y.total_jobs) as bigint) as total_jobs, {_RANKS}
        from y left join r on y.skill = r.skill group by year""",
    ),
    "role_demand_filtered": (
        lambda s, d: views.role_demand(_roles(s, d), START, END, "medi"),
        f"""select * from ({px.role_demand_sql()}) where date {_BETWEEN} and role ilike '%medi%'""",
    ),
    "top_roles": (
        lambda s, d: views.top_roles(
            gold.daily_role_demand(px.supplier_postings(s, d)), START, END, 10
        ),
        f"""select role, cast(sum(job_count) as bigint) as total_jobs
        from ({px.role_demand_sql(px.SUPPLIER_POSTINGS)}) where date {_BETWEEN}
        group by role order by total_jobs desc, role limit 10""",
    ),
    "salaries_filtered": (
        lambda s, d: views.salaries(_salaries(s, d), "urg", "nation_1"),
        f"select * from ({px.SALARY_SUMMARY}) where role ilike '%urg%' and country = 'NATION_1'",
    ),
    "salary_top8": (
        lambda s, d: views.top_salaries(_salaries(s, d)),
        f"""select * from ({px.SALARY_SUMMARY}) where salary_median is not null
        order by salary_median desc, role, country limit 8""",
    ),
    "salary_explorer": (
        lambda s, d: views.salary_explorer(_salaries(s, d)),
        f"select * from ({px.SALARY_SUMMARY}) where sample_size >= 3",
    ),
    "salary_totals": (
        lambda s, d: views.salary_totals(_salaries(s, d)),
        f"""with x as ({px.SALARY_SUMMARY}) select
          (select count(*) from x) as group_count,
          (select role from x order by salary_median desc, role desc, country desc limit 1) as top_role,
          (select country from x order by salary_median desc, role desc, country desc limit 1) as top_country,
          (select max(salary_median) from x) as top_median,
          (select cast(sum(sample_size) as bigint) from x) as total_sample,
          (select count(distinct country) from x) as market_count""",
    ),
    "remote_series": (
        lambda s, d: views.remote_series(_remote(s, d), START, END, "low"),
        f"""select date, role, remote_count, onsite_count, remote_ratio from ({px.remote_sql(AS_OF)})
        where date {_BETWEEN} and role ilike '%low%'""",
    ),
    "remote_summary": (
        lambda s, d: views.remote_summary(_remote(s, d)),
        f"""select cast(sum(remote_count) as bigint) as total_remote,
          cast(sum(onsite_count) as bigint) as total_onsite,
          {px.rounded("sum(remote_count) * 100.0 / nullif(sum(remote_count) + sum(onsite_count), 0)", 1)}
            as remote_pct from ({px.remote_sql(AS_OF)})""",
    ),
    "alerts_view": (
        lambda s, d: views.alerts(_alerts(s, d), date(1995, 11, 9), "role"),
        f"select * from ({px.ALERTS}) where alert_date = date '1995-11-09' and entity_type = 'role'",
    ),
    "alert_counts": (
        lambda s, d: views.alert_counts(_alerts(s, d), date(1995, 11, 9)),
        f"""select count(*) filter (where alert_date = date '1995-11-09') as alerts_today,
          count(*) filter (where alert_date between date '1995-11-03' and date '1995-11-09') as alerts_last_7d,
          max(alert_date) as last_alert_date from ({px.ALERTS})""",
    ),
    "overview_metrics": (_overview, _OVERVIEW_SQL),
    "merge_upsert": (
        _merged,
        f"""with later as (select * from ({px.role_demand_sql()}) where date >= date '1998-01-01'),
        earlier as ({px.role_demand_sql(as_of="1999-12-31")})
        select * from later union all
        select date, role, 0 as job_count, moving_avg_7d, moving_avg_30d from earlier e
        where not exists (select 1 from later l where l.date = e.date and l.role = e.role)""",
    ),
}
