"""Postings, skills and texts derived from the given tables, in Spark and in SQL.

The given tables hold no job postings, so orders stand for postings, the brands
of their lines for skills, and documents for posting texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choice(index: Column, values: list[str | None]) -> Column:
    """The value at a 0-based index, written as CASE so that both engines read alike."""
    out = None
    for i, v in enumerate(values):
        value = F.lit(v).cast("string")
        out = F.when(index == i, value) if out is None else out.when(index == i, value)
    return out


def choice_sql(index: str, values: list[str | None]) -> str:
    def quoted(v):
        return "null" if v is None else "'" + v.replace("'", "''") + "'"

    arms = " ".join(f"when {i} then {quoted(v)}" for i, v in enumerate(values))
    return f"(case {index} {arms} end)"


# Postings without place or pay: orders alone.


def postings(spark: SparkSession, d: str) -> DataFrame:
    return _posting_columns(table(spark, d, "orders"))


def _posting_columns(orders: DataFrame, *more: Column) -> DataFrame:
    third = F.col("o_custkey") % 3
    return orders.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderstatus").alias("source"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias(
            "title_normalized"
        ),
        F.when(third == 0, F.lit(True)).when(third == 1, F.lit(False)).alias("remote"),
        F.col("o_orderdate").alias("posted_at"),
        *more,
    )


_POSTING_SQL = """o_orderkey as job_id, o_orderstatus as source,
  case when o_orderpriority <> '4-NOT SPECIFIED' then o_orderpriority end as title_normalized,
  case o_custkey % 3 when 0 then true when 1 then false end as remote,
  o_orderdate as posted_at"""
POSTINGS = f"select {_POSTING_SQL} from orders"

# Postings with country, pay and currency: orders with customer and nation.


def jobs(spark: SparkSession, d: str) -> DataFrame:
    joined = (
        table(spark, d, "orders")
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    region = F.col("n_regionkey")
    return _posting_columns(
        joined,
        F.when(F.col("n_nationkey") % 7 != 0, F.col("n_name")).alias("country"),
        F.when(region == 0, "usd")
        .when(region == 1, "EUR")
        .when(region == 2, " GBP ")
        .when(region == 3, "")
        .otherwise("XXX")
        .alias("salary_currency"),
        F.col("o_totalprice").alias("salary_min"),
        (F.col("o_totalprice") + F.col("c_acctbal")).alias("salary_max"),
    )


JOBS = f"""select {_POSTING_SQL},
  case when n_nationkey % 7 <> 0 then n_name end as country,
  case n_regionkey when 0 then 'usd' when 1 then 'EUR' when 2 then ' GBP ' when 3 then '' else 'XXX' end
    as salary_currency,
  o_totalprice as salary_min, o_totalprice + c_acctbal as salary_max
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"""

# Skills of a posting: the distinct brands of its lines.


def job_skills(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_partkey")
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("skill_name"))
    return (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select("job_id", "skill_name")
        .distinct()
    )


JOB_SKILLS = """select distinct l_orderkey as job_id, p_brand as skill_name
from lineitem join part on l_partkey = p_partkey"""

# Sparse daily series with real spikes: lines by ship day and supplier.


def supplier_postings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_shipdate").alias("posted_at"),
        F.col("l_suppkey").cast("string").alias("title_normalized"),
    )


SUPPLIER_POSTINGS = (
    "select l_shipdate as posted_at, cast(l_suppkey as varchar) as title_normalized from lineitem"
)


# SQL of the aggregate tables over the relations above.


def role_demand_sql(source: str = POSTINGS, as_of: str | None = None) -> str:
    bound = f" and cast(posted_at as date) <= date '{as_of}'" if as_of else ""
    daily = f"""select cast(posted_at as date) as date, coalesce(title_normalized, 'Other') as role,
      count(*) as job_count from ({source}) where posted_at is not null{bound} group by 1, 2"""
    return _averages_sql(daily, "role")


def skill_demand_sql(as_of: str | None = None) -> str:
    bound = f" and cast(posted_at as date) <= date '{as_of}'" if as_of else ""
    daily = f"""select cast(j.posted_at as date) as date, s.skill_name as skill,
      count(distinct j.job_id) as job_count from ({POSTINGS}) j join ({JOB_SKILLS}) s on s.job_id = j.job_id
      where j.posted_at is not null{bound} group by 1, 2"""
    return _averages_sql(daily, "skill")


def _averages_sql(daily: str, entity: str) -> str:
    return f"""select date, {entity}, job_count,
      round(avg(job_count) over (partition by {entity} order by date
        range between interval '6' day preceding and current row), 2) as moving_avg_7d,
      round(avg(job_count) over (partition by {entity} order by date
        range between interval '29' day preceding and current row), 2) as moving_avg_30d
    from ({daily})"""


FX_VALUES = """(values ('USD', 1.0), ('EUR', 0.92), ('GBP', 0.79), ('CAD', 1.36), ('AUD', 1.51),
  ('INR', 83.0), ('SGD', 1.35), ('ZAR', 18.0), ('NZD', 1.64), ('CHF', 0.90))"""


def rounded(x: str, digits: int = 2) -> str:
    return f"cast(round(cast({x} as decimal(28, 6)), {digits}) as double)"


def _percentile(p: float) -> str:
    return rounded(f"quantile_cont(salary_usd, {p})")


SALARY_SUMMARY = f"""with fx as (select col0 as currency, cast(col1 as double) as rate from {FX_VALUES}),
salaries as (select coalesce(title_normalized, 'Other') as role, coalesce(country, 'UNKNOWN') as country,
    ((salary_min + salary_max) / 2.0) / rate as salary_usd
  from ({JOBS}) join fx on currency = upper(coalesce(nullif(trim(salary_currency), ''), 'USD'))
  where salary_min > 0 and salary_max >= salary_min and rate > 0)
select role, country, count(*) as sample_size, {_percentile(0.5)} as salary_median,
  {_percentile(0.25)} as salary_p25, {_percentile(0.75)} as salary_p75, {_percentile(0.9)} as salary_p90
from salaries group by 1, 2 having count(*) >= 3"""


def remote_sql(as_of: str | None = None) -> str:
    bound = f" and cast(posted_at as date) <= date '{as_of}'" if as_of else ""
    return f"""select date, role, remote_count, onsite_count, unknown_count,
      {rounded("remote_count / nullif(remote_count + onsite_count, 0)", 4)} as remote_ratio
    from (select cast(posted_at as date) as date, coalesce(title_normalized, 'Other') as role,
        count(*) filter (where remote) as remote_count,
        count(*) filter (where not remote) as onsite_count,
        count(*) filter (where remote is null) as unknown_count
      from ({POSTINGS}) where posted_at is not null{bound} group by 1, 2)"""


COOCCURRENCE = f"""with s as ({JOB_SKILLS})
select a.skill_name as skill_a, b.skill_name as skill_b, count(*) as co_count
from s a join s b on a.job_id = b.job_id and a.skill_name < b.skill_name
group by 1, 2 having count(*) >= 5 order by co_count desc, skill_a, skill_b limit 1000"""


def _spikes_sql(demand: str, entity: str) -> str:
    return f"""select date as alert_date, '{entity}' as entity_type, {entity} as entity_name,
      moving_avg_7d as demand_7d_avg, moving_avg_30d as demand_30d_avg,
      {rounded("moving_avg_7d / moving_avg_30d")} as spike_ratio
    from ({demand}) where moving_avg_30d > 0 and moving_avg_7d >= 2 * moving_avg_30d"""


ALERTS = (
    _spikes_sql(role_demand_sql(SUPPLIER_POSTINGS), "role")
    + " union all "
    + _spikes_sql(skill_demand_sql(), "skill")
)
