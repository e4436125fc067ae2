"""Stored aggregate tables: keyed merges that rewrite touched folders, and refreshes by run through a stream of commits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import gold_queries as gq, proxies as px
from laborlake.plans import gold
from laborlake.sources import files, schemas, tables, tabular
from laborlake.sources.staging import shared_folder
from laborlake.streaming import sinks, sources

#: Rows of a later run: their key's first column starts here.
LATER = {"daily_role_demand": "1998-06-15", "daily_skill_demand": "1999-02-10", "remote_vs_onsite": "2000-05-01", "market_alerts": "1996-03-01"}
FIRST_COLUMN = {"salary_summary": ("role", "3"), "skill_cooccurrence": ("skill_b", "Brand#2")}
#: What an earlier run counted too low.
COUNT = {
    "daily_role_demand": "job_count", "daily_skill_demand": "job_count", "salary_summary": "sample_size",
    "remote_vs_onsite": "remote_count", "skill_cooccurrence": "co_count", "market_alerts": "spike_ratio",
}


def _root(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/laborlake/{name}-{uuid.uuid4().hex}"


def _schema(table: str):
    return getattr(schemas, table.upper())


def _built(spark: SparkSession, d: str) -> dict:
    return {
        "daily_role_demand": lambda: gq._roles(spark, d),
        "daily_skill_demand": lambda: gq._skills(spark, d),
        "salary_summary": lambda: gq._salaries(spark, d),
        "remote_vs_onsite": lambda: gold.remote_vs_onsite(px.postings(spark, d)),
        "skill_cooccurrence": lambda: gq._pairs(spark, d),
        "market_alerts": lambda: gq._alerts(spark, d),
    }


SQL = {
    "daily_role_demand": px.role_demand_sql(),
    "daily_skill_demand": px.skill_demand_sql(),
    "salary_summary": px.SALARY_SUMMARY,
    "remote_vs_onsite": px.remote_sql(),
    "skill_cooccurrence": px.COOCCURRENCE,
    "market_alerts": px.ALERTS,
}


def _is_later(table: str) -> str:
    """Condition that both engines read alike."""
    if table in LATER:
        return f"{tables.GOLD_KEYS[table][0]} >= date '{LATER[table]}'"
    column, value = FIRST_COLUMN[table]
    return f"{column} >= '{value}'"


def upserted(table: str):
    """An earlier run stores the whole table with a wrong count, a later one merges the rows from a key on."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows, root = _built(spark, d)[table]().select(*_schema(table).names), _root(spark, f"upsert-{table}")
        wrong = F.lit(99).cast(_schema(table)[COUNT[table]].dataType)
        tables.upsert_gold(spark, root, table, rows.withColumn(COUNT[table], wrong), _schema(table))
        tables.upsert_gold(spark, root, table, rows.where(_is_later(table)), _schema(table))
        return tables.current(spark, f"{root}/{table}", _schema(table))

    kind = _schema(table)[COUNT[table]].dataType.simpleString()
    count = f"case when {_is_later(table)} then {COUNT[table]} else cast(99 as {kind}) end as {COUNT[table]}"
    return query, f"select * replace ({count}) from ({SQL[table]})"


RUNS = 3


def _store_run(spark: SparkSession, silver_root: str, run_id: str, jobs: DataFrame, skills: DataFrame) -> None:
    tables.uncommit(spark, silver_root, run_id)
    tables.write_run(skills, f"{silver_root}/job_skills", "run_id", run_id)
    tables.write_run(jobs, f"{silver_root}/jobs", "run_id", run_id)
    tables.commit(spark, silver_root, run_id)


def streamed(table: str, jobs_of, skills_of=None):
    """Three runs of postings, one micro-batch each. The first comes again, with more rows than it had: it had stopped early."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        jobs = jobs_of(spark, d)
        if "raw_hash" not in jobs.columns:
            jobs = jobs.withColumnRenamed("job_id", "raw_hash")
        jobs = jobs.withColumn("raw_hash", F.col("raw_hash").cast("string"))
        none = spark.createDataFrame([], schemas.JOB_SKILLS)
        skills = none if skills_of is None else skills_of(spark, d).select(F.col("job_id").cast("string").alias("job_id"), "skill_name")
        root = _root(spark, f"stream-{table}")

        def part(df: DataFrame, key: str, k: int) -> DataFrame:
            return df.where(F.pmod(F.xxhash64(key), F.lit(RUNS)) == k)

        def refresh() -> None:
            sinks.start_gold(spark, f"{root}/silver", f"{root}/gold", f"{root}/seen", max_runs=1, names=(table,)).awaitTermination()

        begun = F.col("raw_hash") < "3"
        _store_run(spark, f"{root}/silver", "run-0", part(jobs, "raw_hash", 0).where(begun), part(skills, "job_id", 0).where(F.col("job_id") < "3"))
        _store_run(spark, f"{root}/silver", "run-1", part(jobs, "raw_hash", 1), part(skills, "job_id", 1))
        refresh()
        for k in (0, 2):
            _store_run(spark, f"{root}/silver", f"run-{k}", part(jobs, "raw_hash", k), part(skills, "job_id", k))
        refresh()
        return tables.current(spark, f"{root}/gold/{table}", _schema(table))

    return query


def _supplier_jobs(spark: SparkSession, d: str) -> DataFrame:
    rows = px.supplier_postings(spark, d)
    return rows.withColumn("raw_hash", F.sha2(F.concat_ws("|", "title_normalized", "posted_at"), 256))


_SUPPLIER_ALERTS = px._spikes_sql(px.role_demand_sql(px.SUPPLIER_POSTINGS), "role")


def _first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Customers of orders as they land, in four loads of which the last two come after a restart; each customer once."""
    root = _root(spark, "first-seen")
    orders = px.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("raw_hash"), (F.col("o_orderkey") % 4).alias("load"))
    for loads in ((0, 1), (2, 3)):
        for load in loads:
            orders.where(F.col("load") == load).write.mode("append").parquet(f"{root}/landed")
        stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/landed")
        sources.start_first_seen(stream, f"{root}/seen", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/seen").groupBy("raw_hash").agg(F.count("*").alias("times"))


#: Headers of the CSV files: the first and second have a title.
_CSV = {0: ("Title", "pay"), 1: ("job_title", "place"), 2: ("name", "pay")}


def _routed(spark: SparkSession, d: str) -> DataFrame:
    """Parts as CSV files of three headers in one folder, routed by header, landed raw, and read back as raw tables."""
    root, run = _root(spark, "routed"), "r1"
    parts = px.table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("label"))
    for k, names in _CSV.items():
        rows = parts.where(F.col("p_partkey") % len(_CSV) == k).select(F.col("label").alias(names[0]), F.col("p_partkey").alias(names[1]))
        rows.write.mode("append").option("header", True).option("escape", '"').csv(f"{root}/csv")
    jobs, raw_only = tabular.route_by_header(spark, files.matching(spark, f"{root}/csv/*.csv"))
    for key, groups in (("jobs", jobs), ("other", raw_only)):
        for paths in groups.values():
            tabular.land_raw(spark, paths, f"{root}/raw", key, run)
    found = None
    for table in tabular.raw_tables(spark, f"{root}/raw"):
        label, number = (tabular.first_present(table, names).alias(c) for names, c in ((("title", "job_title", "name"), "label"), (("pay", "place"), "number")))
        rows = table.select("dataset_key", label, number, F.lit("place" in table.columns).alias("is_place"))
        found = rows if found is None else found.unionByName(rows)
    return found


_ROUTED = """select case when p_partkey % 3 = 2 then 'other' else 'jobs' end as dataset_key, p_name || ', "' || p_brand || '"' as label,
    cast(p_partkey as varchar) as number, p_partkey % 3 = 1 as is_place from part"""

QUERIES = {f"upsert_{t}": upserted(t) for t in tables.GOLD_KEYS} | {
    "stream_role_demand": (streamed("daily_role_demand", px.postings), SQL["daily_role_demand"]),
    "stream_skill_demand": (streamed("daily_skill_demand", px.postings, px.job_skills), SQL["daily_skill_demand"]),
    "stream_remote": (streamed("remote_vs_onsite", px.postings), SQL["remote_vs_onsite"]),
    "stream_salaries": (streamed("salary_summary", px.jobs), SQL["salary_summary"]),
    "stream_cooccurrence": (streamed("skill_cooccurrence", px.postings, px.job_skills), SQL["skill_cooccurrence"]),
    "stream_alerts": (streamed("market_alerts", _supplier_jobs), _SUPPLIER_ALERTS),
    "stream_first_seen": (_first_seen, "select cast(o_custkey as varchar) as raw_hash, 1 as times from orders group by o_custkey"),
    "routed_raw_tables": (_routed, _ROUTED),
}
