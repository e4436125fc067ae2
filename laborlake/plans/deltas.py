"""Aggregate tables kept up to date by what each run adds.

Every run leaves small sums of its own: postings per day and role, per day and skill, per pair of skills, and per salary
value. They lie by run and folder (month, or bucket of the key). A refresh for some runs

1. notes the keys that these runs touch, or touched when they were last refreshed, under ``pending``,
2. replaces the runs' own sums,
3. adds up, over all runs, the sums of the touched keys from the folders that hold them, and
4. merges the rows that follow into the aggregate tables, where rows of touched keys that no longer follow go away.

Averages and alerts of a day look back 29 days, so those of 30 days follow a touched day of a role or skill; nothing else
is computed again. Only the sums are read: neither the history of postings nor that of skills. A refresh that is
repeated, or that comes after one which failed half-way, gives the same tables, since sums belong to a run and pending
keys are kept until all tables are merged. ``compact`` adds up the sums of many runs, so that their number stays small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laborlake.operators.pairs import pair_counts
from laborlake.operators.percentiles import exact_percentiles
from laborlake.operators.trend import trailing_averages
from laborlake.plans import gold, silver
from laborlake.sources import files, schemas, tables
from laborlake.sources.staging import freed, staged

FOLDER = tables.FOLDER
#: Days before a day that its averages look at.
LOOK_BACK = 29
#: Run that holds the sums of compacted runs.
BASE = "base"


@dataclass(frozen=True)
class Sums:
    """What a run leaves: ``counts`` per ``keys``. A change of a value calls for the rows of its first ``entity`` keys."""

    keys: tuple[str, ...]
    counts: tuple[str, ...]
    schema: str
    of: Callable[[DataFrame, DataFrame], DataFrame]
    entity: int

    @property
    def touched(self) -> tuple[str, ...]:
        return self.keys[: self.entity]

    def stored(self) -> T.StructType:
        return T.StructType([*T._parse_datatype_string(self.schema).fields, T.StructField("run_id", T.StringType()), T.StructField(FOLDER, T.StringType())])


def role_days(jobs: DataFrame, job_skills: DataFrame) -> DataFrame:
    dated = jobs.where(F.col("posted_at").isNotNull())
    role = F.coalesce("title_normalized", F.lit("Other")).alias("role")
    return dated.groupBy("run_id", F.to_date("posted_at").alias("date"), role).agg(F.count("*").alias("job_count"), *gold.remote_counts())


def skill_days(jobs: DataFrame, job_skills: DataFrame) -> DataFrame:
    dated = jobs.where(F.col("posted_at").isNotNull()).select("run_id", F.col("raw_hash").alias("job_id"), F.to_date("posted_at").alias("date"))
    skills = job_skills.select("run_id", "job_id", F.col("skill_name").alias("skill"))
    return dated.join(skills, ["run_id", "job_id"]).groupBy("run_id", "date", "skill").agg(F.countDistinct("job_id").alias("job_count"))


def skill_pairs(jobs: DataFrame, job_skills: DataFrame) -> DataFrame:
    return pair_counts(job_skills, "job_id", "skill_name", "skill_a", "skill_b", "co_count", by=("run_id",))


def salary_values(jobs: DataFrame, job_skills: DataFrame) -> DataFrame:
    """Equal salaries are counted in their own currency, so that rates may change."""
    return gold.mid_salaries(jobs).groupBy("run_id", "role", "country", "currency", "mid").agg(F.count("*").alias("times"))


SUMS = {
    "role_days": Sums(
        ("date", "role"), ("job_count", "remote_count", "onsite_count", "unknown_count"),
        "date date, role string, job_count bigint, remote_count bigint, onsite_count bigint, unknown_count bigint", role_days, 2,
    ),
    "skill_days": Sums(("date", "skill"), ("job_count",), "date date, skill string, job_count bigint", skill_days, 2),
    "skill_pairs": Sums(("skill_a", "skill_b"), ("co_count",), "skill_a string, skill_b string, co_count bigint", skill_pairs, 2),
    "salary_values": Sums(
        ("role", "country", "currency", "mid"), ("times",), "role string, country string, currency string, mid double, times bigint", salary_values, 2
    ),
}
#: Sums that each aggregate table follows from.
FOLLOWS = {
    "daily_role_demand": ("role_days",),
    "remote_vs_onsite": ("role_days",),
    "daily_skill_demand": ("skill_days",),
    "salary_summary": ("salary_values",),
    "skill_cooccurrence": ("skill_pairs",),
    "market_alerts": ("role_days", "skill_days"),
}


def _root(gold_root: str, name: str) -> str:
    return f"{gold_root}/sums/{name}"


def read(spark: SparkSession, gold_root: str, name: str) -> DataFrame:
    """The sums of all runs, with ``run_id`` and folder."""
    sums = SUMS[name]
    if not files.matching(spark, f"{_root(gold_root, name)}/runs/run_id=*"):
        return spark.createDataFrame([], sums.stored())
    return spark.read.schema(sums.stored()).parquet(f"{_root(gold_root, name)}/runs")


def _settle(spark: SparkSession, gold_root: str) -> None:
    """Finish compactions that were written but not put in place."""
    for name in SUMS:
        if files.exists(spark, f"{_root(gold_root, name)}/compacted/_SUCCESS"):
            files.replace(spark, f"{_root(gold_root, name)}/compacted", f"{_root(gold_root, name)}/runs")


def _replace(spark: SparkSession, gold_root: str, name: str, jobs: DataFrame, job_skills: DataFrame, run_ids: Sequence[str]) -> None:
    """Put the runs' sums in place of those they had, after noting the keys of both as pending."""
    sums, root = SUMS[name], _root(gold_root, name)
    folder = tables.folder_of(sums.touched)
    new = staged(sums.of(jobs, job_skills).withColumn(FOLDER, folder), f"sums-{name}")
    old = read(spark, gold_root, name).where(F.col("run_id").isin(*run_ids))
    keys = [*sums.touched, FOLDER]
    new.select(*keys).unionByName(old.select(*keys)).distinct().write.mode("append").parquet(f"{root}/pending")
    for run_id in run_ids:
        files.remove(spark, f"{root}/runs/run_id={run_id}")
    new.hint("rebalance", "run_id", FOLDER).write.mode("append").partitionBy("run_id", FOLDER).parquet(f"{root}/runs")


def _pending(spark: SparkSession, gold_root: str, name: str) -> DataFrame:
    sums = SUMS[name]
    fields = [f for f in sums.stored() if f.name in (*sums.touched, FOLDER)]
    return spark.read.schema(T.StructType(fields)).parquet(f"{_root(gold_root, name)}/pending").distinct()


def _touched_rows(spark: SparkSession, gold_root: str, name: str, keys: DataFrame) -> DataFrame:
    """Each run's sums for ``keys``, which have a folder; only their folders are read. The driver gets folder names."""
    held = [r[0] for r in keys.select(FOLDER).distinct().collect()]
    return read(spark, gold_root, name).where(F.col(FOLDER).isin(held)).join(keys, [FOLDER, *SUMS[name].touched], "left_semi")


def _touched_sums(spark: SparkSession, gold_root: str, name: str, keys: DataFrame) -> DataFrame:
    """Sums over all runs for ``keys``."""
    sums, rows = SUMS[name], _touched_rows(spark, gold_root, name, keys)
    return rows.groupBy(*sums.keys).agg(*[F.sum(c).alias(c) for c in sums.counts])


def _demand(spark: SparkSession, gold_root: str, name: str, touched: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """Demand of the days that follow touched ones, and the keys that it speaks for: (rows, (date, entity)).

    The months around touched days are read for touched entities. Which days follow a touched one is seen in the order of an
    entity's days, so that each day is one row whatever the number of touched days around it. A touched day that is gone
    stays in that order without a count, which averages leave out.
    """
    near = touched.select("date").distinct().select(F.expr(f"explode(sequence(date_sub(date, {LOOK_BACK}), date_add(date, {LOOK_BACK}))) AS date"))
    held = [r[0] for r in near.select(tables.folder_of(("date",))).distinct().collect()]
    rows = read(spark, gold_root, name).where(F.col(FOLDER).isin(held)).join(touched.select(entity).distinct(), entity, "left_semi")
    keys = touched.select("date", entity)
    days = (
        rows.select("date", entity, "job_count", F.lit(None).cast("date").alias("touched"))
        .unionByName(keys.withColumns({"job_count": F.lit(None).cast("long"), "touched": F.col("date")}))
        .groupBy("date", entity)
        .agg(F.sum("job_count").alias("job_count"), F.max("touched").alias("touched"))
    )
    upto = Window.partitionBy(entity).orderBy(F.unix_date("date")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    averaged = trailing_averages(days, entity).withColumn("touched", F.max("touched").over(upto))
    # Days without a count are touched ones that are gone.
    found = staged(averaged.where(F.date_diff("date", "touched") <= LOOK_BACK).drop("touched"), f"{name}-demand")
    return found.where(F.col("job_count").isNotNull()), found.select("date", entity)


def refresh(
    spark: SparkSession,
    jobs: DataFrame,
    job_skills: DataFrame,
    gold_root: str,
    run_ids: Sequence[str],
    *,
    names: Sequence[str] = tuple(FOLLOWS),
    fx: DataFrame | None = None,
    min_sample: int = 3,
    min_count: int = 5,
    ratio: float = 2.0,
) -> None:
    """Bring the aggregate tables ``names`` up to what they are with these runs as they are now.

    ``jobs`` and ``job_skills`` have a ``run_id`` and may be the whole tables: only the given runs are read. A run that
    is gone (no rows) is taken off. Each table must always be refreshed with all its runs, whatever their order.
    """

    def put(table: str, rows: DataFrame, scope: DataFrame) -> None:
        schema = getattr(schemas, table.upper())
        tables.upsert_gold(spark, gold_root, table, rows.select(*schema.names), schema, min_sample=min_sample, scope=scope)

    def alerts(rows: DataFrame, changed: DataFrame, entity: str) -> None:
        scope = changed.select(F.col("date").alias("alert_date"), F.lit(entity).alias("entity_type"), F.col(entity).alias("entity_name"))
        put("market_alerts", gold.spikes(rows, entity, ratio=ratio), scope)

    of_runs = F.col("run_id").isin(*run_ids)
    wanted = [s for s in SUMS if any(s in FOLLOWS[t] for t in names)]
    _settle(spark, gold_root)
    with freed(spark):
        for name in wanted:
            _replace(spark, gold_root, name, jobs.where(of_runs), job_skills.where(of_runs), run_ids)
        touched = {name: staged(_pending(spark, gold_root, name), f"{name}-touched") for name in wanted}
        for name, entity, table in (("role_days", "role", "daily_role_demand"), ("skill_days", "skill", "daily_skill_demand")):
            if {table, "market_alerts"} & set(names) and name in touched:
                rows, changed = _demand(spark, gold_root, name, touched[name], entity)
                if table in names:
                    put(table, rows, changed)
                if "market_alerts" in names:
                    alerts(rows, changed, entity)
        if "remote_vs_onsite" in names:
            sums = _touched_sums(spark, gold_root, "role_days", touched["role_days"])
            put("remote_vs_onsite", gold.with_remote_ratio(sums), touched["role_days"])
        if "skill_cooccurrence" in names:
            pairs = _touched_sums(spark, gold_root, "skill_pairs", touched["skill_pairs"])
            put("skill_cooccurrence", pairs.where(F.col("co_count") >= min_count), touched["skill_pairs"])
        if "salary_summary" in names:
            # Equal salaries of several runs are added up with those that are equal in dollars.
            values = gold.in_usd(_touched_rows(spark, gold_root, "salary_values", touched["salary_values"]), fx)
            rows = exact_percentiles(values, ["role", "country"], "salary_usd", gold.SALARY_PERCENTILES, min_count=min_sample, times="times")
            put("salary_summary", rows, touched["salary_values"])
        for name in wanted:
            files.remove(spark, f"{_root(gold_root, name)}/pending")


def refresh_from_silver(spark: SparkSession, silver_root: str, gold_root: str, run_ids: Sequence[str], **options) -> None:
    """``refresh`` for committed runs of a Silver folder."""
    jobs, skills = (silver.stored(spark, silver_root, t) for t in ("jobs", "job_skills"))
    refresh(spark, jobs, skills, gold_root, run_ids, **options)


def compact(spark: SparkSession, gold_root: str, run_ids: Sequence[str]) -> None:
    """Add the sums of these runs to one base run, for runs that won't be replaced any more.

    The new sums are written beside the old ones and take their place at the end. One that fails before they are all
    written changes nothing; one that fails later is finished by the next refresh or compaction.
    """
    _settle(spark, gold_root)
    for name, sums in SUMS.items():
        root = _root(gold_root, name)
        if not files.matching(spark, f"{root}/runs/run_id=*"):
            continue
        folded = [*run_ids, BASE]
        rows = read(spark, gold_root, name)
        kept = rows.where(~F.col("run_id").isin(*folded))
        base = rows.where(F.col("run_id").isin(*folded)).groupBy(*sums.keys, FOLDER).agg(*[F.sum(c).alias(c) for c in sums.counts])
        whole = reduce(DataFrame.unionByName, [kept, base.withColumn("run_id", F.lit(BASE))])
        whole.hint("rebalance", "run_id", FOLDER).write.mode("overwrite").partitionBy("run_id", FOLDER).parquet(f"{root}/compacted")
        files.replace(spark, f"{root}/compacted", f"{root}/runs")
