"""Plans keep the shape they need at scale."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from catalog import registered
from laborlake.operators.dedup import not_yet_stored
from laborlake.plans import features, gold, silver
from laborlake.sources import schemas

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no given tables")
EAGER = {"feature_matrix", "train_predict", "stream_daily_demand"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_auto_broadcast(spark):
    """Plans as for big tables: nothing is small enough to broadcast unasked."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", sorted(set(registered()) - EAGER))
def test_no_python_in_the_plan_and_no_products(spark, no_auto_broadcast, name):
    plan = plan_of(contract.queries()[name](spark, DATA))
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups|MapInArrow", plan)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def _jobs(spark):
    return spark.read.parquet(f"{DATA}/orders.parquet").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("title_normalized"),
        F.col("o_orderdate").alias("posted_at"), F.lit("US").alias("country"), F.lit("USD").alias("salary_currency"),
        F.col("o_totalprice").alias("salary_min"), F.col("o_totalprice").alias("salary_max"),
    )


def test_as_of_reaches_the_scan_and_columns_are_pruned(spark):
    plan = plan_of(gold.daily_role_demand(_jobs(spark), "1999-06-30", since="1999-06-01"))
    assert "LessThan(o_orderdate,1999-07-01T00:00" in plan
    assert "GreaterThanOrEqual(o_orderdate,1999-06-01T00:00" in plan
    assert re.search(r"FileScan parquet \[o_orderpriority#\d+,o_orderdate#\d+\]|FileScan parquet \[o_orderdate#\d+,o_orderpriority#\d+\]", plan)


def test_both_averages_share_one_window_and_sort(spark):
    plan = plan_of(gold.daily_role_demand(_jobs(spark)))
    assert len(re.findall(r"\bWindow \[", plan)) == 1 and plan.count("Sort [") == 1


def test_dedup_cuts_every_key_before_the_shuffle(spark):
    rows = spark.createDataFrame([], schemas.BRONZE).withColumn("_file", F.lit("f")).withColumn("_seq", F.lit(1))
    plan = plan_of(silver.dedup_batch(silver.with_hash(silver.clean(rows))))
    exchange = plan.index("Exchange hashpartitioning(raw_hash")
    assert "row_number(), 1, Partial" in plan[exchange:]


def test_distinct_count_needs_one_shuffle_after_the_join(spark, no_auto_broadcast):
    skills = spark.read.parquet(f"{DATA}/lineitem.parquet").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("skill_name")
    )
    plan = plan_of(gold.daily_skill_demand(_jobs(spark), skills))
    # jobs by id, skills by id, days and skills, skill for the averages
    assert plan.count("Exchange hashpartitioning") == 4


def test_only_the_rate_table_is_broadcast(spark, no_auto_broadcast):
    plan = plan_of(gold.salary_summary(_jobs(spark)))
    assert plan.count("BroadcastExchange") == len(re.findall(r"Scan ExistingRDD\[currency", plan)) > 0
    assert "percentile" not in plan


def test_spark_decides_whether_history_is_shuffled(spark, no_auto_broadcast):
    stored = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("text").alias("k"))
    incoming = spark.read.parquet(f"{DATA}/benchmark.parquet").select(F.col("text").alias("k"))
    assert "Broadcast" not in plan_of(not_yet_stored(incoming, stored, "k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    assert "hashpartitioning" not in plan_of(not_yet_stored(incoming, stored, "k"))


def test_distinct_count_holds_no_table_of_postings(spark, no_auto_broadcast):
    skills = spark.read.parquet(f"{DATA}/lineitem.parquet").select(F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("skill_name"))
    plan = plan_of(gold.daily_skill_demand(_jobs(spark), skills))
    assert not re.search(r"Aggregate\(keys=\[[^\]]*job_id#", plan)
    assert plan.count("SortMergeJoin") == 1 and plan.count("Sort [job_id") == 2  # the join needs no order of its own
    assert plan.count("Window [") == 3


def test_repeated_postings_and_skills_count_once_a_day(spark):
    jobs = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-01"), ("a", "2024-01-02"), ("b", "2024-01-01"), (None, "2024-01-01")], "job_id string, day string")
    skills = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("a", None), ("b", "x"), (None, "x")], "job_id string, skill_name string")
    got = gold.daily_skill_demand(jobs.select("job_id", F.to_timestamp("day").alias("posted_at")), skills)
    rows = {(str(r.date)[-2:], r.skill, r.job_count) for r in got.collect()}
    assert rows == {("01", "x", 2), ("01", None, 1), ("02", "x", 1), ("02", None, 1)} and got.count() == 4


def test_gaps_are_filled_by_the_exact_median(spark):
    """60,060 zeros and 59,940 ones, in an order that an approximate median gets wrong one way or the other."""
    flags = [0.0] * 60_060 + [1.0] * 59_940
    for middle, values in ((0.0, flags), (1.0, [1.0 - f for f in flags])):
        rows = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "remote_int double").withColumns({"skill_count": F.lit(1.0), "role": F.lit("r"), "country": F.lit("c"), "source": F.lit("s")})
        filled = features.feature_pipeline([]).fit(rows.repartition(8)).transform(rows.where("remote_int is null"))
        assert filled.first().remote_int_known == middle
