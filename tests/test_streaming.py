"""Streams taken to completion give what the batch builds give."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from laborlake.plans import gold, silver
from laborlake.sources import bronze, schemas, tables
from laborlake.streaming import sinks, sources
from tests.test_storage import DAY, land, posting


@pytest.fixture
def landed(tmp_path):
    root = tmp_path / "bronze"
    land(root, "adzuna", DAY, [posting("A"), posting("a "), posting("B", skills_extracted=["Go"])])
    land(root, "remotive", DAY, [posting("C", "remotive"), {"title": "no source"}])
    return root


def _jobs(spark, root):
    return tables.read_runs(spark, f"{root}/jobs", schemas.JOBS, "run_id")


def test_silver_stream_equals_batch(spark, landed, tmp_path):
    root, checkpoint = str(tmp_path / "silver"), str(tmp_path / "cp")

    def run():
        query = sinks.start_silver(sources.bronze_stream(spark, str(landed)), root, checkpoint)
        query.awaitTermination()

    run()
    batch = silver.build(bronze.read_bronze(spark, str(landed)), None, "b")
    columns = [c for c in schemas.JOBS.names if c not in ("run_id", "external_id")]
    want = sorted(tuple(r) for r in batch.jobs.select(columns).collect())
    assert sorted(tuple(r) for r in _jobs(spark, root).select(columns).collect()) == want
    assert len(want) == 3 and spark.read.parquet(f"{root}/rejects").count() == 1
    land(landed, "adzuna", "2024-03-02", [posting("A"), posting("D")])
    run()
    assert sorted(r.title for r in _jobs(spark, root).collect()) == ["A", "B", "C", "D"]


def test_repeated_micro_batch_leaves_no_duplicates(spark, landed, tmp_path):
    root = str(tmp_path / "silver")
    write = sinks.silver_writer(root)
    rows = bronze.read_bronze(spark, str(landed)).drop("_seq")
    for _ in range(2):
        write(rows, 0)
    assert _jobs(spark, root).count() == 3 and spark.read.parquet(f"{root}/job_skills").count() == 1


def test_first_seen(spark, landed, tmp_path):
    hashed = silver.with_hash(silver.clean(sources.bronze_stream(spark, str(landed))))
    timed = hashed.withColumn("at", F.to_timestamp("posted_at"))
    query = (
        sources.first_seen(timed, "at", "2 days").select("raw_hash", "title")
        .writeStream.format("memory").queryName("first_seen")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.table("first_seen")
    assert got.count() == got.select("raw_hash").distinct().count() == 4


def test_late_records_count(spark, tmp_path):
    root = str(tmp_path / "counts")
    write = sources.daily_count_writer(root, "at", "role")
    for batch_id, day in enumerate(["2024-03-10", "2024-03-11", "2024-03-01", "2024-03-10"]):
        rows = spark.createDataFrame([(f"{day} 23:00:00", "x"), (None, "x")], "at string, role string")
        for _ in range(2):  # a repeated batch counts once
            write(rows.withColumn("at", F.to_timestamp("at")), batch_id)
    got = {(str(r.date), r.role, r.job_count) for r in sources.daily_counts(spark, root, "role").collect()}
    assert got == {("2024-03-10", "x", 2), ("2024-03-11", "x", 1), ("2024-03-01", "x", 1)}
    assert sources.daily_counts(spark, str(tmp_path / "none"), "role").count() == 0


def test_first_seen_keeps_late_records_without_a_horizon(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [("a", "2024-03-10"), ("b", "2024-03-11"), ("c", "2024-03-01"), ("a", "2024-03-10")]
    for key, day in rows:
        spark.createDataFrame([(key, day)], "raw_hash string, day string").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("raw_hash string, day string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = (
        sources.first_seen(stream.withColumn("at", F.to_timestamp("day")), "at", None).select("raw_hash")
        .writeStream.format("memory").queryName("first_seen_all")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.raw_hash for r in spark.table("first_seen_all").collect()) == ["a", "b", "c"]


def test_first_seen_on_disk_over_restarts(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), str(tmp_path / "seen")
    batches = [["a", "b", None], ["b", "c"], ["a", "a", "d", None], ["e", "c"]]

    def start():
        stream = spark.readStream.schema("raw_hash string, day string").option("maxFilesPerTrigger", 1).parquet(folder)
        query = sources.start_first_seen(stream, seen, str(tmp_path / "cp"))
        query.awaitTermination()
        return query

    for k, keys in enumerate(batches):
        spark.createDataFrame([(x, str(k)) for x in keys], "raw_hash string, day string").coalesce(1).write.mode("append").parquet(folder)
        if k % 2:
            query = start()
    operator = query.lastProgress.stateOperators[0]
    assert any("rocksdb" in name.lower() for name in operator.customMetrics)
    got = sorted((r.raw_hash or "", r.day) for r in spark.read.parquet(seen).collect())
    assert [k for k, _ in got] == ["", "a", "b", "c", "d", "e"] and dict(got)["d"] == "2" and dict(got)["e"] == "3"
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_first_seen_state_has_parts_by_cores(spark, tmp_path):
    folder, seen, checkpoint = (str(tmp_path / n) for n in ("in", "seen", "cp"))
    before, parts = spark.conf.get("spark.sql.shuffle.partitions"), []
    for session_parts, keys in (("200", ["a", "b", None]), ("7", ["b", "c", None])):
        spark.createDataFrame([(x,) for x in keys], "raw_hash string").coalesce(1).write.mode("append").parquet(folder)
        spark.conf.set("spark.sql.shuffle.partitions", session_parts)
        try:
            query = sources.start_first_seen(spark.readStream.schema("raw_hash string").parquet(folder), seen, checkpoint)
            query.awaitTermination()
            assert spark.conf.get("spark.sql.shuffle.partitions") == session_parts
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        parts.append(query.recentProgress[0].stateOperators[0].numShufflePartitions)
    assert parts == [max(sources.FEW_PARTS, 2 * spark.sparkContext.defaultParallelism)] * 2
    assert sorted(r.raw_hash or "" for r in spark.read.parquet(seen).collect()) == ["", "a", "b", "c"]


def _table(spark, root, name):
    schema = getattr(schemas, name.upper())
    return sorted(tuple(r) for r in tables.current(spark, f"{root}/{name}", schema).collect())


def test_gold_stream_equals_batch_refresh(spark, landed, tmp_path):
    silver_root, gold_root, batch_root = (str(tmp_path / n) for n in ("silver", "gold", "batch"))
    pay = [posting(f"Data engineer {i}", salary_min=100 + i, salary_max=300, country="us", remote=True) for i in range(4)]
    days = [("2024-03-01", pay), ("2024-03-02", [posting("Data engineer 9", posted_at="2024-02-05", skills_extracted=["go"])])]
    for day, records in days:
        land(landed, "adzuna", day, records, name="batch_0009.json")
        stream = sources.bronze_stream(spark, str(landed))
        sinks.start_silver(stream, silver_root, str(tmp_path / "cp-silver")).awaitTermination()
        sinks.start_gold(spark, silver_root, gold_root, str(tmp_path / "cp-gold")).awaitTermination()
    skills = spark.read.parquet(f"{silver_root}/job_skills")
    gold.refresh(spark, _jobs(spark, silver_root), skills, batch_root, "2030-01-01")
    for name in sinks.ENTITIES:
        got = _table(spark, gold_root, name)
        assert got == _table(spark, batch_root, name) and got
    write = sinks.gold_writer(silver_root, gold_root)
    before = _table(spark, gold_root, "daily_role_demand")
    write(_jobs(spark, silver_root), 7)  # repeating postings changes nothing
    assert _table(spark, gold_root, "daily_role_demand") == before


def test_gold_stream_leaves_other_entities_alone(spark, landed, tmp_path):
    silver_root, gold_root = str(tmp_path / "silver"), str(tmp_path / "gold")
    sinks.start_silver(sources.bronze_stream(spark, str(landed)), silver_root, str(tmp_path / "cp")).awaitTermination()
    odd = spark.createDataFrame([(date(2020, 1, 1), "Gone", 7, 7.0, 7.0)], schemas.DAILY_ROLE_DEMAND)
    tables.upsert_gold(spark, gold_root, "daily_role_demand", odd, schemas.DAILY_ROLE_DEMAND)
    sinks.gold_writer(silver_root, gold_root)(_jobs(spark, silver_root), 0)
    assert {r[1] for r in _table(spark, gold_root, "daily_role_demand")} == {"Gone", "Other"}
    with pytest.raises(ValueError):
        sinks.rebuild("skill_cooccurrence", None, None, None)
