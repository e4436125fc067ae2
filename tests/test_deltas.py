"""Aggregate tables refreshed by deltas against the batch builds; folders that a merge rewrites; commits."""

import random
from datetime import date, datetime, timedelta

import pytest

from laborlake.plans import deltas, features, gold, silver
from laborlake.sources import bronze, files, ledger, schemas, tables
from laborlake.streaming import sinks, sources
from tests.test_storage import DAY, land, posting

JOBS = "raw_hash string, run_id string, title_normalized string, country string, remote boolean, salary_min double, salary_max double, salary_currency string, posted_at timestamp_ntz"


def postings(seed, n, run_id, first=date(2024, 1, 1), days=70):
    rng = random.Random(seed)
    jobs, skills = [], []
    for i in range(n):
        key = f"{run_id}-{seed}-{i}"
        day = first + timedelta(rng.randrange(days)) if rng.random() < 0.7 else first + timedelta(days - 1)
        at = None if i % 11 == 0 else datetime(day.year, day.month, day.day, rng.randrange(24))
        low = rng.choice([None, 0.0, 50.0, 70.0, 90.0])
        jobs.append((key, run_id, rng.choice([None, "A", "B"]), rng.choice([None, "US"]), rng.choice([None, True, False]), low, 100.0 + i % 7, rng.choice([None, "EUR", "XXX"]), at))
        skills += [(key, run_id, s) for s in rng.sample(["go", "r", "sql", "c"], rng.randrange(4))]
    return jobs, skills


def frames(spark, runs):
    jobs = [r for j, _ in runs.values() for r in j]
    skills = [r for _, s in runs.values() for r in s]
    return spark.createDataFrame(jobs, JOBS), spark.createDataFrame(skills, "job_id string, run_id string, skill_name string")


def rows(df, name):
    return sorted(tuple(r) for r in df.select(*getattr(schemas, name.upper()).names).collect())


def batch(jobs, skills):
    role = gold.daily_role_demand(jobs)
    skill = gold.daily_skill_demand(jobs, skills, job_key="raw_hash")
    return {
        "daily_role_demand": role,
        "daily_skill_demand": skill,
        "salary_summary": gold.salary_summary(jobs),
        "remote_vs_onsite": gold.remote_vs_onsite(jobs),
        "skill_cooccurrence": gold.skill_cooccurrence(skills),
        "market_alerts": gold.market_alerts(role, skill),
    }


def same_as_batch(spark, root, jobs, skills):
    for name, df in batch(jobs, skills).items():
        got = rows(tables.current(spark, f"{root}/{name}", getattr(schemas, name.upper())), name)
        assert got == rows(df, name), name
        assert got, name


def test_refreshes_by_run_equal_the_batch(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "gold")
    runs = {"r1": postings(1, 60, "r1"), "r2": postings(2, 60, "r2"), "late": postings(3, 15, "late", date(2023, 12, 1), 40)}
    for run in runs:  # the last one is dated before the others
        deltas.refresh(spark, *frames(spark, runs), root, [run])
    same_as_batch(spark, root, *frames(spark, runs))
    # A repeated run changes nothing, one that comes again with other rows replaces what it had.
    runs["r2"] = postings(4, 25, "r2")
    put = tables.upsert_gold
    failing = {"n": 0}

    def fails_once(spark, gold_root, table, *args, **more):
        failing["n"] += 1
        if failing["n"] == 3:
            raise RuntimeError("lost")
        return put(spark, gold_root, table, *args, **more)

    monkeypatch.setattr(tables, "upsert_gold", fails_once)
    with pytest.raises(RuntimeError):
        deltas.refresh(spark, *frames(spark, runs), root, ["r1", "r2"])
    deltas.refresh(spark, *frames(spark, runs), root, ["r1", "r2"])
    same_as_batch(spark, root, *frames(spark, runs))
    # Compacted runs count as before, and the next run comes on top of them.
    deltas.compact(spark, root, ["r1", "r2"])
    runs["r3"] = postings(5, 30, "r3", date(2024, 2, 1), 30)
    deltas.refresh(spark, *frames(spark, runs), root, ["r3"])
    same_as_batch(spark, root, *frames(spark, runs))
    assert {r.run_id for r in deltas.read(spark, root, "role_days").select("run_id").distinct().collect()} == {"base", "late", "r3"}


def test_a_run_that_is_gone_is_taken_off(spark, tmp_path):
    root = str(tmp_path / "gold")
    runs = {"r1": postings(1, 40, "r1"), "r2": postings(2, 30, "r2", date(2023, 1, 1))}
    names = ("remote_vs_onsite", "skill_cooccurrence")
    deltas.refresh(spark, *frames(spark, runs), root, ["r1", "r2"], names=names)
    del runs["r2"]
    deltas.refresh(spark, *frames(spark, runs), root, ["r2"], names=names)
    want = batch(*frames(spark, runs))
    for name in names:
        assert rows(tables.current(spark, f"{root}/{name}", getattr(schemas, name.upper())), name) == rows(want[name], name)


def test_a_merge_rewrites_the_folders_it_touches(spark, tmp_path):
    root = tmp_path / "t"
    day = lambda m, d, n: (date(2024, m, d), "A", n, 1.0, 1.0)
    put = lambda rs, **more: tables.merge(spark, str(root), spark.createDataFrame(rs, schemas.DAILY_ROLE_DEMAND), ("date", "role"), schemas.DAILY_ROLE_DEMAND, **more)
    put([day(1, 1, 1), day(2, 1, 2), day(2, 2, 3), day(3, 1, 4)])
    when = {f: f.stat().st_mtime_ns for f in root.rglob("part-*")}
    put([day(2, 2, 30)])
    after = {f: f.stat().st_mtime_ns for f in root.rglob("part-*")}
    assert {f.parent.name for f in set(when) ^ set(after)} == {"folder=m2024-02"}
    assert all(after[f] == when[f] for f in set(when) & set(after))
    gone = spark.createDataFrame([(date(2024, 3, 1), "A"), (date(2024, 1, 1), "B")], "date date, role string")
    put([], scope=gone)
    got = rows(tables.current(spark, str(root), schemas.DAILY_ROLE_DEMAND), "daily_role_demand")
    assert [(str(r[0]), r[2]) for r in got] == [("2024-01-01", 1), ("2024-02-01", 2), ("2024-02-02", 30)]
    assert not files.matching(spark, f"{root}/v=*/folder=m2024-03") and len(files.matching(spark, f"{root}/v=*")) == 1


def test_a_table_without_folders_is_cut_by_its_first_merge(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.publish(spark.createDataFrame([("a", "b", 5), ("a", "c", 6)], schemas.SKILL_COOCCURRENCE), root)
    new = spark.createDataFrame([("a", "c", 7)], schemas.SKILL_COOCCURRENCE)
    tables.merge(spark, root, new, ("skill_a", "skill_b"), schemas.SKILL_COOCCURRENCE)
    assert rows(tables.current(spark, root, schemas.SKILL_COOCCURRENCE), "skill_cooccurrence") == [("a", "b", 5), ("a", "c", 7)]
    assert files.matching(spark, f"{root}/v=2/folder=b*")


def test_a_run_that_died_between_its_tables_shows_nothing(spark, tmp_path, monkeypatch):
    land(tmp_path / "bronze", "adzuna", DAY, [posting(t, skills_extracted=["sql", "go"]) for t in "ABCDE"])
    root, gold_root, ledger_root = (str(tmp_path / n) for n in ("silver", "gold", "ledger"))
    silver.ingest(spark, bronze.read_bronze(spark, str(tmp_path / "bronze"), ingest_date=DAY), root, "r1", ledger_root)

    def seen():
        jobs, skills = (silver.stored(spark, root, t) for t in ("jobs", "job_skills"))
        per_job = features.with_skills(jobs.selectExpr("raw_hash AS job_id"), skills)
        views = (jobs, skills, silver.stored(spark, root, "board_details"), features.top_skills(skills), per_job, gold.skill_cooccurrence(skills))
        return [sorted(map(str, v.collect())) for v in views]

    before = seen()
    assert [len(v) for v in before] == [5, 10, 5, 2, 5, 1]
    land(tmp_path / "bronze", "adzuna", "2024-03-02", [posting(t, skills_extracted=["sql", "go", "r"]) for t in "CDEFG"])
    write = tables.write_run
    monkeypatch.setattr(tables, "write_run", lambda df, to, *a, **b: write(df, to, *a, **b) if not to.endswith("/jobs") else 1 / 0)
    landed = bronze.read_bronze(spark, str(tmp_path / "bronze"), ingest_date="2024-03-02")
    with pytest.raises(ZeroDivisionError):
        silver.ingest(spark, landed, root, "r2", ledger_root)
    assert seen() == before and spark.read.parquet(f"{root}/job_skills").count() > 10
    monkeypatch.undo()
    assert silver.ingest(spark, landed, root, "r2", ledger_root)["total_inserted"] == 2
    assert [len(v) for v in seen()][:3] == [7, 16, 7]
    assert {(r.run_id, r.status, r.jobs_inserted, r.jobs_total) for r in ledger.runs(spark, ledger_root).collect()} == {("r1", "completed", 5, 5), ("r2", "completed", 2, 7)}


def test_streams_keep_the_ledger(spark, tmp_path):
    root, ledger_root, landed = (str(tmp_path / n) for n in ("silver", "ledger", "bronze"))
    land(tmp_path / "bronze", "adzuna", DAY, [posting("A"), posting("B"), {"title": "no source"}])
    sinks.start_silver(sources.bronze_stream(spark, landed), root, str(tmp_path / "cp"), ledger_root).awaitTermination()
    with pytest.raises(Exception):  # noqa: B017
        sinks.silver_writer(root, ledger_root=ledger_root)(spark.range(1), 7)
    kept = {r.run_id: r for r in ledger.runs(spark, ledger_root).collect()}
    assert {k: (r.status, r.jobs_inserted, r.errors_count) for k, r in kept.items()} == {"stream-000000000000": ("completed", 2, 1), "stream-000000000007": ("failed", 0, 0)}


def test_a_refresh_holds_one_row_a_touched_day_not_one_a_day_around_it(spark, tmp_path, monkeypatch):
    jobs = [(f"j{i}", "r", f"role {i}", None, None, None, None, None, datetime(2024, 1 + i % 12, 5)) for i in range(40)]
    frame, skills = frames(spark, {"r": (jobs, [])})
    held = []

    def counted(df, name, **more):
        out = put(df, name, **more)
        held.append((name, out.count()))
        return out

    put = deltas.staged
    monkeypatch.setattr(deltas, "staged", counted)
    monkeypatch.setattr(tables, "staged", counted)
    root = str(tmp_path / "gold")
    deltas.refresh(spark, frame, skills, root, ["r"], names=("daily_role_demand",))
    assert max(n for _, n in held) <= 2 * len(jobs), held
    monkeypatch.undo()
    assert rows(tables.current(spark, f"{root}/daily_role_demand", schemas.DAILY_ROLE_DEMAND), "daily_role_demand") == rows(gold.daily_role_demand(frame), "daily_role_demand")
