"""File-based runs: landing, Silver, wide, bulk, Gold, ledger."""

import json

import pytest
from pyspark.sql import functions as F

from laborlake.plans import datasets, gold, quality, silver, wide
from laborlake.sources import bronze, ledger, schemas, tables, tabular

DAY = "2024-03-01"


def land(root, source, day, records, name="batch_0001.json", sub=""):
    folder = root / f"source={source}" / f"ingest_date={day}" / sub
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(records if isinstance(records, str) else json.dumps(records))


def posting(title, source="adzuna", **more):
    return {"source": source, "title": title, "company": "Acme", "posted_at": "2024-02-01T08:00:00Z", **more}


@pytest.fixture
def landed(tmp_path):
    root = tmp_path / "bronze"
    land(root, "adzuna", DAY, [
        posting("Data Engineer", external_id="e1", location="Berlin, Germany", salary_min=120000, salary_max=90000.5,
                salary_is_predicted=True, category="IT", category_tag="it-jobs", location_area=["DE", "Berlin"],
                description="Python and SQL. " + "x" * 6000, contract_type=" permanent "),
        posting("  ", external_id="blank"),
        posting("DATA engineer", external_id="copy"),
        posting("SRE", country="gb", remote="yes", salary_min=0, salary_max=-1, skills_extracted=["Go", "go ", ""]),
    ])
    land(root, "adzuna", DAY, [posting("Data Engineer", external_id="again"), posting("Nurse", salary_min="nan")],
         name="batch_0002.json")
    land(root, "remotive", DAY, [
        posting("Writer", "remotive", remote=True, job_type="full_time", salary_raw="$40k", url="http://x/1"),
        posting("Too long", "remotive", skills_extracted=["s" * 101]),
    ])
    land(root, "kaggle", DAY, [
        posting("Analyst", "kaggle", date_posted="ignored", dataset_slug="a/b", dataset_year=2024, company_size="M"),
        {"title": "No source"},
    ], sub="dataset_key=a")
    land(root, "adzuna", "2024-03-02", [posting("Data Engineer"), posting("New one")])
    return str(root)


def build(spark, landed, silver_root, day, run_id):
    stored = tables.read_runs(spark, f"{silver_root}/jobs", schemas.JOBS, "run_id", except_run=run_id)
    batch = silver.build(bronze.read_bronze(spark, landed, ingest_date=day), stored, run_id)
    silver.write(batch, silver_root, run_id)
    return batch.summary


def jobs_of(spark, root):
    return tables.read_runs(spark, f"{root}/jobs", schemas.JOBS, "run_id")


def test_silver_run(spark, landed, tmp_path):
    root = str(tmp_path / "silver")
    summary = build(spark, landed, root, DAY, "r1")
    assert summary == {
        "stage": "bronze_to_silver", "total_raw": 10, "duplicates_removed": 2, "already_in_db": 0,
        "total_inserted": 6, "total_skipped": 0, "total_errors": 1,
        "by_source": {"adzuna": 6, "remotive": 2, "kaggle": 1, "other": 1},
    }
    jobs = {r.title: r for r in jobs_of(spark, root).collect()}
    assert set(jobs) == {"Data Engineer", "SRE", "Nurse", "Writer", "Analyst", "Too long"}
    engineer, sre, nurse = jobs["Data Engineer"], jobs["SRE"], jobs["Nurse"]
    assert engineer.external_id == "e1"  # first by file and place
    assert (engineer.salary_min, engineer.salary_max, engineer.salary_currency) == (120000.0, 120000.0, "EUR")
    assert (engineer.country, engineer.city, engineer.title_normalized) == ("DE", "Berlin", "Data Engineer")
    assert len(engineer.description) == 6016 and engineer.posted_at.isoformat() == "2024-02-01T08:00:00"
    assert (sre.country, sre.remote, sre.salary_missing, sre.skill_missing) == ("GB", True, True, False)
    assert nurse.salary_min is None and nurse.skill_missing and nurse.external_id == nurse.raw_hash[:32]
    skills = spark.read.parquet(f"{root}/job_skills")
    assert {(r.job_id, r.skill_name) for r in skills.collect()} == {
        (engineer.raw_hash, "python"), (engineer.raw_hash, "sql"), (sre.raw_hash, "go"),
    }
    detail = spark.read.parquet(f"{root}/board_details").filter(F.col("job_id") == engineer.raw_hash).head()
    assert (detail.contract_type, detail.salary_is_predicted, detail.category_tag) == ("permanent", True, "it-jobs")
    assert (detail.location_area, detail.country_code) == ("DE, Berlin", None)
    assert spark.read.parquet(f"{root}/remote_details").filter("source_url is not null").head().source_url == "http://x/1"
    bulk = spark.read.parquet(f"{root}/bulk_details").head()
    assert (bulk.dataset_year, bulk.company_size) == (2024, "M")
    errors = {r.error_type for r in spark.read.parquet(f"{root}/rejects").collect()}
    assert errors == {"missing_source"}


def test_silver_rerun_and_next_day(spark, landed, tmp_path):
    root = str(tmp_path / "silver")
    build(spark, landed, root, DAY, "r1")
    before = sorted(jobs_of(spark, root).collect())
    assert build(spark, landed, root, DAY, "r1")["total_inserted"] == 6  # a repeated run replaces itself
    assert sorted(jobs_of(spark, root).collect()) == before
    again = build(spark, landed, root, DAY, "r2")
    assert (again["total_inserted"], again["already_in_db"]) == (0, 6)
    summary = build(spark, landed, root, "2024-03-02", "r3")
    assert (summary["total_inserted"], summary["already_in_db"]) == (1, 1)
    assert jobs_of(spark, root).count() == 7


def test_listing_and_no_input(spark, landed, tmp_path):
    assert bronze.sources_on(spark, landed, DAY) == ["adzuna", "kaggle", "remotive"]
    assert bronze.sources_on(spark, landed, "2024-03-02") == ["adzuna"]
    assert bronze.sources_on(spark, landed, DAY, "remotive") == ["remotive"]
    assert bronze.read_bronze(spark, str(tmp_path / "nothing")).count() == 0


def test_bronze_sink_round_trip(spark, tmp_path):
    root = str(tmp_path / "bronze")
    rows = spark.range(250).select(
        F.lit("kaggle").alias("source"), F.concat(F.lit("t"), "id").alias("title"), F.lit("d").alias("dataset_key"),
        F.array(F.lit("it's"), F.lit("b")).alias("skills_extracted"), F.lit(12.5).alias("salary_min"),
    )
    bronze.write_bronze(rows.coalesce(1), root, DAY, rows_per_file=100)
    files = list((tmp_path / "bronze").rglob("part-*.json"))
    assert len(files) == 3
    back = bronze.read_bronze(spark, root)
    assert back.count() == 250 and back.filter("source is null").count() == 0
    got = silver.canonical(silver.with_hash(silver.clean(back))).head()
    assert got.skills == ["it's", "b"] and got.salary_min == 12.5


CSV = {
    "a.csv": 'job_title,company_name,job_location,job_country,job_work_from_home,job_posted_date,salary_year_avg,job_skills\n'
             'Dev,Acme,"Paris, FR",France,True,2024-01-02,90000,"[\'sql\', \'R\']"\n,Acme,x,y,,,,\n',
    "b.csv": 'title,company,location,remote_ratio,work_year,salary_in_usd,experience_level,employment_type,company_size,employee_residence\n'
             'Analyst,B,"multi\nline",50,2023,"120,000",SE,FT,L,de\nClerk,C,Oslo,0,,1k,,,,\n',
    "c.csv": "Position,Employer,City,min_amount,max_amount,job_type,description\nCook,D,Rome,10k,,Hybrid,cooking\n",
    "d.csv": "id,Run ID,run-id,1st col\n7,a,b,c\n8,d,e,f\n",
}


@pytest.fixture
def bulk(tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    for name, body in CSV.items():
        (folder / name).write_text(body)
    return str(folder)


def test_bulk_load(spark, bulk, tmp_path):
    bronze_root, raw_root = str(tmp_path / "bronze"), str(tmp_path / "raw")
    result = datasets.load_datasets(
        spark, {"us_tech_2024": bulk, "broken": str(tmp_path / "none")},
        bronze_root=bronze_root, raw_root=raw_root, ingest_date=DAY, run_id="r1",
    )
    assert result["loaded"] == [{"dataset_key": "us_tech_2024", "job_files": 3, "raw_only_files": 1}]
    assert [k for k, _ in result["failed"]] == ["broken"]
    rows = {r.title: r for r in bronze.read_bronze(spark, bronze_root).collect()}
    assert set(rows) == {"Dev", "Analyst", "Clerk", "Cook"}
    dev, analyst, clerk, cook = (rows[t] for t in ("Dev", "Analyst", "Clerk", "Cook"))
    assert (dev.salary_min, dev.salary_max, dev.remote, dev.skills_extracted) == ("90000.0", "90000.0", "true", '["sql","r"]')
    assert (dev.dataset_year, dev.work_type, dev.country, dev.dataset_slug) == (
        "2024", "Remote", "France", "christopherkverne/100k-us-tech-jobs-winter-2024",
    )
    assert (analyst.remote, analyst.dataset_year, analyst.location, analyst.salary_min) == ("true", "2023", "multi\nline", "120000.0")
    assert (analyst.experience_level, analyst.employment_type, analyst.company_size) == ("SE", "FT", "L")
    assert (clerk.remote, clerk.dataset_year, clerk.salary_min) == (None, "2024", "1000.0")  # ratio 0 is no number above zero
    assert (cook.salary_min, cook.salary_max, cook.remote, cook.employment_type) == ("10000.0", None, "false", "Hybrid")

    groups = tabular.raw_tables(spark, raw_root)
    raw = {r.raw_table: g.filter(F.col("raw_table") == r.raw_table) for g in groups for r in g.select("raw_table").distinct().collect()}
    assert set(raw) == {f"kaggle_raw_us_tech_2024_{n}" for n in "abcd"}
    odd = raw["kaggle_raw_us_tech_2024_d"]
    assert set(odd.columns) == {"run_id", "ingested_at", "dataset_key", "source_file", "row_number", "raw_table",
                                "src_id", "src_run_id", "src_run_id_3", "col_1st_col"}
    assert [(r.row_number, r.src_id) for r in odd.orderBy("row_number").collect()] == [(1, "7"), (2, "8")]
    assert raw["kaggle_raw_us_tech_2024_a"].count() == 2  # raw keeps untitled rows


def test_a_repeated_load_replaces_itself(spark, bulk, tmp_path):
    bronze_root, raw_root = str(tmp_path / "bronze"), str(tmp_path / "raw")

    def counts(run_id):
        datasets.load_datasets(spark, {"us_tech_2024": bulk}, bronze_root=bronze_root, raw_root=raw_root, ingest_date=DAY, run_id=run_id)
        return bronze.read_bronze(spark, bronze_root).count(), sum(g.count() for g in tabular.raw_tables(spark, raw_root))

    first = counts("r1")
    assert first == (4, 7) and counts("r1") == first
    assert counts("r2") == (8, 14) and counts("r2") == (8, 14) and counts(None) == (12, 21)


def _jobs_of(spark, name, run):
    """What ``run`` gives, and how many Spark jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


HEADERS = ["title,company", '"job\ntitle",pay', "a,A,,title", "id;name"]


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    want = {}
    for i in range(120):
        header = HEADERS[i % len(HEADERS)]
        path = tmp_path / f"f {i:03d}+%41.csv"
        path.write_text(("\n" if i % 8 == 0 else "") + header + "\n" + "1,2,3,4\n" * (i * 50))
        want[f"file:{path}"] = header
    (tmp_path / "empty.csv").write_text("")
    paths = [*want, f"file:{tmp_path}/empty.csv"]
    texts, jobs = _jobs_of(spark, "headers", lambda: tabular.header_texts(spark, paths))
    assert texts == want and jobs <= 2  # one, and Spark's own listing of many paths
    (with_title, raw), jobs = _jobs_of(spark, "routes", lambda: tabular.route_by_header(spark, paths))
    assert jobs <= 3 + len(HEADERS)  # each header once, and the empty file
    for group in (with_title, raw):
        for columns, members in group.items():
            assert all(tuple(tabular.read_csv(spark, p).columns) == columns for p in members[:2])
    assert sorted(p for g in (with_title, raw) for m in g.values() for p in m) == sorted(paths)
    assert sum(map(len, with_title.values())) == 60 and raw[()] == [paths[-1]]
    plain = [p.removeprefix("file:") for p in paths]
    assert {k: len(v) for k, v in tabular.route_by_header(spark, plain)[0].items()} == {k: len(v) for k, v in with_title.items()}


def test_schemas_of_raw_tables_are_read_per_header(spark, tmp_path):
    root = str(tmp_path / "raw")
    for i in range(12):
        (tmp_path / f"t{i}.csv").write_text(("title,pay\n" if i % 2 else "title,place\n") + f"x{i},1\n")
    for odd in (0, 1):
        tabular.land_raw(spark, [f"file:{tmp_path}/t{i}.csv" for i in range(12) if i % 2 == odd], root, "k", "r1" if odd else None)
    groups, jobs = _jobs_of(spark, "schemas", lambda: tabular.raw_tables(spark, root))
    # A schema per header to tell the groups, and one per group that is read.
    assert len(groups) == 2 and jobs <= 4
    assert sorted(len(g.select("raw_table").distinct().collect()) for g in groups) == [6, 6]


def test_row_numbers_follow_the_file_over_many_splits(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("n,pad\n" + "".join(f"{i},{'x' * 40}\n" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = tabular.number_rows(tabular.read_csv(spark, str(path), multi_line=False))
        assert rows.rdd.getNumPartitions() > 1
        assert rows.count() == 5000 and rows.filter("row_number <> cast(n as bigint)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_raw_to_wide(spark, landed, bulk, tmp_path):
    raw_root, wide_root = str(tmp_path / "raw"), str(tmp_path / "wide")
    datasets.normalise_dataset(
        spark, bulk, "us_tech_2024", bronze_root=str(tmp_path / "b2"), raw_root=raw_root, ingest_date=DAY
    )
    land(tmp_path / "bronze", "adzuna", DAY, "{not json", name="batch_0003.json")
    summary = wide.raw_to_wide(spark, raw_root, landed, wide_root, "n1", run_date=DAY)
    # raw: 2 + 2 + 1 + 2 rows; board: 6; remote: 2
    assert (summary["rows_inserted"], summary["run_date_scope"]) == (15, DAY)
    rows = spark.read.parquet(wide_root)
    assert sorted(rows.columns) == sorted(schemas.WIDE.names)
    engineers = rows.filter("lower(title) = 'data engineer'").orderBy("source_file", "raw_row_number").collect()
    # another place is another key: the first stands alone, the other two share one
    assert [(r.raw_row_number, r.is_exact_duplicate) for r in engineers] == [(1, False), (3, False), (1, True)]
    assert engineers[0].quality_score == 100 and engineers[0].quality_flags is None
    assert engineers[1].quality_flags == "missing_location,short_description,missing_salary"
    cook = rows.filter("title = 'Cook'").head()
    assert cook is not None and cook.salary_min is None  # '10k' is no number on this path
    wide.raw_to_wide(spark, raw_root, landed, wide_root, "n2")
    assert spark.read.parquet(wide_root).select("normalization_run_id").distinct().count() == 2
    wide.raw_to_wide(spark, raw_root, landed, wide_root, "n3", truncate=True)
    spark.catalog.refreshByPath(wide_root)
    assert [r[0] for r in spark.read.parquet(wide_root).select("normalization_run_id").distinct().collect()] == ["n3"]


def _jobs(spark, rows):
    names = "job_id string, title_normalized string, country string, salary_currency string, salary_min double, " \
            "salary_max double, remote boolean, posted_at timestamp_ntz"
    from datetime import datetime

    return spark.createDataFrame(
        [(str(i), *r[:6], datetime.fromisoformat(r[6]) if r[6] else None) for i, r in enumerate(rows)], names
    )


def test_salary_summary_rules(spark):
    rows = [("A", "US", "USD", 100.0, 200.0, None, None)] * 3 + [("A", "US", "", 150.0, 150.0, None, None)]
    rows += [("A", "US", "XXX", 1.0, 1.0, None, None), ("A", "US", "USD", 200.0, 100.0, None, None),
             ("A", "US", "USD", None, 100.0, None, None), ("B", None, " eur ", 92.0, 92.0, None, None)]
    rows += [("B", None, "EUR", 92.0, 92.0, None, None), (None, "US", "USD", 1.0, 1.0, None, None)]
    got = {(r.role, r.country): r for r in gold.salary_summary(_jobs(spark, rows)).collect()}
    assert set(got) == {("A", "US")}  # groups of two and one are dropped
    assert (got["A", "US"].sample_size, got["A", "US"].salary_median) == (4, 150.0)
    loose = {(r.role, r.country): r.salary_p90 for r in gold.salary_summary(_jobs(spark, rows), min_sample=1).collect()}
    assert loose[("B", "UNKNOWN")] == 100.0 and ("Other", "US") in loose
    rough = gold.salary_summary(_jobs(spark, rows), approximate=True).collect()
    assert [(r.sample_size, r.salary_median) for r in rough] == [(4, 150.0)]


def test_remote_mix_and_as_of(spark):
    rows = [("A", None, None, None, None, True, "2024-01-01T23:59:59"), ("A", None, None, None, None, False, "2024-01-01"),
            ("A", None, None, None, None, None, "2024-01-01"), ("B", None, None, None, None, None, "2024-01-01"),
            ("A", None, None, None, None, True, "2024-01-02"), ("A", None, None, None, None, True, None)]
    got = {(str(r.date), r.role): (r.remote_count, r.onsite_count, r.unknown_count, r.remote_ratio)
           for r in gold.remote_vs_onsite(_jobs(spark, rows), "2024-01-01").collect()}
    assert got == {("2024-01-01", "A"): (1, 1, 1, 0.5), ("2024-01-01", "B"): (0, 0, 1, None)}
    with pytest.raises(ValueError):
        gold.remote_vs_onsite(_jobs(spark, rows), "01/01/2024")


def test_alerts_from_thirty_days_equal_alerts_from_all(spark):
    rows = [("A", None, None, None, None, None, f"2024-01-{d:02d}") for d in range(1, 20)]
    rows += [("A", None, None, None, None, None, "2024-02-10")] * 9
    rows += [("B", None, None, None, None, None, "2024-02-10")] * 3
    jobs = _jobs(spark, rows)
    skills = jobs.select("job_id", F.lit("sql").alias("skill_name"))
    full = gold.market_alerts(gold.daily_role_demand(jobs), gold.daily_skill_demand(jobs, skills), "2024-02-10")
    short = gold.market_alerts_on(jobs, skills, "2024-02-10")
    want = sorted(tuple(r) for r in full.collect())
    assert sorted(tuple(r) for r in short.collect()) == want
    # nine postings against eight earlier single days inside the 30 days
    assert {(r[1], r[2]) for r in want} == {("role", "A"), ("skill", "sql")}
    assert gold.market_alerts_on(jobs, skills, "2024-02-11").count() == 0


def test_gold_refresh(spark, landed, tmp_path):
    silver_root, gold_root = str(tmp_path / "silver"), str(tmp_path / "gold")
    build(spark, landed, silver_root, DAY, "r1")
    jobs, skills = jobs_of(spark, silver_root), spark.read.parquet(f"{silver_root}/job_skills")
    for _ in range(2):
        gold.refresh(spark, jobs, skills, gold_root, "2024-02-01")
    roles = tables.current(spark, f"{gold_root}/daily_role_demand", schemas.DAILY_ROLE_DEMAND)
    assert {(r.role, r.job_count) for r in roles.collect()} == {("Data Engineer", 1), ("DevOps/Platform", 1), ("Other", 4)}
    tables.drop_old_versions(spark, f"{gold_root}/daily_role_demand", keep=1)
    assert len(list((tmp_path / "gold" / "daily_role_demand").glob("v=*"))) == 1
    checks = quality.gold_checks(
        roles,
        tables.current(spark, f"{gold_root}/daily_skill_demand", schemas.DAILY_SKILL_DEMAND),
        tables.current(spark, f"{gold_root}/salary_summary", schemas.SALARY_SUMMARY),
        tables.current(spark, f"{gold_root}/market_alerts", schemas.MARKET_ALERTS),
    )
    status = {r.name: r.status for r in checks.collect()}
    assert status["gold_salary_summary_populated"] == "warned" and "gold_salary_median_positive" not in status
    assert quality.overall(checks).head().overall == "warned"


def test_upsert_keeps_other_rows_and_small_samples_out(spark, tmp_path):
    root = str(tmp_path)
    row = lambda role, n: (role, "US", n, 1.0, 1.0, 1.0, 1.0)
    first = spark.createDataFrame([row("A", 5), row("B", 4)], schemas.SALARY_SUMMARY)
    second = spark.createDataFrame([row("B", 9), row("C", 2)], schemas.SALARY_SUMMARY)
    for df in (first, second, second):
        tables.upsert_gold(spark, root, "salary_summary", df, schemas.SALARY_SUMMARY)
    got = tables.current(spark, f"{root}/salary_summary", schemas.SALARY_SUMMARY)
    assert {(r.role, r.sample_size) for r in got.collect()} == {("A", 5), ("B", 9)}


def test_unfinished_version_is_not_read(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([("a", "b", 1)], schemas.SKILL_COOCCURRENCE)
    tables.publish(df, root)
    (tmp_path / "t" / "v=2").mkdir()
    assert tables.current(spark, root, schemas.SKILL_COOCCURRENCE).count() == 1
    assert tables.publish(df, root).endswith("v=3")


def test_ledger(spark, tmp_path):
    root = str(tmp_path / "runs")
    ledger.start_run(spark, root, "r1")
    ledger.start_run(spark, root, "r2")
    ledger.finish_run(spark, root, "r1", {"total_inserted": 4, "by_source": {"adzuna": 4}}, jobs_total=9)
    ledger.finish_run(spark, root, "unknown", {}, jobs_total=0)
    got = {r.run_id: r for r in ledger.runs(spark, root).collect()}
    assert set(got) == {"r1", "r2"}
    assert (got["r1"].status, got["r1"].jobs_inserted, got["r1"].jobs_total) == ("completed", 4, 9)
    assert got["r1"].source_counts == {"adzuna": 4} and got["r2"].status == "running"


def test_bronze_checks(spark, landed, tmp_path):
    status = {r.name: (r.status, r.detail) for r in quality.bronze_checks(spark, landed, DAY).collect()}
    assert status["bronze_json_valid"] == ("passed", "10 records loaded, 0 parse errors")
    later = {r.name: r.status for r in quality.bronze_checks(spark, landed, "2024-03-02").collect()}
    assert later["bronze_adzuna_partition"] == "passed" and later["bronze_kaggle_partition"] == "warned"
    land(tmp_path / "bronze", "adzuna", DAY, "{oops", name="batch_0009.json")
    broken = quality.bronze_checks(spark, landed, DAY)
    assert {r.name: r.status for r in broken.collect()}["bronze_json_valid"] == "failed"
    assert quality.overall(broken).head().overall == "failed"
    none = {r.name: r.status for r in quality.bronze_checks(spark, str(tmp_path / "no"), DAY).collect()}
    assert none == {"bronze_sources_exist": "failed", "bronze_json_valid": "passed", "bronze_records_nonzero": "warned"}


def test_silver_checks_on_no_jobs(spark):
    got = quality.silver_checks(spark.createDataFrame([], schemas.JOBS)).collect()
    assert [(r.name, r.status) for r in got] == [("silver_jobs_exist", "failed")]
