from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from laborlake.functions import lexicons as lx
from laborlake.plans import envelopes, features, models, predict, silver, views
from laborlake.sources import fx, schemas


def test_date_ranges():
    today = date(2024, 3, 10)
    assert views.date_range("7d", today) == (date(2024, 3, 4), today)
    assert views.date_range("30d", today) == (date(2024, 2, 10), today)
    assert views.date_range("90d", today)[0] == views.date_range("other", today)[0] == date(2023, 12, 12)
    assert views.date_range("ytd", today)[0] == date(2024, 1, 1)
    assert views.date_range("all", today)[0] == date(2020, 1, 1)
    assert views.ordered(today, date(2024, 1, 1)) == (date(2024, 1, 1), today)


def _demand(spark):
    rows = [(date(2023 + i % 2, 1, 1 + i), f"s{i:02d}", 100 - i, float(i % 3), 1.0) for i in range(14)]
    return spark.createDataFrame(rows, schemas.DAILY_SKILL_DEMAND)


def test_skill_views(spark):
    demand = _demand(spark)
    top = views.trending_skills(demand, date(2020, 1, 1), date(2030, 1, 1), 3).collect()
    assert [(r.skill, r.peak_7d_avg) for r in top] == [("s02", 2.0), ("s05", 2.0), ("s08", 2.0)]
    yearly = views.skills_yearly(demand, "top10")
    assert {r.skill for r in yearly.collect()} == {f"s{i:02d}" for i in range(10)}
    assert views.skills_yearly(demand, "all").count() == 14
    chart = views.yearly_chart(yearly, ["s00", "s01"]).collect()
    assert [tuple(r) for r in chart] == [(2023, 100, 0), (2024, 0, 99)]
    assert views.skill_timeseries(demand, date(2020, 1, 1), date(2030, 1, 1), ["s01"]).count() == 1
    with pytest.raises(ValueError):
        views.trending_skills(demand, date(2020, 1, 1), date(2030, 1, 1), 101)
    with pytest.raises(ValueError):
        views.skills_yearly(demand, "none")


def test_salary_views(spark):
    rows = [("A", "US", 5, 10.0, 1.0, 1.0, 1.0), ("B", "GB", 2, 99.0, 1.0, 1.0, 1.0), ("C", "GB", 7, None, None, None, None)]
    summary = spark.createDataFrame(rows, schemas.SALARY_SUMMARY)
    assert [r.role for r in views.salaries(summary).collect()] == ["C", "A", "B"]
    assert [r.role for r in views.salaries(summary, "b", "gb").collect()] == ["B"]
    assert [r.role for r in views.top_salaries(summary).collect()] == ["B", "A"]
    assert [r.role for r in views.salary_explorer(summary).collect()] == ["A", "C"]
    totals = views.salary_totals(summary).head()
    assert (totals.group_count, totals.top_role, totals.total_sample, totals.market_count) == (2, "A", 12, 2)


def test_overview_on_empty_tables(spark):
    jobs = spark.createDataFrame([], "posted_at timestamp_ntz")
    empty = [spark.createDataFrame([], s) for s in (
        schemas.DAILY_ROLE_DEMAND, schemas.DAILY_SKILL_DEMAND, schemas.SALARY_SUMMARY,
        schemas.SKILL_COOCCURRENCE, schemas.MARKET_ALERTS, schemas.REMOTE_VS_ONSITE)]
    row = views.overview_metrics(jobs, *empty, date(2024, 1, 1), date(2020, 1, 1)).head()
    assert (row.jobs_total, row.distinct_roles, row.total_remote, row.remote_pct, row.demand_min) == (0, 0, 0, None, None)


def test_board_envelope(spark):
    record = {"id": "7", "title": "Dev", "created": "2024-01-01", "salary_min": 10.0, "salary_is_predicted": "1",
              "location": {"display_name": "Remote, UK", "area": ["UK"]}, "category": {"label": "IT", "tag": "it"}}
    row = envelopes.board_envelope(spark.createDataFrame([record], schemas.BOARD_RECORD), F.lit("gb")).head()
    assert (row.source, row.company, row.country, row.salary_is_predicted, row.remote) == ("adzuna", "", "GB", True, True)
    assert (row.location_area, row.category_tag, row.salary_max) == (["UK"], "it", None)


def test_keep_tech(spark):
    records = spark.createDataFrame([("Sales",), ("Software Dev",), (None,)], "category string")
    assert [r.category for r in envelopes.keep_tech(records).collect()] == ["Software Dev"]
    assert [r.category for r in envelopes.keep_tech(records, ["sales"]).collect()] == ["Sales"]
    sales = records.filter("category = 'Sales'")
    assert envelopes.keep_tech(sales).count() == 1 and envelopes.keep_tech(sales, when_none_match="drop").count() == 0


def test_fx(spark):
    good = {r.currency: r.rate for r in fx.fx_table(spark, {"eur": "0.9", "bad": "x", "zero": 0, "neg": -1}).collect()}
    assert good == {"EUR": 0.9}
    assert [tuple(r) for r in fx.fx_table(spark, {}).collect()] == [("USD", 1.0)]
    assert fx.fx_table(spark).count() == len(lx.DEFAULT_FX)
    loaded = spark.createDataFrame([("eur", "0.9"), ("x", "no"), ("z", "0"), ("n", "NaN")], "currency string, rate string")
    assert [tuple(r) for r in fx.clean_fx(loaded).collect()] == [("EUR", 0.9)]


def test_relabel_currency(spark):
    rows = [("adzuna", "DE", "USD", 1.0, 2.0), ("adzuna", "US", "EUR", 1.0, 2.0), ("kaggle", "DE", "USD", None, 2.0)]
    df = spark.createDataFrame(rows, "source string, country string, salary_currency string, salary_min double, salary_max double")
    got = [(r.salary_currency, r.salary_min_original, r.salary_max_original) for r in silver.relabel_currency(df).collect()]
    assert got == [("EUR", 1.0, 2.0), ("EUR", 1.0, 2.0), ("USD", None, None)]


def _training(spark, n=150):
    jobs = spark.range(n).select(
        F.col("id").cast("string").alias("job_id"),
        F.when(F.col("id") % 3 != 0, F.lit("Data Engineer")).alias("title_normalized"),
        F.lit("US").alias("country"), F.lit("x").alias("source"), F.lit("USD").alias("salary_currency"),
        F.when(F.col("id") % 2 == 0, True).alias("remote"),
        (F.col("id") * 100 + 20000.0).alias("salary_min"), (F.col("id") * 100 + 30000.0).alias("salary_max"),
    )
    skills = jobs.filter("cast(job_id as int) % 5 <> 0").select("job_id", F.explode(F.array(F.lit("sql"), F.lit("power bi"))).alias("skill_name"))
    return jobs, skills


def test_features_and_models(spark, tmp_path):
    jobs, skills = _training(spark)
    rows, names = features.feature_table(jobs, skills, top_n_skills=1)
    assert names == ["power bi"] and "skill_power_bi" in rows.columns
    assert rows.filter("skill_count = 0 and skill_power_bi = 0.0").count() == 30
    train, test = models.split_rows(rows, "job_id")
    assert train.count() + test.count() == 150 and 10 < test.count() < 50
    assert {r.job_id for r in models.split_rows(rows.repartition(7), "job_id")[1].collect()} == {r.job_id for r in test.collect()}
    for kind in models.MODEL_TYPES:
        model, metrics = models.train(rows, names, kind, trees=3)
        assert metrics["status"] == "trained" and metrics["train_size"] + metrics["test_size"] == 150
    root = str(tmp_path)
    first = models.save_model(spark, model, root, metrics, names)
    last = models.save_model(spark, model, root, metrics, names, run_id="last")
    assert {r.run_id for r in models.saved_models(spark, root).collect()} == {first, last}
    loaded = models.load_model(spark, root)
    assert loaded.transform(test).count() == test.count()
    assert models.load_model(spark, root, "unknown") is None
    assert models.load_model(spark, str(tmp_path / "none")) is None
    few, few_names = features.feature_table(*_training(spark, 20), top_n_skills=1)
    assert models.train(few, few_names)[1]["status"] == "skipped"
    with pytest.raises(ValueError):
        models.regressor("other")


def test_prediction(spark):
    from pyspark.ml import Pipeline

    requests = spark.createDataFrame(
        [(1, 99.0, "Data Scientist ", "Automotive", "Remote", ["python", "x"]), (2, None, None, None, None, None)],
        "id int, years_of_experience double, job_title string, industry string, remote_status string, selected_skills array<string>",
    )
    row, blank = predict.feature_columns(requests).orderBy("id").collect()
    assert len(predict.FEATURES) == len(set(predict.FEATURES))
    on = {n for n in predict.FEATURES if row[n] != 0}
    assert on == {predict.YEARS, predict.REMOTE, "ui_title_data scientist", "ui_industry_Other", "skill_python"}
    assert row[predict.YEARS] == 30.0
    assert {n for n in predict.FEATURES if blank[n] != 0} == {"ui_title_other", "ui_industry_Other"}
    problems = {r.id: r.problems for r in predict.form_checks(requests).collect()}
    assert problems[1] == ["years_of_experience", "job_title", "selected_skills"] and len(problems[2]) == 5
    labelled = predict.feature_vector(requests).withColumn(features.LABEL, F.col("id") * 1000.0)
    model = Pipeline(stages=[models.regressor("random_forest", 2)]).fit(labelled)
    scored = predict.predict(model, requests).collect()
    for r in scored:
        assert r.salary_min == pytest.approx(r.prediction * 0.88, abs=0.01)
        assert r.salary_max == pytest.approx(r.prediction * 1.12, abs=0.01)


def test_free_text(spark):
    texts = spark.createDataFrame([(1, " Data Analyst", [" SQL", ""], True), (2, "Wizard", None, None)],
                                  "id int, title string, skills array<string>, remote boolean")
    one, two = predict.from_free_text(texts).orderBy("id").collect()
    assert (one.job_title, one.selected_skills, one.remote_status) == ("data analyst", ["sql"], "Remote")
    assert (two.job_title, two.selected_skills, two.remote_status, two.industry) == ("other", [], "On-site", "Tech")


def test_ranked_chart_finds_its_columns(spark):
    rows = [(2020, "b", 5), (2021, "b", 1), (2020, "a", 6), (2021, "c", 9), (2022, "d", 1)]
    yearly = spark.createDataFrame(rows, "year int, skill string, total_jobs long")
    assert [tuple(r) for r in views.chart_ranking(yearly, 3).collect()] == [(1, "c", 9), (2, "a", 6), (3, "b", 6)]
    assert [tuple(r) for r in views.ranked_chart(yearly, 3).collect()] == [(2020, 11, 0, 6, 5), (2021, 10, 9, 0, 1), (2022, 1, 0, 0, 0)]
    assert [tuple(r) for r in views.ranked_chart(yearly.limit(0), 2).collect()] == []
