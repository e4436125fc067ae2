from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laborlake.functions import infer, parse, text


def test_money(apply):
    got = apply(parse.money, ["120,000", " $5 ", "-1", "0", "nan", "5d", "1e5", ".5", "", None, "\t7\n", "inf"])
    assert got == [120000.0, 5.0, None, None, None, None, 100000.0, 0.5, None, None, 7.0, None]


def test_money_k(apply):
    got = apply(parse.money_k, ["120k", "1.5K", "-2k", "0k", "-3", "$ 40k", "k", None])
    assert got == [120000.0, 1500.0, -2000.0, 0.0, None, 40000.0, None, None]


@pytest.mark.parametrize(
    "value, low, high",
    [
        ("$40,000 - $50,000", 40000.0, 50000.0),
        ("$120k - $150k", 120000.0, 150000.0),
        ("€60,000", 60000.0, 60000.0),
        ("80000", 80000.0, 80000.0),
        ("", None, None),
        (None, None, None),
        ("35 per hour", None, None),
        ("120k 150k", 120000150000.0, 120000150000.0),
    ],
)
def test_salary_range(apply, value, low, high):
    assert apply(parse.salary_range, [value]) == [(low, high)]


def test_timestamp(apply):
    got = apply(
        parse.timestamp,
        [
            "2024-01-15T10:20:30+05:30", "2024-01-15T10:20:30Z", "2024-1-5", "5/1/2024", "2024-02-30",
            "2024-01-15 10:20:30.55", " 2024-01-01", "junk", "2024-01-01 10:00", "",
        ],
    )
    at = datetime(2024, 1, 15, 10, 20, 30)
    assert got == [datetime(2024, 1, 15, 4, 50, 30), at, datetime(2024, 1, 5), datetime(2024, 1, 5), None, at, None, None, None, None]
    assert apply(lambda c: parse.timestamp(c, strip_first=True), [" 2024-01-01 "]) == [datetime(2024, 1, 1)]


def test_timestamp_is_zone_free(spark, apply):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert apply(parse.timestamp, ["2024-03-10 02:30:00"]) == [datetime(2024, 3, 10, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_booleans(apply):
    assert apply(parse.boolean_wide, ["Yes", " t ", "n", "0", "maybe", None]) == [True, True, False, False, None, None]
    assert apply(parse.boolean_bulk, ["yes", "y", "n", "f", "1"]) == [True, None, None, False, True]


def test_lists(apply):
    assert apply(parse.skill_list, ["['a', 'B ']", '["it\'s"]', "[a, b]", "a,,b", "", "[", None]) == [
        ["a", "b"], ["it's"], ["a", "b"], ["a", "b"], [], [], [],
    ]
    assert apply(parse.bulk_skills, ["['a', 'B']", "x, Y", "solo", None]) == [["a", "b"], ["x", "y"], ["solo"], []]


def test_skills(apply):
    got = apply(infer.skills, ["Python & SQL; c++ dev", "c++11", "éR", "Power BI, mongodb", None])
    assert got == [["python", "sql"], ["c++"], [], ["mongodb", "power bi"], []]
    assert apply(lambda c: infer.skills(c, symbols_as_words=True), ["c++ dev"]) == [["c++"]]
    overlapping = ("data", "data lake", "lake house")
    assert apply(lambda c: infer.skills(c, overlapping), ["a data lake house"]) == [list(overlapping)]


def test_skill_choice(spark):
    df = spark.createDataFrame(
        [(["SQL", "sql ", ""], "python"), ([], "python"), (None, "python")], "g array<string>, d string"
    )
    got = [r[0] for r in df.select(infer.skill_choice(F.col("g"), F.col("d"))).collect()]
    assert got == [["sql"], ["python"], ["python"]]


def test_country_names(apply):
    names = ["GERMANY", "united states of America", "U.S.A.", "Atlantis", "DE", "", None]
    assert apply(infer.country_code, names) == ["DE", "US", "US", None, None, None, None]
    chosen = apply(lambda c: infer.country_choice(c, F.lit(None).cast("string"), names=True), names)
    assert chosen == ["DE", "US", "US", "ATLANTIS", "DE", None, None]


def test_country_and_city(apply):
    places = ["London, UK", "Milwaukee", "Sydney, Australia", "Oslo", None]
    assert apply(infer.country, places) == ["GB", "GB", "AU", None, None]
    assert apply(infer.country_wide, places) == ["GB", "GB", "US", None, None]
    assert apply(lambda c: infer.country(c, whole_words=True), places) == ["GB", None, "AU", None, None]
    assert apply(infer.city, [" Paris , FR", ", x", ""]) == ["Paris", None, None]
    assert apply(infer.currency_of, [None, "DE", "XX"]) == ["USD", "EUR", "USD"]


def test_remote_order(apply):
    assert apply(infer.remote_by_words, ["remote, on-site", "onsite", "x"]) == [True, False, None]
    assert apply(lambda c: infer.remote_by_patterns(c, c, c), ["no remote", "telework", "x"]) == [False, True, None]
    assert apply(infer.remote_by_job_type, ["Hybrid remote", "hybrid", "", None]) == [True, False, None, None]


def test_first_rule_wins(apply):
    both = lambda c: infer.canonical_title(c, F.lit(None).cast("string"))
    assert apply(both, ["Machine Learning Data Engineer", "Front-end React", "Nurse"]) == [
        "Data Engineer", "Frontend Engineer", None,
    ]
    assert apply(infer.role_family, ["ETL developer", "NLP lead"]) == ["Data Engineer", "AI Engineer"]


def test_hash_keeps_places_of_missing_parts(spark):
    df = spark.createDataFrame([("t", None, "x", "s"), ("t", "x", None, "s")], "a string, b string, c string, d string")
    hashes = [r[0] for r in df.select(text.posting_hash(*[F.col(c) for c in "abcd"])).collect()]
    assert hashes[0] != hashes[1]


def test_names():
    assert text.identifier(" Run-ID #2 ", prefix="col") == "run_id_2"
    assert text.identifier("1st col", prefix="col") == "col_1st_col"
    assert text.identifier("--", prefix="col") == "col"
    assert text.raw_table_name("Set A", "jobs.2024.csv") == "kaggle_raw_set_a_jobs_2024"
    long = text.raw_table_name("k" * 40, "f" * 40 + ".csv")
    assert len(long) == 63 and long.startswith("kaggle_raw_kkkk")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=25), min_size=1, max_size=30))
def test_parsers_never_raise(apply, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    for function in (parse.money, parse.money_k, parse.timestamp, parse.integer, parse.salary_range,
                     parse.skill_list, parse.bulk_skills, parse.boolean_wide):
        assert len(apply(function, values)) == len(values)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" \t\n 　ab", max_size=12), min_size=1, max_size=30))
def test_strip_matches_python(apply, values):
    assert apply(parse.strip, values) == [v.strip() for v in values]


def test_timestamp_takes_offsets_off(apply):
    given = ["2024-03-01T23:00:00-08:00", "2024-03-01 01:30:00.25 +0530", "2024-03-01T23:00:00Z", "2024-03-01"]
    want = [datetime(2024, 3, 2, 7), datetime(2024, 2, 29, 20), datetime(2024, 3, 1, 23), datetime(2024, 3, 1)]
    assert apply(parse.timestamp, given) == want


def test_short_offsets_and_times_without_seconds(apply):
    got = {
        "2024-03-01T23:00:00-08": "2024-03-02T07:00:00",
        "2024-03-01T23:00-08:00": None,
        "2024-03-01 23:00:59.25 +0530": "2024-03-01T17:30:59",
        "2024-03-01T23:00": None,
        "2024-03-01T23:00Z": None,
        "2024-03-01-08": None,
        "2024-03-01T23-08": None,
    }
    out = apply(parse.timestamp, list(got))
    assert [o and o.isoformat() for o in out] == list(got.values())


def test_texts_keep_their_length(spark):
    from laborlake.plans import silver

    long = "x" * 2000
    names = ("title", "company", "location", "external_id", "category", "job_type", "company_size", "country")
    from laborlake.sources import schemas

    row = {f.name: None for f in schemas.BRONZE} | dict.fromkeys(names, long) | {"source": "kaggle"}
    bronze = spark.createDataFrame([tuple(row.values())], schemas.BRONZE)
    r = silver.canonical(silver.with_hash(silver.clean(bronze))).first()
    kept = [r.title, r.company_name, r.location, r.external_id, r.d_category, r.d_job_type, r.d_company_size, r.d_country_code, r.city]
    assert {len(v) for v in kept} == {2000}
