"""Silver, wide, bulk and envelope builds, deduplication and quality suites on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import proxies as px, sqltext as sq
from laborlake.functions import lexicons as lx, text
from laborlake.operators.dedup import first_per_key, not_yet_stored
from laborlake.plans import datasets, envelopes, gold, quality, silver, wide
from laborlake.sources import schemas, tabular
from laborlake.sources.fx import clean_fx

# Documents as landed postings: every column the builds read, from text, language, source and size.

LANG_PLACE = {"de": "Berlin, Germany", "fr": " Paris ", "en": "London, UK"}
CATEGORY = ["Data Science", "DevOps / Sysadmin", "", None, "Sales"]
HINT = ["", None, "Editor"]
REMOTE = ["true", "false", None, "yes", "?"]
SKILL_TEXT = [None, "[]", '["Python", "sql ", "SQL"]', "['a', 'b']", '["Team Work", ""]', None]
COUNTRY = ["", None, "us", "Germany", None, None]

def _case(values: list, index: str) -> str:
    return px.choice_sql(index, values)


_SOURCE_NO = "cast(substring(source, 4) as int)"
_PLACE = "case lang " + " ".join(f"when '{k}' then '{v}'" for k, v in LANG_PLACE.items()) + " end"
_DAY = "(date '2024-01-01' + cast(n_chars % 400 as int))"
_TITLE = "split_part(text, '.', 1)"


def _date_text(call: str, formats: list[str]) -> str:
    t = [f"{call}({_DAY}, {sq.quote(f)})" for f in formats]
    return (
        f"case n_chars % 5 when 0 then concat({t[0]}, 'T08:30:00Z') when 1 then {t[0]} "
        f"when 2 then {t[1]} when 3 then '' end"
    )


_LANDED = {
    "doc_id": "doc_id",
    "source": f"case when {_SOURCE_NO} = 19 then null else " + _case(
        [lx.SOURCE_BOARD, lx.SOURCE_REMOTE, lx.SOURCE_BULK], f"{_SOURCE_NO} % 3"
    ) + " end",
    "external_id": _case(["", None, "x-1"], "n_chars % 3"),
    "title": _TITLE,
    "title_normalized_hint": _case(HINT, "n_chars % 3"),
    "company": "source",
    "location": _PLACE,
    "country": _case(COUNTRY, "n_chars % 6"),
    "description": "text",
    "salary_min": "case n_chars % 4 when 0 then concat('$', {chars}, ',000') when 1 then {chars} when 2 then '-5' end",
    "salary_max": "case n_chars % 3 when 0 then {chars} when 1 then concat({chars}, '0') end",
    "remote": _case(REMOTE, "n_chars % 5"),
    "skills_extracted": _case(SKILL_TEXT, "n_chars % 6"),
    "posted_at": "{dates}",
    "first_seen": "case when n_chars % 2 = 0 then '2024-03-05' end",
    "category": _case(CATEGORY, "n_chars % 5"),
    "contract_type": _case(["permanent", " contract ", None], "n_chars % 3"),
    "job_type": _case(["full_time", "", None, "Remote"], "n_chars % 4"),
    "salary_raw": "case when n_chars % 2 = 0 then '$40k' end",
    "url": "concat('https://example.org/', {chars})",
    "work_type": _case(["Remote", None], "n_chars % 2"),
    "dataset_year": _case(["2024", "x", None, " 2025 "], "n_chars % 4"),
}
_ABSENT = [f.name for f in schemas.BRONZE if f.name not in _LANDED]


def _landed_expr(name: str, kind: str) -> str:
    chars = f"cast(n_chars as {'string' if kind == 'spark' else 'varchar'})"
    dates = (
        _date_text("date_format", ["yyyy-MM-dd", "dd/MM/yyyy"])
        if kind == "spark"
        else _date_text("strftime", ["%Y-%m-%d", "%d/%m/%Y"])
    )
    return _LANDED[name].replace("{chars}", chars).replace("{dates}", dates)


def landed(spark, d) -> DataFrame:
    docs = px.table(spark, d, "documents")
    made = docs.select(*[F.expr(_landed_expr(n, "spark")).alias(n) for n in _LANDED])
    return made.select(
        "*",
        *[F.lit(None).cast("string").alias(n) for n in _ABSENT],
        F.lit("documents").alias("_file"),
        F.col("doc_id").alias("_seq"),
    )


LANDED = "select " + ", ".join(f"{_landed_expr(n, 'sql')} as {n}" for n in _LANDED) + " from documents"

_CLEANED = f"""select * exclude (low, high), low as salary_min,
  case when high < low then low else high end as salary_max
from (select doc_id, source, external_id, coalesce({sq.strip("title")}, '') as title, title_normalized_hint,
    coalesce({sq.strip("company")}, '') as company, coalesce({sq.strip("location")}, '') as location, country,
    coalesce({sq.strip("description")}, '') as description,
    {sq.money("salary_min")} as low, {sq.money("salary_max")} as high,
    {sq.boolean("remote", lx.TRUE_WIDE, lx.FALSE_WIDE)} as remote, skills_extracted,
    coalesce(posted_at, first_seen) as posted_at, category, contract_type, job_type, salary_raw, url,
    work_type, dataset_year
  from ({LANDED})) where length(title) > 0"""
_HASHED = f"select *, {sq.hash_key('title', 'company', 'posted_at', 'source')} as raw_hash from ({_CLEANED})"
_FIRST = f"""select * exclude (nth) from (select *, row_number() over (partition by raw_hash order by doc_id) as nth
  from ({_HASHED})) where nth = 1"""


def _list_sql(x: str) -> str:
    """The provider lists above, spelled out as their parsed form."""
    parsed = {
        "[]": "[]", SKILL_TEXT[2]: "['python', 'sql']", SKILL_TEXT[3]: "['a', 'b']", SKILL_TEXT[4]: "['team work']",
    }
    arms = " ".join(f"when {sq.quote(k)} then {v}::varchar[]" for k, v in parsed.items())
    return f"(case {x} {arms} end)"


_COUNTRY_SQL = f"upper(coalesce(nullif(country, ''), {sq.rules('location', lx.COUNTRY_HINTS)}))"
_CANONICAL = f"""with f as ({_FIRST}), g as (select *, {_COUNTRY_SQL} as place, {_list_sql("skills_extracted")} as given from f),
h as (select *, case when len(given) > 0 then given else {sq.skills("description")} end as skills from g)
select raw_hash, source, coalesce({sq.clean("external_id")}, left(raw_hash, 32)) as external_id,
  title,
  coalesce(nullif(title_normalized_hint, ''),
    {sq.rules("concat_ws(' ', title, coalesce(category, ''))", lx.TITLE_RULES)}) as title_normalized,
  company as company_name, location, place as country,
  {sq.city("location")} as city,
  coalesce(remote, {sq.remote_words("concat_ws(' ', title, location, description)")}) as remote,
  salary_min, salary_max, {sq.currency("place")} as salary_currency,
  salary_min is null and salary_max is null as salary_missing, len(skills) = 0 as skill_missing,
  description, {sq.timestamp("posted_at")} as posted_at, skills, contract_type, category, country as given_country,
  job_type, salary_raw, url, work_type, dataset_year
from h"""
_STORED = f"select * from ({_CANONICAL}) where source is not null"


NATIONS = ["Germany", "United States", "U.K.", "south  africa", "Atlantis", "", None, "NL", "The Netherlands", "fr"]
_CODES = {"Germany": "DE", "United States": "US", "U.K.": "GB", "south  africa": "ZA", "The Netherlands": "NL"}


def _country_codes(spark, d) -> DataFrame:
    """Postings of every customer of a nation, by code and currency, where countries come by name."""
    customers = px.table(spark, d, "customer")
    landed_ = customers.select(
        F.lit("kaggle").alias("source"), F.col("c_name").alias("title"), F.col("c_custkey").cast("string").alias("external_id"),
        px.choice(F.col("c_nationkey") % len(NATIONS), NATIONS).alias("country"),
    )
    bare = spark.createDataFrame([], schemas.BRONZE)
    rows = bare.unionByName(landed_, allowMissingColumns=True)
    jobs = silver.canonical(silver.with_hash(silver.clean(rows)), country_names=True)
    return jobs.groupBy("country", "salary_currency").agg(F.count("*").alias("n"))


_NAMED = px.choice_sql(f"c_nationkey % {len(NATIONS)}", NATIONS)
_COUNTRY_CODES = f"""select country, {sq.currency("country")} as salary_currency, count(*) as n from (
  select case {" ".join(f"when name = {sq.quote(k)} then {sq.quote(v)}" for k, v in _CODES.items())}
    else upper(nullif(name, '')) end as country from (select {_NAMED} as name from customer)) group by 1, 2"""


def _canonical(spark, d) -> DataFrame:
    return silver.canonical(silver.dedup_batch(silver.with_hash(silver.clean(landed(spark, d)))))


def _batch(spark, d) -> silver.SilverBatch:
    return silver.split(_canonical(spark, d), "run-1")


def _jobs(spark, d):
    return _batch(spark, d).jobs


_JOBS = (
    "select raw_hash, source, external_id, 'run-1' as run_id, title, title_normalized, company_name, location, "
    "country, city, remote, salary_min, salary_max, salary_currency, salary_missing, skill_missing, description, "
    f"posted_at from ({_STORED})"
)

# Deduplication.


def _dedup(spark, d):
    return silver.dedup_batch(silver.with_hash(silver.clean(landed(spark, d)))).select("raw_hash", "doc_id")


def _copies(spark, d):
    """First document of each text and language."""
    docs = px.table(spark, d, "documents").withColumn("key", text.parts_hash(F.col("text"), F.col("lang")))
    return first_per_key(docs, ["key"], [F.col("doc_id")]).select("key", "doc_id", "source")


_TEXT_KEY = f"sha256(concat_ws('|', nullif(lower({sq.strip('text')}), ''), lower({sq.strip('lang')})))"
_COPIES = f"""select key, doc_id, source from (select {_TEXT_KEY} as key, doc_id, source,
  row_number() over (partition by {_TEXT_KEY} order by doc_id) as nth from documents) where nth = 1"""


def _cross_run(spark, d):
    """Distinct documents whose text is not among the labelled (stored) ones."""
    stored = px.table(spark, d, "documents").join(px.table(spark, d, "labels"), "doc_id", "left_semi")
    stored = stored.select(text.parts_hash(F.col("text"), F.col("lang")).alias("key"))
    copies = _copies(spark, d)
    return not_yet_stored(copies, stored, "key")


# Wide table: documents as a raw bulk table, and as landed records of two sources.


def _raw_table(spark, d) -> DataFrame:
    docs = px.table(spark, d, "documents")
    return docs.select(
        F.lit("kaggle_raw_docs").alias("raw_table"),
        F.lit("run-0").alias("run_id"),
        F.lit(None).cast("timestamp").alias("ingested_at"),
        F.lit("docs").alias("dataset_key"),
        F.lit("docs.csv").alias("source_file"),
        (F.col("doc_id") + 1).alias("row_number"),
        F.expr(_TITLE).alias("job_title"),
        F.col("source").alias("company"),
        F.expr(_PLACE).alias("job_location"),
        F.col("text").alias("description"),
        F.expr(_landed_expr("posted_at", "spark")).alias("date_posted"),
        F.expr(_landed_expr("salary_min", "spark")).alias("salary_min"),
        F.col("n_chars").cast("string").alias("salary"),
        F.expr(_landed_expr("remote", "spark")).alias("remote"),
        F.expr(_landed_expr("job_type", "spark")).alias("job_type"),
        F.lit(None).cast("string").alias("currency"),
    )


def _landed_for_wide(spark, d, source: str) -> DataFrame:
    return (
        landed(spark, d)
        .filter(F.col("source") == source)
        .withColumn("_name", F.lit("batch_0001.json"))
        .withColumn("_path", F.lit(f"/{source}/batch_0001.json"))
        .withColumn("_row", F.col("doc_id") + 1)
    )


def _wide(spark, d):
    union = wide.union_sources(
        [_raw_table(spark, d)],
        {s: _landed_for_wide(spark, d, s) for s in (lx.SOURCE_BOARD, lx.SOURCE_REMOTE)},
    )
    return wide.flag_duplicates(wide.wide_rows(union, "norm-1")).select(*schemas.WIDE.names)


def _wide_sql() -> str:
    c = {
        "title": sq.clean(_TITLE), "company_name": sq.clean("source"), "location_raw": sq.clean(_PLACE),
        "description": sq.clean("text"), "posted_at_raw": sq.clean(_landed_expr("posted_at", "sql")),
        "remote_flag": sq.boolean(_landed_expr("remote", "sql"), lx.TRUE_WIDE, lx.FALSE_WIDE),
    }
    low = f"coalesce({sq.money(_landed_expr('salary_min', 'sql'))}, {sq.money('cast(n_chars as varchar)')})"
    raw = f"""select 'kaggle' as source, 'docs' as dataset_key, 'docs.csv' as source_file, null as source_record_id,
      'kaggle_raw_docs' as raw_table, doc_id + 1 as raw_row_number, 'run-0' as run_id,
      {c["title"]} as title, {c["company_name"]} as company_name, {c["location_raw"]} as location_raw,
      null as country, {c["remote_flag"]} as remote_flag, {c["posted_at_raw"]} as posted_at_raw,
      {low} as salary_min, {low} as salary_max, 'USD' as salary_currency,
      {sq.clean(_landed_expr("job_type", "sql"))} as employment_type, {c["description"]} as description,
      null as skills_text, 1 as rank from documents"""
    joined = {
        "[]": "''", SKILL_TEXT[2]: "'Python, sql , SQL'", SKILL_TEXT[4]: "'Team Work, '",
    }
    arms = " ".join(f"when {sq.quote(k)} then {v}" for k, v in joined.items())
    api = f"""select source, null as dataset_key, 'batch_0001.json' as source_file,
      {sq.clean("coalesce(nullif(external_id, ''), nullif(url, ''))")} as source_record_id,
      concat('bronze_', source) as raw_table, doc_id + 1 as raw_row_number, null as run_id,
      {sq.clean("title")} as title, {sq.clean("company")} as company_name, {sq.clean("location")} as location_raw,
      {sq.clean("country")} as country, {sq.boolean("remote", lx.TRUE_WIDE, lx.FALSE_WIDE)} as remote_flag,
      {sq.clean("posted_at")} as posted_at_raw, {sq.money("salary_min")} as salary_min,
      {sq.money("salary_max")} as salary_max, 'USD' as salary_currency,
      {sq.clean("coalesce(nullif(job_type, ''), nullif(contract_type, ''))")} as employment_type,
      {sq.clean("description")} as description,
      case when skills_extracted = {sq.quote(SKILL_TEXT[3])} then 'a, b' else
        case skills_extracted {arms} end end as skills_text,
      case source when 'adzuna' then 2 else 3 end as rank
    from ({LANDED}) where source in ('adzuna', 'remotive')"""
    flags = (
        ("title is not null", 35, "missing_title"), ("company_name is not null", 15, "missing_company"),
        ("location_raw is not null", 15, "missing_location"), ("posted_at is not null", 10, "missing_posted_at"),
        ("coalesce(length(description) >= 80, false)", 15, "short_description"),
        ("salary_min is not null or salary_max is not null", 10, "missing_salary"),
    )
    score = " + ".join(f"case when {ok} then {n} else 0 end" for ok, n, _ in flags)
    lacks = ", ".join(f"case when not ({ok}) then '{name}' end" for ok, _, name in flags)
    parts = ", ".join(f"lower(coalesce({p}, ''))" for p in ("title", "company_name", "location_raw"))
    names = ", ".join(n for n in schemas.WIDE.names if n not in ("is_exact_duplicate", "normalization_run_id"))
    return f"""with u as ({raw} union all {api}),
    p as (select *, {sq.timestamp("posted_at_raw", True)} as posted_at from u),
    w as (select * exclude (country), coalesce(country, {sq.rules("location_raw", lx.COUNTRY_HINTS_WIDE)}) as country,
      title as title_norm, {sq.city("location_raw")} as city,
      {sq.rules("title", lx.ROLE_RULES)} as role_family, cast({score} as integer) as quality_score,
      nullif(concat_ws(',', {lacks}), '') as quality_flags,
      concat({parts.replace("), lower", "), '|', lower")}, '|', coalesce(strftime(posted_at, '%Y-%m-%d'), '')) as dedup_key from p)
    select 'norm-1' as normalization_run_id, {names}, row_number() over
      (partition by dedup_key order by quality_score desc, rank, raw_row_number) > 1 as is_exact_duplicate from w"""


_WIDE_SQL = _wide_sql()


def _wide_summary(spark, d):
    return _wide(spark, d).groupBy("source").agg(
        F.count("*").alias("row_count"), wide.duplicates_flagged().alias("duplicates_flagged"),
        F.avg("quality_score").alias("mean_score"),
    )


def _row_numbers(spark, d):
    """Row numbers of a table's file in file order, with its columns as text."""
    rows = tabular.raw_rows(px.table(spark, d, "documents"), "docs", "run-0")
    return rows.select("run_id", "dataset_key", "source_file", "row_number", "doc_id", "lang", "n_chars")


# Bulk CSV rows made of documents.


def _bulk(spark, d):
    docs = px.table(spark, d, "documents")
    rows = docs.select(
        F.expr(_TITLE).alias("Position"),
        F.col("source").alias("Employer"),
        F.expr(_PLACE).alias("City"),
        F.col("lang").alias("employee_residence"),
        F.expr(_landed_expr("salary_min", "spark")).alias("min_amount"),
        F.concat(F.col("n_chars").cast("string"), F.lit("k")).alias("salary_in_usd"),
        F.expr(_case(["100", "50", "0", "", None], "n_chars % 5")).alias("remote_ratio"),
        F.expr(_case(["Remote", "Hybrid", "x", ""], "n_chars % 4")).alias("job_type"),
        F.expr(_case(["a, B", "['x', 'Y']", "solo", None], "n_chars % 4")).alias("job_skills"),
        F.expr(_case(["2023", "", "2022.0", None], "n_chars % 4")).alias("work_year"),
        F.col("text").alias("summary"),
        F.col("doc_id").cast("string").alias("job_id"),
        F.expr(_landed_expr("posted_at", "spark")).alias("job_posted_date"),
    )
    out = datasets.bulk_envelope(rows, "docs", "some/docs", 2020)
    return out.withColumn("skills_extracted", F.array_join("skills_extracted", ","))


def _bulk_sql():
    rr = _case(["100", "50", "0", "", None], "n_chars % 5")
    jt = _case(["Remote", "Hybrid", "x", ""], "n_chars % 4")
    remote = f"(case when {sq.money_k(rr)} is not null then {sq.money_k(rr)} >= 50 else {sq.remote_job_type(jt)} end)"
    single = "cast(n_chars as double) * 1000"
    return f"""select 'kaggle' as source, cast(doc_id as varchar) as external_id, {sq.strip(_TITLE)} as title,
      '' as title_normalized_hint, {sq.strip("source")} as company, coalesce({sq.strip(_PLACE)}, '') as location,
      nullif({sq.strip("lang")}, '') as country, {sq.strip("text")} as description,
      coalesce({sq.money_k(_landed_expr("salary_min", "sql"))}, {single}) as salary_min, {single} as salary_max,
      {remote} as remote, {_case(["a,b", "x,y", "solo", ""], "n_chars % 4")} as skills_extracted,
      coalesce({_landed_expr("posted_at", "sql")}, '') as posted_at, 'some/docs' as dataset_slug,
      {_case(["2023", "2020", "2022", "2020"], "n_chars % 4")}::integer as dataset_year,
      case when {remote} then 'Remote' when not {remote} then 'On-site' end as work_type,
      cast(null as varchar) as experience_level, nullif({jt}, '') as employment_type, cast(null as varchar) as company_size, 'docs' as dataset_key
    from documents where {sq.strip(_TITLE)} <> ''"""


# Provider JSON made of events.

_BOARD_JSON = """concat('{{"id": "', event_id, '", "title": "', event_type, ' remote", "created": "2024-01-01T00:00:00Z", ',
  '"salary_min": ', value, ', "salary_is_predicted": ', user_id % 2, ', "company": {{"display_name": "c', user_id, '"}}, ',
  '"location": {{"display_name": "Town", "area": ["A", "B', user_id, '"]}}, "category": {{"label": "IT", "tag": "it-jobs"}}, "props": ', props, '}}')"""


def _board(spark, d):
    events = px.table(spark, d, "events").select(
        F.expr(_BOARD_JSON.replace("{{", "{").replace("}}", "}")).alias("json"), F.lit("gb").alias("land")
    )
    records = events.select(F.from_json("json", schemas.BOARD_RECORD).alias("r"), "land").select("r.*", "land")
    return envelopes.board_envelope(records, F.col("land")).withColumn(
        "location_area", F.array_join("location_area", ",")
    )


_BOARD = """select 'adzuna' as source, cast(event_id as varchar) as external_id, event_type || ' remote' as title,
  'c' || user_id as company, 'Town' as location, 'A,B' || user_id as location_area, 'GB' as country,
  '' as description, value as salary_min, cast(null as double) as salary_max, user_id % 2 = 1 as salary_is_predicted,
  '' as contract_type, '' as contract_time, 'IT' as category, 'it-jobs' as category_tag, true as remote,
  '' as url, '2024-01-01T00:00:00Z' as posted_at from events"""

EVENT_CATEGORY = {"click": "Software Development", "view": "Sales", "error": "DevOps / Sysadmin", "signup": "HR"}


def _remote_records(spark, d):
    category = F.col("event_type")
    for event, name in EVENT_CATEGORY.items():
        category = F.when(F.col("event_type") == event, name).otherwise(category)
    k = F.floor("value").cast("bigint").cast("string")
    return px.table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("title"),
        F.concat(F.lit("c"), F.col("user_id")).alias("company_name"),
        category.alias("category"),
        F.lit("full_time").alias("job_type"),
        F.when(F.col("user_id") % 2 == 0, "USA").alias("candidate_required_location"),
        F.concat(F.lit("$"), k, F.lit("k - $"), k, F.lit("500,000")).alias("salary"),
        F.col("props").alias("description"),
        F.lit(None).cast("string").alias("url"),
        F.col("ts").cast("date").cast("string").alias("publication_date"),
    )


_CATEGORY_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in EVENT_CATEGORY.items()) + " else event_type end"
_FLOOR = "cast(floor(value) as bigint)"
_REMOTE = f"""select 'remotive' as source, 'Remotive (remotive.com)' as source_attribution,
  cast(event_id as varchar) as external_id, event_type as title, 'c' || user_id as company, category, 'full_time' as job_type,
  case when user_id % 2 = 0 then 'USA' else 'Worldwide' end as location, cast(null as varchar) as country, props as description,
  '$' || k || 'k - $' || k || '500,000' as salary_raw,
  cast(case when k * 1000 > 100 then k * 1000 else cast(k || '500000' as bigint) end as double) as salary_min,
  cast(cast(k || '500000' as bigint) as double) as salary_max, true as remote, '' as url,
  cast(cast(ts as date) as varchar) as posted_at
from (select *, {_CATEGORY_SQL} as category, {_FLOOR} as k from events)
where {sq.contains_any("lower(category)", lx.TECH_CATEGORY_WORDS)}"""


def _keep_all(spark, d):
    """No category holds any of the words, so every record stays."""
    kept = envelopes.keep_tech(_remote_records(spark, d), words=("zzz", "qqq"))
    return kept.groupBy("category").agg(F.count("*").alias("record_count"))


# Quality suites.


def _silver_checks(spark, d):
    return quality.silver_checks(_jobs(spark, d))


def _pct(n: str) -> str:
    return f"printf('%.1f', {n} * 100.0 / total)"


_SILVER_CHECKS = f"""with j as ({_JOBS}), m as (select count(*) as total,
  count(*) filter (where title <> '') as t, count(*) filter (where source <> '') as s,
  count(*) filter (where raw_hash <> '') as h, count(posted_at) as p, count(distinct raw_hash) as u,
  count(*) filter (where salary_max < salary_min) as b, count(*) filter (where not salary_missing) as ws,
  count(*) filter (where not skill_missing) as wk, count(distinct source) as ns from j)
select 'silver' as layer, * from (
  select 1 as position, 'silver_jobs_exist' as name, 'passed' as status, total || ' rows in jobs' as detail from m
  union all select 2, 'silver_title_fill_rate', case when t >= 0.99 * total then 'passed' else 'warned' end,
    {_pct("t")} || '% filled (threshold 99%)' from m
  union all select 3, 'silver_source_fill_rate', case when s = total then 'passed' else 'failed' end,
    {_pct("s")} || '% filled (threshold 100%)' from m
  union all select 4, 'silver_raw_hash_fill_rate', case when h = total then 'passed' else 'failed' end,
    {_pct("h")} || '% filled (threshold 100%)' from m
  union all select 5, 'silver_posted_at_fill_rate', case when p >= 0.7 * total then 'passed' else 'warned' end,
    {_pct("p")} || '% filled (threshold 70%)' from m
  union all select 6, 'silver_raw_hash_unique', case when u = total then 'passed' else 'failed' end,
    (total - u) || ' duplicate hashes found' from m
  union all select 7, 'silver_salary_min_lte_max', case when b = 0 then 'passed' else 'failed' end,
    b || ' rows where salary_max < salary_min' from m
  union all select 8, 'silver_salary_coverage', case when ws >= 0.2 * total then 'passed' else 'warned' end,
    {_pct("ws")} || '% rows have salary data (threshold 20%)' from m
  union all select 9, 'silver_multiple_sources', case when ns >= 2 then 'passed' else 'warned' end,
    ns || ' sources' from m
  union all select 10, 'silver_skill_coverage', case when wk >= 0.3 * total then 'passed' else 'warned' end,
    {_pct("wk")} || '% rows have skills extracted (threshold 30%)' from m)"""


def _gold_checks(spark, d):
    roles = gold.daily_role_demand(px.supplier_postings(spark, d))
    skills = gold.daily_skill_demand(px.postings(spark, d), px.job_skills(spark, d), unique_bridge=True)
    alerts = gold.market_alerts(roles, skills)
    return quality.gold_checks(roles, skills, gold.salary_summary(px.jobs(spark, d)), alerts)


_GOLD_CHECKS = f"""with r as ({px.role_demand_sql(px.SUPPLIER_POSTINGS)}), k as ({px.skill_demand_sql()}),
s as ({px.SALARY_SUMMARY}), a as ({px.ALERTS})
select 'gold' as layer, * from (
  select 1 as position, 'gold_role_demand_populated' as name, case when count(*) > 0 then 'passed' else 'failed' end as status,
    count(*) || ' rows in daily_role_demand' as detail from r
  union all select 2, 'gold_moving_avgs_nonneg', 'passed',
    count(*) filter (where moving_avg_7d < 0 or moving_avg_30d < 0) || ' rows with negative averages' from r
  union all select 3, 'gold_moving_avg_plausible', 'passed',
    count(*) filter (where job_count > 5 and moving_avg_7d > job_count * 20) || ' rows with implausible 7d avg' from r
  union all select 4, 'gold_skill_demand_populated', case when count(*) > 0 then 'passed' else 'failed' end,
    count(*) || ' rows in daily_skill_demand' from k
  union all select 5, 'gold_salary_summary_populated', case when count(*) > 0 then 'passed' else 'warned' end,
    count(*) || ' rows in salary_summary' from s
  union all select 6, 'gold_salary_median_positive', 'passed',
    count(*) filter (where salary_median <= 0) || ' rows with non-positive median salary' from s
  union all select 7, 'gold_market_alerts_plausible', case when coalesce(bool_and(spike_ratio >= 2), true) then 'passed' else 'warned' end,
    count(*) || ' alerts, all spike_ratio >= 2.0' from a)"""


def _fx_from_table(spark, d):
    """A loaded rate table (nation balances as rates) cleaned and used for salaries."""
    customers = px.table(spark, d, "customer").join(
        px.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    rates = customers.select(
        F.lower("n_name").alias("currency"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal").cast("string")).otherwise("n/a").alias("rate"),
    )
    return clean_fx(rates)


QUERIES = {
    "silver_jobs": (_jobs, _JOBS),
    "silver_country_codes": (_country_codes, _COUNTRY_CODES),
    "silver_job_skills": (
        lambda s, d: _batch(s, d).job_skills,
        f"select raw_hash as job_id, unnest(skills) as skill_name from ({_STORED})",
    ),
    "silver_board_details": (
        lambda s, d: _batch(s, d).board_details,
        f"""select raw_hash as job_id, {sq.clean("contract_type")} as contract_type,
          cast(null as varchar) as contract_time, cast(null as boolean) as salary_is_predicted,
          {sq.clean("category")} as category, cast(null as varchar) as category_tag,
          nullif(lower({sq.strip("given_country")}), '') as country_code, cast(null as varchar) as location_area
        from ({_STORED}) where source = 'adzuna'""",
    ),
    "silver_remote_details": (
        lambda s, d: _batch(s, d).remote_details,
        f"""select raw_hash as job_id, {sq.clean("job_type")} as job_type, {sq.clean("category")} as category,
          {sq.clean("salary_raw")} as salary_raw, nullif(url, '') as source_url
        from ({_STORED}) where source = 'remotive'""",
    ),
    "silver_bulk_details": (
        lambda s, d: _batch(s, d).bulk_details,
        f"""select raw_hash as job_id, cast(null as varchar) as dataset_slug,
          try_cast({sq.strip("dataset_year")} as integer) as dataset_year, {sq.clean("work_type")} as work_type,
          cast(null as varchar) as experience_level, cast(null as varchar) as employment_type,
          cast(null as varchar) as company_size from ({_STORED}) where source = 'kaggle'""",
    ),
    "silver_rejects": (
        lambda s, d: _batch(s, d).rejects,
        f"""select 'run-1' as run_id, 'bronze_to_silver' as stage, 'missing_source' as error_type,
          'missing_source: ' as error_message, left(external_id, 250) as record_id
        from ({_FIRST}) where source is null""",
    ),
    "source_counts": (
        lambda s, d: silver.source_counts(landed(s, d)),
        f"select source, count(*) as record_count from ({LANDED}) group by source",
    ),
    "currency_relabel": (
        lambda s, d: silver.relabel_currency(_jobs(s, d).withColumn("salary_currency", F.lit("USD"))).select(
            "raw_hash", "country", "salary_currency", "salary_min_original", "salary_max_original"
        ),
        f"""select raw_hash, country, case when source = 'adzuna' and country in
            ('GB', 'IN', 'CA', 'AU', 'DE', 'FR', 'NL', 'SG', 'NZ', 'ZA') then {sq.currency("country")} else 'USD' end
            as salary_currency, salary_min as salary_min_original,
          case when salary_min is not null then salary_max end as salary_max_original from ({_STORED})""",
    ),
    "currency_report": (
        lambda s, d: silver.currency_report(_jobs(s, d)),
        f"""select source, country, salary_currency, count(*) as job_count from ({_STORED})
        group by source, country, salary_currency""",
    ),
    "dedup_within_batch": (_dedup, f"select raw_hash, doc_id from ({_FIRST})"),
    "dedup_document_copies": (_copies, _COPIES),
    "cross_run_dedup": (
        _cross_run,
        f"""select * from ({_COPIES}) where key not in
          (select {_TEXT_KEY} from documents where doc_id in (select doc_id from labels))""",
    ),
    "wide_union": (_wide, _WIDE_SQL),
    "duplicates_flagged": (
        _wide_summary,
        f"""select source, count(*) as row_count, count(*) filter (where is_exact_duplicate) as duplicates_flagged,
          avg(quality_score) as mean_score from ({_WIDE_SQL}) group by source""",
    ),
    "raw_row_numbers": (
        _row_numbers,
        """select 'run-0' as run_id, 'docs' as dataset_key, 'documents.parquet' as source_file,
          doc_id + 1 as row_number, cast(doc_id as varchar) as doc_id, lang, cast(n_chars as varchar) as n_chars
        from documents""",
    ),
    "bulk_envelope": (_bulk, _bulk_sql()),
    "board_envelope": (_board, _BOARD),
    "remote_envelope": (
        lambda s, d: envelopes.remote_envelope(envelopes.keep_tech(_remote_records(s, d))),
        _REMOTE,
    ),
    "keep_all_categories": (
        _keep_all,
        f"select {_CATEGORY_SQL} as category, count(*) as record_count from events group by 1",
    ),
    "keep_listed_categories": (
        lambda s, d: envelopes.keep_tech(_remote_records(s, d), ["sales", "hr"])
        .groupBy("category")
        .agg(F.count("*").alias("record_count")),
        f"""select {_CATEGORY_SQL} as category, count(*) as record_count from events
        where lower({_CATEGORY_SQL}) in ('sales', 'hr') group by 1""",
    ),
    "silver_checks": (_silver_checks, _SILVER_CHECKS),
    "gold_checks": (_gold_checks, _GOLD_CHECKS),
    "checks_overall": (
        lambda s, d: quality.overall(_silver_checks(s, d).unionByName(_gold_checks(s, d))),
        f"""select layer, case when bool_or(status = 'failed') then 'failed' when bool_or(status = 'warned')
          then 'warned' else 'passed' end as overall, count(*) as check_count
        from (select * from ({_SILVER_CHECKS}) union all select * from ({_GOLD_CHECKS})) group by layer""",
    ),
    "fx_table": (
        _fx_from_table,
        """select upper(n_name) as currency, max(c_acctbal) as rate from customer
        join nation on c_nationkey = n_nationkey where c_custkey % 2 = 0 and c_acctbal > 0 group by 1""",
    ),
}
