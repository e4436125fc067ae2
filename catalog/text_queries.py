"""Parsing and inference functions over texts derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import proxies as px, sqltext as sq
from laborlake.functions import infer, lexicons as lx, parse, text
from laborlake.plans import silver

PLACES = [
    "New York, USA", "London, UK", "Toronto, Canada", "Sydney, Australia", "Berlin, Germany",
    "Bangalore, India", "Paris, France", "Singapore", "Amsterdam, Netherlands", "Milwaukee",
    " Chicago , IL", "Manchester", "Vancouver", "Melbourne", "Munich", "Hyderabad", "Mumbai",
    "Birmingham", "Montreal", "Austin", "Oslo", "", None, ", unknown", "Seattle, United States",
]
TITLES = [
    "Senior Data Engineer", "Data Scientist II", "BI Analyst", "Analytics Engineer", "ML Engineer",
    "Machine Learning Data Engineer", "NLP Engineer", "Backend Developer", "Front-end Developer",
    "Full Stack Developer", "SRE", "Cloud Architect", "Cybersecurity Lead", "Database Admin",
    "Product Owner", "Nurse", "Software Engineer, React", "ETL Pipeline Developer", "Teacher", None,
]
CATEGORIES = ["IT Jobs", "Data Science", "", None, "DevOps / Sysadmin", "Sales", "React", "Computer Vision"]
PHRASES = [
    "Work from home, Python and SQL", "Must be in office. Java, C++11 and Go", "On-site only with Spark",
    "Hybrid, power bi or powerbi", "No remote. Machine learning, deep learning, R!", "remote-first team",
    "Kubernetes/Docker; scikit-learn", "distributed team, anywhere in the world", "pyspark/dbt, onsite",
    "office only: excel", "telework and NLP", "LLM, c++", None,
]
JOB_TYPES = ["Remote", "full_time", "On-site", "HYBRID", "in-person", "", None]
WORDS = ("the", "and", "of", "le", "la", "de", "mit", "und", "en", "por")
MIXED = ("data", "data platform", "platform", "the", "of the")


def _places(spark, d):
    return px.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        px.choice(F.col("c_nationkey"), PLACES).alias("location"),
        px.choice(F.col("c_custkey") % 5, ["us", "", None, "Germany", None]).alias("given"),
    )


_PLACES = f"""select c_custkey as id, {px.choice_sql("c_nationkey", PLACES)} as location,
  {px.choice_sql("c_custkey % 5", ["us", "", None, "Germany", None])} as given from customer"""


def _parts(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    return px.table(spark, d, "part").select(
        key.alias("id"),
        px.choice(key % len(TITLES), TITLES).alias("title"),
        px.choice(size % len(CATEGORIES), CATEGORIES).alias("category"),
        px.choice(size % len(PHRASES), PHRASES).alias("description"),
        px.choice(key % len(JOB_TYPES), JOB_TYPES).alias("job_type"),
        px.choice(size % 5, PLACES[:5]).alias("location"),
    )


_PARTS = f"""select p_partkey as id, {px.choice_sql(f"p_partkey % {len(TITLES)}", TITLES)} as title,
  {px.choice_sql(f"p_size % {len(CATEGORIES)}", CATEGORIES)} as category,
  {px.choice_sql(f"p_size % {len(PHRASES)}", PHRASES)} as description,
  {px.choice_sql(f"p_partkey % {len(JOB_TYPES)}", JOB_TYPES)} as job_type,
  {px.choice_sql("p_size % 5", PLACES[:5])} as location from part"""


def _infer_place(spark, d):
    location, given = F.col("location"), F.col("given")
    return _places(spark, d).select(
        "id",
        infer.country(location).alias("country"),
        infer.country_wide(location).alias("country_wide"),
        infer.city(location).alias("city"),
        infer.country_choice(given, location).alias("chosen"),
        infer.currency_of(infer.country_choice(given, location)).alias("currency"),
    )


def _infer_place_sql():
    chosen = f"upper(coalesce(nullif(given, ''), {sq.rules('location', lx.COUNTRY_HINTS)}))"
    return f"""select id, {sq.rules("location", lx.COUNTRY_HINTS)} as country,
      {sq.rules("location", lx.COUNTRY_HINTS_WIDE)} as country_wide, {sq.city("location")} as city,
      {chosen} as chosen, {sq.currency(chosen)} as currency from ({_PLACES})"""


def _infer_remote(spark, d):
    title, description, location = F.col("title"), F.col("description"), F.col("location")
    by_type = infer.remote_by_job_type(F.col("job_type"))
    return _parts(spark, d).select(
        "id",
        infer.remote_by_words(F.concat_ws(" ", title, location, description)).alias("by_words"),
        infer.remote_by_patterns(title, description, location).alias("by_patterns"),
        by_type.alias("by_type"),
        infer.work_type(by_type).alias("work_type"),
    )


def _infer_remote_sql():
    joined = "concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(location, ''))"
    by_type = sq.remote_job_type("job_type")
    return f"""select id, {sq.remote_words("concat_ws(' ', title, location, description)")} as by_words,
      {sq.remote_patterns(joined)} as by_patterns, {by_type} as by_type,
      case when {by_type} then 'Remote' when not {by_type} then 'On-site' end as work_type from ({_PARTS})"""


def _titles(spark, d):
    return _parts(spark, d).select(
        "id",
        infer.canonical_title(F.col("title"), F.col("category")).alias("canonical_title"),
        infer.role_family(F.col("title")).alias("role_family"),
    )


def _titles_sql():
    both = "concat_ws(' ', coalesce(title, ''), coalesce(category, ''))"
    return f"""select id, {sq.rules(both, lx.TITLE_RULES)} as canonical_title,
      {sq.rules("title", lx.ROLE_RULES)} as role_family from ({_PARTS})"""


def _skills_of(column, spark_df, lexicon=lx.SKILLS):
    return spark_df.select("id", F.array_join(infer.skills(F.col(column), lexicon), ",").alias("skills"))


def _documents(spark, d):
    return px.table(spark, d, "documents").withColumnRenamed("doc_id", "id")


def _word_jobs(spark, d):
    docs = _documents(spark, d).select("id", infer.skills(F.col("text"), WORDS).alias("skills"))
    return silver.job_skills(docs, "id")


# Number, salary, date, flag and list texts made of order columns.

_THOUSANDS = "cast(floor(o_totalprice / 1000) as bigint)"
_REST = "lpad(cast(cast(floor(o_totalprice) as bigint) % 1000 as {text}), 3, '0')"


def _amounts(text: str) -> str:
    p = f"cast(cast(o_totalprice as decimal(12, 2)) as {text})"
    k = f"cast({_THOUSANDS} as {text})"
    return f"""case o_orderkey % 13 when 0 then concat('$', {p})
      when 1 then concat({k}, ',', {_REST.format(text=text)}) when 2 then concat({k}, 'k')
      when 3 then concat(' ', {p}, ' ') when 4 then concat('-', {p}) when 5 then 'nan'
      when 6 then concat({p}, 'd') when 7 then '' else concat({k}, 'e3') end"""


def _ranges(text: str) -> str:
    k = f"cast({_THOUSANDS} as {text})"
    return f"""case o_orderkey % 7 when 0 then concat('$', {k}, ',000 - $', {k}, ',500')
      when 1 then concat('$', {k}, 'k - $', {k}, '.5K') when 2 then concat('€', {k}, ',250')
      when 3 then concat({k}, '000') when 4 then '' when 5 then 'competitive' else concat(k0.k, ' per hour') end""".replace(
        "k0.k", "'35'"
    )


def _orders(spark, d, **exprs):
    return px.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), *[F.expr(e).alias(n) for n, e in exprs.items()]
    )


def _numbers(spark, d):
    x = F.col("x")
    return _orders(spark, d, x=_amounts("string")).select(
        "id", parse.money(x).alias("money"), parse.money_k(x).alias("money_k"), parse.integer(x).alias("whole")
    )


_NUMBERS = f"""select id, {sq.money("x")} as money, {sq.money_k("x")} as money_k,
  case when regexp_matches({sq.strip("x")}, '^[+-]?[0-9]+$') then try_cast({sq.strip("x")} as integer) end as whole
from (select o_orderkey as id, {_amounts("varchar")} as x from orders)"""


def _salary_range(spark, d):
    pay = parse.salary_range(F.col("x"))
    return _orders(spark, d, x=_ranges("string")).select(
        "id", pay["low"].alias("low"), pay["high"].alias("high")
    )


_K = "cast(floor(o_totalprice / 1000) as bigint)"
_SALARY_RANGE = f"""with r as (select o_orderkey as id, o_orderkey % 7 as form, {_K} as k from orders),
v as (select id, case form when 0 then k * 1000.0 when 1 then k * 1000.0 when 2 then k * 1000.0 + 250
      when 3 then k * 1000.0 end as a,
    case form when 0 then k * 1000.0 + 500 when 1 then k * 1000.0 + 500 when 2 then k * 1000.0 + 250
      when 3 then k * 1000.0 end as b from r)
select id, cast(case when a > 100 then a when b > 100 then b end as double) as low,
  cast(case when b > 100 then b end as double) as high from v"""

_DATE_FORMS = (
    "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d/%m/%Y", "%Y-%-m-%-d", "%m-%d-%Y",
)
_AT = "cast(o_orderdate + o_orderkey * interval '61' second as string)"
_DATE_PIECES = (
    f"replace({_AT}, ' ', 'T')", _AT, f"left({_AT}, 10)",
    f"concat(substr({_AT}, 9, 2), '/', substr({_AT}, 6, 2), '/', left({_AT}, 4))",
    f"concat_ws('-', left({_AT}, 4), cast(substr({_AT}, 6, 2) as int), cast(substr({_AT}, 9, 2) as int))",
    f"concat(substr({_AT}, 6, 2), '-', substr({_AT}, 9, 2), '-', left({_AT}, 4))",
)


def _date_text(text: str) -> str:
    at = "o_orderdate + o_orderkey * interval 61 second"
    f = _DATE_PIECES if text == "string" else [f"strftime({at}, {sq.quote(form)})" for form in _DATE_FORMS]
    return f"""case o_orderkey % 13 when 0 then concat({f[0]}, '+05:30') when 1 then concat({f[0]}, 'Z')
      when 2 then concat({f[1]}, '.123456') when 3 then {f[2]} when 4 then {f[3]} when 5 then {f[4]}
      when 6 then {f[5]} when 7 then concat(' ', {f[2]}) when 8 then concat({f[0]}, '-08') when 9 then concat(left({f[0]}, 16), '-08:00')
      when 10 then concat(left({f[1]}, 16), ' +0130 ') when 11 then concat(left({f[0]}, 16), 'Z') else '' end"""


def _datetimes(spark, d):
    x = F.col("x")
    at = parse.timestamp(x, strip_first=True)
    return _orders(spark, d, x=_date_text("string")).select(
        "id", parse.timestamp(x).alias("posted_at"), at.alias("posted_stripped"),
        F.year(at).alias("year"), F.to_date(at).alias("day"),
    )


_DATETIMES = f"""select id, {sq.timestamp("x")} as posted_at, {sq.timestamp("x", True)} as posted_stripped,
  cast(year({sq.timestamp("x", True)}) as integer) as year, cast({sq.timestamp("x", True)} as date) as day
from (select o_orderkey as id, {_date_text("varchar")} as x from orders)"""

FLAGS = ["Yes", "n", " TRUE ", "0", "f", "1", "maybe", "", None, "y", "No"]
LISTS = [
    "['Python', 'SQL ']", '["Spark", "dbt"]', "excel, Tableau,,", "Go", "", None, "[R]",
    "['a', \"b\"]", " power bi ", "[]",
]


def _flags(spark, d):
    x, y = F.col("x"), F.col("y")
    rows = px.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        px.choice(F.col("o_orderkey") % len(FLAGS), FLAGS).alias("x"),
        px.choice(F.col("o_orderkey") % len(LISTS), LISTS).alias("y"),
    )
    return rows.select(
        "id",
        parse.boolean_wide(x).alias("wide"),
        parse.boolean_bulk(x).alias("bulk"),
        F.array_join(parse.skill_list(y), "|").alias("list"),
        F.array_join(parse.bulk_skills(y), "|").alias("bulk_list"),
    )


_LISTED = ["python|sql", "spark|dbt", "excel|tableau", "go", "", "", "r", "a|b", "power bi", ""]
_FLAGS = f"""select id, {sq.boolean("x", lx.TRUE_WIDE, lx.FALSE_WIDE)} as wide,
  {sq.boolean("x", lx.TRUE_BULK, lx.FALSE_BULK)} as bulk, y as list, y as bulk_list
from (select o_orderkey as id, {px.choice_sql(f"o_orderkey % {len(FLAGS)}", FLAGS)} as x,
  {px.choice_sql(f"o_orderkey % {len(LISTS)}", _LISTED)} as y from orders)"""


def _salary_clean(spark, d):
    rows = px.table(spark, d, "orders").join(
        px.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    low = parse.positive(F.col("c_acctbal"))
    high = silver.repaired_max(low, parse.positive(F.col("o_totalprice") - 250000))
    return rows.select(
        F.col("o_orderkey").alias("id"), low.alias("salary_min"), high.alias("salary_max"),
        (low.isNull() & high.isNull()).alias("salary_missing"),
    )


_SALARY_CLEAN = """select id, a as salary_min, case when b < a then a else b end as salary_max,
  a is null and b is null as salary_missing
from (select o_orderkey as id, case when c_acctbal > 0 then c_acctbal end as a,
    case when o_totalprice - 250000 > 0 then o_totalprice - 250000 end as b
  from orders join customer on o_custkey = c_custkey)"""


def _hashes(spark, d):
    docs = px.table(spark, d, "documents")
    return docs.select(
        "doc_id",
        text.posting_hash(F.col("text"), F.col("lang"), F.col("n_chars").cast("string"), F.col("source")).alias("raw_hash"),
        text.parts_hash(F.col("text"), F.lit(""), F.col("lang"), F.lit(None)).alias("key_hash"),
        text.dedup_key(F.col("lang"), F.col("source"), F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")).alias("dedup_key"),
    )


_HASHES = f"""select doc_id, {sq.hash_key("text", "lang", "cast(n_chars as varchar)", "source")} as raw_hash,
  sha256(concat_ws('|', lower({sq.strip("text")}), lower({sq.strip("lang")}))) as key_hash,
  concat(lower(lang), '|', lower(source), '||') as dedup_key from documents"""


def _joined(x: str) -> str:
    return f"array_to_string({x}, ',')"


QUERIES = {
    "infer_place": (_infer_place, _infer_place_sql()),
    "infer_remote": (_infer_remote, _infer_remote_sql()),
    "titles_and_roles": (_titles, _titles_sql()),
    "extract_skills": (
        lambda s, d: _skills_of("description", _parts(s, d)),
        f"select id, {_joined(sq.skills('description'))} as skills from ({_PARTS})",
    ),
    "extract_skills_documents": (
        lambda s, d: _skills_of("text", _documents(s, d)),
        f"select doc_id as id, {_joined(sq.skills('text'))} as skills from documents",
    ),
    "extract_overlapping_terms": (
        lambda s, d: _skills_of("text", _documents(s, d), MIXED),
        f"select doc_id as id, {_joined(sq.skills('text', MIXED))} as skills from documents",
    ),
    "document_word_skills": (
        _word_jobs,
        f"""select doc_id as job_id, unnest({sq.skills("text", WORDS)}) as skill_name from documents""",
    ),
    "parse_numbers": (_numbers, _NUMBERS),
    "salary_range": (_salary_range, _SALARY_RANGE),
    "parse_datetime": (_datetimes, _DATETIMES),
    "parse_flags_and_lists": (_flags, _FLAGS),
    "salary_clean": (_salary_clean, _SALARY_CLEAN),
    "content_hashes": (_hashes, _HASHES),
}
