"""Salary-model data and streaming refresh on the given tables."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import proxies as px, sqltext as sq
from catalog.text_queries import TITLES
from laborlake.functions import lexicons as lx
from laborlake.functions.text import currency_code
from laborlake.plans import features, models, predict
from laborlake.sources.staging import shared_folder
from laborlake.streaming import sources as streams

TOP = 10
FLAGGED = ("Brand#1", "Brand#12", "Brand#25")
INDUSTRIES = ["Tech", " Finance ", "Automotive", "", None, "Healthcare", "Farming"]
SKILL_SETS = [["python", "sql"], ["c++"], [], ["React"], ["machine learning", "ci/cd", "python"]]
FORM = ["data scientist", " Data Analyst", "Wizard", "other", None, "sr. software engineer"]


def _jobs(spark, d) -> DataFrame:
    return px.jobs(spark, d).withColumn("salary_currency", currency_code(F.col("salary_currency")))


_TRAINING = f"""select job_id, coalesce(title_normalized, 'Other') as role, coalesce(country, 'UNKNOWN') as country,
  source, case when remote then 1.0::double when not remote then 0.0::double end as remote_int,
  salary_min, salary_max, (salary_min + salary_max) / 2.0 as salary_mid
from ({px.JOBS}) where upper(coalesce(nullif(trim(salary_currency), ''), 'USD')) = 'USD'
  and (salary_min + salary_max) / 2.0 >= 10000"""
_WITH_SKILLS = f"""select t.*, coalesce(s.names, []) as names, cast(len(coalesce(s.names, [])) as double) as skill_count
from ({_TRAINING}) t left join (select job_id, list(skill_name order by skill_name) as names
  from ({px.JOB_SKILLS}) group by job_id) s on s.job_id = t.job_id"""


def _training(spark, d):
    return features.training_jobs(_jobs(spark, d))


def _flags(spark, d):
    rows = features.with_skills(_training(spark, d), px.job_skills(spark, d))
    flagged = features.skill_flags(rows, FLAGGED)
    return flagged.select("job_id", "skill_count", *[f"`{features.flag_name(s)}`" for s in FLAGGED])


_FLAGS = "select job_id, skill_count, " + ", ".join(
    f"case when list_contains(names, '{s}') then 1.0::double else 0.0::double end as \"{features.flag_name(s)}\"" for s in FLAGGED
) + f" from ({_WITH_SKILLS})"


def _skills_per_job(spark, d):
    rows = features.with_skills(_training(spark, d), px.job_skills(spark, d))
    return rows.select("job_id", "skill_count", F.array_join("skills_array", ",").alias("skills"))


def _matrix(spark, d):
    matrix = features.feature_matrix(_jobs(spark, d), px.job_skills(spark, d), top_n_skills=TOP)
    return matrix.select("job_id", vector_to_array("features").alias("features"), features.LABEL)


def _places(spark, d):
    """The non-zero places of each posting's feature vector, and the vector's size."""
    matrix = features.feature_matrix(_jobs(spark, d), px.job_skills(spark, d), top_n_skills=TOP)
    vector = vector_to_array("features")
    rows = matrix.select("job_id", F.size(vector).cast("long").alias("size"), F.posexplode(vector).alias("place", "value"))
    return rows.where("value != 0").select("job_id", "size", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


# Numbers first (a flag per top skill, the number of skills, remote with gaps filled by the median), then per category a place
# per label, the frequent ones first, and one for labels not seen in training; each place over its deviation.
_PLACES = f"""with t as materialized ({_WITH_SKILLS}),
top as (select skill_name, row_number() over (order by count(*) desc, skill_name) as i
  from ({px.JOB_SKILLS}) group by skill_name qualify i <= {TOP}),
labels as (select part, label, row_number() over (partition by part order by count(*) desc, label) as i
  from (select unnest([2, 3, 4]) as part, unnest([role, country, source]) as label from t) where label is not null group by part, label),
places as (
  select job_id, 0 as part, i, case when list_contains(names, skill_name) then 1.0::double else 0.0::double end as x from t, top
  union all select job_id, 1, 1, skill_count from t
  union all select job_id, 1, 2, coalesce(remote_int, (select quantile_disc(remote_int, 0.5) from t)) from t
  union all select job_id, part, i,
    case when label = case part when 2 then role when 3 then country else source end then 1.0::double else 0.0::double end from t, labels
  union all select job_id, part, 1000000, 0.0::double from t, (select unnest([2, 3, 4]) as part)),
spread as (select part, i, stddev_samp(x) as sd, row_number() over (order by part, i) - 1 as place from places group by part, i)
select job_id, (select count(*) from spread) as size, place, round(x / sd, 6) as value
from places join spread using (part, i) where sd > 0 and x <> 0"""


def _train(spark, d):
    """Train on four fifths of the postings and score the rest."""
    rows, names = features.feature_table(_jobs(spark, d), px.job_skills(spark, d), top_n_skills=TOP)
    model, _ = models.train(rows, names, "ridge")
    _, test = models.split_rows(rows, "job_id")
    scored = predict.with_band(model.transform(test).drop("salary_min", "salary_max"))
    return scored.select("job_id", features.LABEL, "salary_min", "salary_max", "point_estimate")


# Salary requests made of parts.


def _requests(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    sets = None
    for i, chosen in enumerate(SKILL_SETS):
        value = F.array(*[F.lit(s) for s in chosen]).cast("array<string>")
        sets = F.when(key % len(SKILL_SETS) == i, value) if sets is None else sets.when(key % len(SKILL_SETS) == i, value)
    return px.table(spark, d, "part").select(
        key.alias("id"),
        ((F.col("p_retailprice") - 900) / 2 - 5).alias("years_of_experience"),
        px.choice(size % len(FORM), FORM).alias("job_title"),
        px.choice(key % len(INDUSTRIES), INDUSTRIES).alias("industry"),
        px.choice(key % 3, ["Remote", "On-site", None]).alias("remote_status"),
        sets.alias("selected_skills"),
    )


_REQUESTS = f"""select p_partkey as id, (p_retailprice - 900) / 2 - 5 as years_of_experience,
  {px.choice_sql(f"p_size % {len(FORM)}", FORM)} as job_title,
  {px.choice_sql(f"p_partkey % {len(INDUSTRIES)}", INDUSTRIES)} as industry,
  {px.choice_sql("p_partkey % 3", ["Remote", "On-site", None])} as remote_status,
  case p_partkey % {len(SKILL_SETS)} {" ".join(f"when {i} then {s}::varchar[]" for i, s in enumerate(SKILL_SETS))} end
    as selected_skills from part"""


def _feature_sql(name: str) -> str:
    def flag(test: str) -> str:
        return f"case when {test} then 1.0::double else 0.0::double end"

    if name == predict.YEARS:
        return "greatest(0.0::double, least(30.0::double, coalesce(years_of_experience, 0)))"
    if name == predict.REMOTE:
        return flag("trim(coalesce(remote_status, 'On-site')) = 'Remote'")
    if name.startswith("ui_title_"):
        return flag(f"lower({sq.strip('''coalesce(job_title, 'other')''')}) = {sq.quote(name.removeprefix('ui_title_'))}")
    if name.startswith("ui_industry_"):
        known = ", ".join(sq.quote(i) for i in lx.MODEL_INDUSTRIES)
        s = sq.strip("industry")
        return flag(f"(case when {s} in ({known}) then {s} else 'Other' end) = {sq.quote(name.removeprefix('ui_industry_'))}")
    return flag(f"list_contains(selected_skills, {sq.quote(name.removeprefix('skill_'))})")


def _request_features(spark, d):
    wide = predict.feature_columns(_requests(spark, d))
    return wide.select("id", *[F.col(f"`{n}`") for n in predict.FEATURES])


_REQUEST_FEATURES = "select id, " + ", ".join(
    f'{_feature_sql(n)} as "{n}"' for n in predict.FEATURES
) + f" from ({_REQUESTS})"


def _form_checks(spark, d):
    return predict.form_checks(_requests(spark, d)).select("id", F.array_join("problems", ",").alias("problems"))


def _in(x: str, values) -> str:
    return f"{x} in ({', '.join(sq.quote(v) for v in values)})"


_FORM_CHECKS = f"""select id, concat_ws(',',
  case when not coalesce(years_of_experience between 0 and 30, false) then 'years_of_experience' end,
  case when not coalesce({_in("job_title", lx.FORM_TITLES)}, false) then 'job_title' end,
  case when not coalesce({_in("industry", lx.FORM_INDUSTRIES)}, false) then 'industry' end,
  case when not coalesce({_in("remote_status", lx.FORM_REMOTE)}, false) then 'remote_status' end,
  case when 'React' in (select unnest(selected_skills)) then 'selected_skills' end) as problems from ({_REQUESTS})"""


def _free_text(spark, d):
    key = F.col("p_partkey")
    texts = px.table(spark, d, "part").select(
        key.alias("id"),
        px.choice(key % len(TITLES), [t and t.replace("II", "").strip() for t in TITLES]).alias("title"),
        F.array(F.lit(" Python"), F.lit(""), F.col("p_type")).alias("skills"),
        F.when(key % 3 == 0, F.lit(True)).when(key % 3 == 1, F.lit(False)).alias("remote"),
    )
    return predict.from_free_text(texts).withColumn("selected_skills", F.array_join("selected_skills", ","))


_T = px.choice_sql(f"p_partkey % {len(TITLES)}", [t and t.replace("II", "").strip() for t in TITLES])
_FREE_TEXT = f"""select p_partkey as id, 3.0::double as years_of_experience,
  case when {_in(f"lower({_T})", lx.FORM_TITLES)} then lower({_T}) else 'other' end as job_title, 'Tech' as industry,
  case when p_partkey % 3 = 0 then 'Remote' else 'On-site' end as remote_status,
  'python,' || lower(p_type) as selected_skills from part"""


def _bands(spark, d):
    orders = px.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("prediction")
    )
    return predict.with_band(orders).drop("prediction")


_BANDS = f"""select o_orderkey as id, {px.rounded("o_totalprice - abs(o_totalprice) * 0.12")} as salary_min,
  {px.rounded("o_totalprice + abs(o_totalprice) * 0.12")} as salary_max, {px.rounded("o_totalprice")} as point_estimate
from orders"""


# Streaming: events as a stream of postings, counted per day and type into a stored table.

def _stream(spark, d):
    schema = px.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        events.withColumnRenamed("event_type", "role")
        .writeStream.foreachBatch(streams.daily_count_writer(f"{root}/counts", "ts", "role"))
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return streams.daily_counts(spark, f"{root}/counts", "role")


QUERIES = {
    "top_skills": (
        lambda s, d: features.top_skills(px.job_skills(s, d), TOP),
        f"""select skill_name, count(*) as job_count from ({px.JOB_SKILLS}) group by skill_name
        order by job_count desc, skill_name limit {TOP}""",
    ),
    "training_set": (_training, _TRAINING),
    "skills_per_job": (
        _skills_per_job,
        f"select job_id, skill_count, array_to_string(names, ',') as skills from ({_WITH_SKILLS})",
    ),
    "skill_flags": (_flags, _FLAGS),
    "feature_matrix": (_matrix, None),
    "feature_places": (_places, _PLACES),
    "train_predict": (_train, None),
    "request_features": (_request_features, _REQUEST_FEATURES),
    "form_checks": (_form_checks, _FORM_CHECKS),
    "free_text_requests": (_free_text, _FREE_TEXT),
    "prediction_band": (_bands, _BANDS),
    "stream_daily_demand": (
        _stream,
        """select cast(ts as date) as date, event_type as role, count(*) as job_count from events group by 1, 2""",
    ),
}
