"""Salary requests: checking, mapping to model inputs, scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlake.functions import lexicons as lx
from laborlake.functions.parse import strip
from laborlake.operators.percentiles import round_half_up

YEARS = "ui_experience_years"
REMOTE = "ui_remote_Remote"
FEATURES: tuple[str, ...] = (
    YEARS,
    REMOTE,
    *[f"ui_title_{t}" for t in lx.FORM_TITLES],
    *[f"ui_industry_{i}" for i in lx.MODEL_INDUSTRIES],
    *[f"skill_{s}" for s in lx.FORM_SKILLS],
)


def industry(c: Column) -> Column:
    """A known industry as it is; anything else is 'Other'."""
    text = strip(c)
    return F.when(text.isin(*lx.MODEL_INDUSTRIES), text).otherwise(F.lit("Other"))


def clamp_years(c: Column) -> Column:
    low, high = lx.FORM_YEARS
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c.cast("double"), F.lit(0.0))))


def form_checks(requests: DataFrame) -> DataFrame:
    """Add ``problems``: the fields whose value the form does not offer (empty when fine)."""
    years = F.col("years_of_experience")
    ok = {
        "years_of_experience": years.between(*lx.FORM_YEARS),
        "job_title": F.col("job_title").isin(*lx.FORM_TITLES),
        "industry": F.col("industry").isin(*lx.FORM_INDUSTRIES),
        "remote_status": F.col("remote_status").isin(*lx.FORM_REMOTE),
        "selected_skills": F.forall("selected_skills", lambda s: s.isin(*lx.FORM_SKILLS)),
    }
    bad = [F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in ok.items()]
    return requests.withColumn("problems", F.array_compact(F.array(*bad)))


def from_free_text(requests: DataFrame) -> DataFrame:
    """Free-text title, skills and remote flag as form fields: 3 years, industry 'Tech'."""
    title = F.lower(strip(F.coalesce("title", F.lit(""))))
    skills = F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda s: strip(F.lower(s)))
    return requests.select(
        *[c for c in requests.columns if c not in ("title", "skills", "remote")],
        F.lit(3.0).alias("years_of_experience"),
        F.when(title.isin(*lx.FORM_TITLES), title).otherwise(F.lit("other")).alias("job_title"),
        F.lit("Tech").alias("industry"),
        F.when(F.col("remote"), F.lit("Remote")).otherwise(F.lit("On-site")).alias("remote_status"),
        F.filter(skills, lambda s: s != "").alias("selected_skills"),
    )


def feature_columns(requests: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """The request's columns plus one 0/1 (or years) column per feature, in the given order."""

    def hit(test: Column) -> Column:
        return F.coalesce(test, F.lit(False)).cast("int").cast("double")

    title = F.lower(strip(F.coalesce("job_title", F.lit("other"))))
    remote = strip(F.coalesce("remote_status", F.lit("On-site"))) == "Remote"
    chosen = F.transform("selected_skills", lambda s: strip(s))

    def value(name: str) -> Column:
        if name == YEARS:
            return clamp_years(F.col("years_of_experience"))
        if name == REMOTE:
            return hit(remote)
        if name.startswith("ui_title_"):
            return hit(title == name.removeprefix("ui_title_"))
        if name.startswith("ui_industry_"):
            return hit(industry(F.col("industry")) == name.removeprefix("ui_industry_"))
        if name.startswith("skill_"):
            return hit(F.array_contains(chosen, name.removeprefix("skill_")))
        return F.lit(0.0)

    return requests.select("*", *[value(n).alias(n) for n in features])


def feature_vector(requests: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """One ``features`` vector per request, in fixed order."""
    quoted = feature_columns(requests, features).select(
        *[F.col(f"`{c}`") for c in requests.columns],
        *[F.col(f"`{n}`").alias(f"_f{i}") for i, n in enumerate(features)],
    )
    inputs = [f"_f{i}" for i in range(len(features))]
    return (
        VectorAssembler(inputCols=inputs, outputCol="features").transform(quoted).drop(*inputs)
    )


def with_band(scored: DataFrame, prediction: str = "prediction", band: float = lx.PREDICTION_BAND) -> DataFrame:
    """Point estimate and a symmetric band around it, rounded to cents."""
    point = F.col(prediction)
    margin = F.abs(point) * band
    return scored.withColumns(
        {
            "salary_min": round_half_up(point - margin, 2),
            "salary_max": round_half_up(point + margin, 2),
            "point_estimate": round_half_up(point, 2),
        }
    )


def predict(model: PipelineModel, requests: DataFrame) -> DataFrame:
    """Score requests with a model fitted on ``feature_vector`` rows."""
    return with_band(model.transform(feature_vector(requests)))
