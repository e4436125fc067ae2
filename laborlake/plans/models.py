"""Training, keeping and loading salary models."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlake.plans.features import LABEL, feature_pipeline
from laborlake.sources import files
from laborlake.sources.staging import staged

MODEL_TYPES = ("ridge", "random_forest", "gradient_boosting")
MIN_ROWS = 100
SEED = 42


def ridge_strength(rows: DataFrame, alpha: float) -> float:
    """Spark's ``regParam`` for the penalty ``alpha * |w|^2`` beside the sum of squared errors.

    Spark divides the errors by the number of rows and scales the label by its deviation.
    """
    got = rows.agg(F.count(LABEL).alias("n"), F.stddev_samp(LABEL).alias("sd")).first()
    return alpha * got["sd"] / got["n"] if got["n"] and got["sd"] else 0.0


def regressor(model_type: str, trees: int = 100, strength: float = 1.0):
    common = {"featuresCol": "features", "labelCol": LABEL, "predictionCol": "prediction"}
    if model_type == "ridge":
        return LinearRegression(elasticNetParam=0.0, regParam=strength, **common)
    if model_type == "random_forest":
        return RandomForestRegressor(numTrees=trees, seed=SEED, **common)
    if model_type == "gradient_boosting":
        return GBTRegressor(maxIter=trees, maxDepth=3, seed=SEED, **common)
    raise ValueError(f"unknown model type {model_type!r}; choose from {MODEL_TYPES}")


def split_rows(rows: DataFrame, key: str, test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: the same split on every run and any cluster."""
    bucket = F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(1_000_000))
    is_test = bucket < round(test_size * 1_000_000)
    return rows.filter(~is_test), rows.filter(is_test)


def evaluate(scored: DataFrame) -> dict[str, float]:
    def metric(name: str) -> float:
        return RegressionEvaluator(
            labelCol=LABEL, predictionCol="prediction", metricName=name
        ).evaluate(scored)

    return {"mae": round(metric("mae"), 2), "rmse": round(metric("rmse"), 2), "r2": round(metric("r2"), 4)}


def train(
    rows: DataFrame,
    skills: Sequence[str],
    model_type: str = "ridge",
    *,
    test_size: float = 0.2,
    trees: int = 100,
    alpha: float = 1.0,
    min_rows: int = MIN_ROWS,
) -> tuple[PipelineModel | None, dict]:
    """Fit features and model on the training part, measure on the rest. Skips below ``min_rows`` rows; ``alpha`` is the ridge penalty."""
    rows = staged(rows, "model-rows")  # read by every pass of the fit and the metrics
    total = rows.count()
    if total < min_rows:
        return None, {"status": "skipped", "reason": "insufficient_data", "rows": total}
    train_rows, test_rows = split_rows(rows, "job_id", test_size)
    strength = ridge_strength(train_rows, alpha) if model_type == "ridge" else 0.0
    model = Pipeline(stages=[*feature_pipeline(skills).getStages(), regressor(model_type, trees, strength)]).fit(train_rows)
    test_count = test_rows.count()
    metrics = evaluate(model.transform(test_rows)) | {
        "train_size": total - test_count,
        "test_size": test_count,
    }
    return model, {"status": "trained", "model_type": model_type, **metrics}


def save_model(
    spark: SparkSession,
    model: PipelineModel,
    root: str,
    metrics: Mapping,
    feature_names: Sequence[str],
    run_id: str | None = None,
) -> str:
    """Store a model and its metadata under a run id; the metadata is written last."""
    run_id = run_id or str(uuid.uuid4())
    model.write().save(f"{root}/{run_id}/model")
    meta = (
        run_id,
        metrics.get("model_type"),
        json.dumps(dict(metrics)),
        list(feature_names),
        datetime.now(timezone.utc),
    )
    spark.createDataFrame([meta], _META).write.json(f"{root}/{run_id}/meta")
    return run_id


_META = (
    "run_id string, model_type string, metrics string, feature_names array<string>, saved_at timestamp"
)


def saved_models(spark: SparkSession, root: str) -> DataFrame:
    paths = files.matching(spark, f"{root}/*/meta")
    return spark.read.schema(_META).json(paths) if paths else spark.createDataFrame([], _META)


def load_model(spark: SparkSession, root: str, run_id: str | None = None) -> PipelineModel | None:
    """The model of a run, or the newest one; None when there is none."""
    known = saved_models(spark, root)
    if run_id is not None:
        known = known.filter(F.col("run_id") == run_id)
    newest = known.orderBy(F.desc("saved_at")).head()
    return PipelineModel.load(f"{root}/{newest.run_id}/model") if newest else None
