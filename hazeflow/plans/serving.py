"""Three-day forecasts and explanations from recent feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazeflow.functions import scalars as S
from hazeflow.functions.projections import drop_null_prediction
from hazeflow.models.explain import linear_attribution, model_weights
from hazeflow.models.regressors import Matrix, score
from hazeflow.operators.keyed import latest_row
from hazeflow.operators.lookups import forecast_horizons
from hazeflow.operators.preparing import apply_imputer

SERVING_HOURS = 120


def with_category(predicted: DataFrame) -> DataFrame:
    return drop_null_prediction(predicted).withColumn("aqi_category", S.aqi_category(F.col("predicted_aqi")))


def forecast(model, matrix: Matrix, recent: DataFrame) -> DataFrame:
    """city, forecast_timestamp, predicted_aqi, aqi_category for the next three days."""
    return with_category(forecast_horizons(score(model, matrix, recent)))


def current_state(recent: DataFrame) -> DataFrame:
    """The newest reading of each city with its category."""
    return latest_row(recent.select("city", "fetched_at", "aqi")).select(
        "city", "fetched_at", F.col("aqi").alias("current_aqi"), S.aqi_category(F.col("aqi")).alias("current_aqi_category")
    )


def explain_latest(model, matrix: Matrix, recent: DataFrame) -> DataFrame:
    """city, feature, importance: effects on the latest prediction of a linear model, a forest's importances otherwise."""
    if not hasattr(model, "coefficients"):
        weights = zip(matrix.names, model.featureImportances.toArray())
        effects = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(float(w)).alias("importance")) for c, w in weights])
        return recent.select("city").distinct().select("city", F.inline(effects)).orderBy("city", F.desc("importance"), "feature")
    filled = apply_imputer(recent.select("city", "fetched_at", *matrix.names), matrix.medians)
    return linear_attribution(filled, model_weights(model, matrix.names))
