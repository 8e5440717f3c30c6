"""Regression quality, baselines, model ranking and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazeflow.schemas import LABEL

# Alert levels of the highest forecast, from the top.
ALERT_LEVELS = [(300, "hazardous"), (200, "very unhealthy"), (150, "unhealthy")]


def _metric_columns(y: str, p: str, prefix: str = "") -> list:
    both = F.col(y).isNotNull() & F.col(p).isNotNull()
    actual, error = F.when(both, F.col(y)), F.col(y) - F.col(p)
    sse, sst, n = F.sum(error * error), F.var_pop(actual) * F.count(actual), F.count(actual)
    r2 = F.when(n < 2, None).when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(sse, sst))
    return [
        F.sqrt(F.avg(error * error)).alias(f"{prefix}rmse"),
        F.avg(F.abs(error)).alias(f"{prefix}mae"),
        r2.alias(f"{prefix}r2"),
    ]


def regression_metrics(df: DataFrame, y: str, p: str, keys: list[str] | None = None) -> DataFrame:
    """RMSE, MAE and R2 of `p` against `y`, over all rows or per key."""
    return df.groupBy(*(keys or [])).agg(*_metric_columns(y, p))


def persistence_baseline(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Quality of predicting that the index stays as it is."""
    return regression_metrics(df, label, "aqi")


def _common_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows on which all sides can be scored; comparing errors needs one sample."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df


def evaluate(df: DataFrame, prediction: str, label: str = LABEL) -> DataFrame:
    """Model and persistence quality side by side, over the `n` rows that have both predictions and the label."""
    common = _common_rows(df, [label, prediction, "aqi"])
    sides = [*_metric_columns(label, prediction, "model_"), *_metric_columns(label, "aqi", "persistence_")]
    one = common.agg(F.count(F.lit(1)).alias("n"), *sides)
    return one.withColumn("improvement_rmse", F.col("persistence_rmse") - F.col("model_rmse")).withColumn(
        "beats_persistence", F.coalesce(F.col("model_rmse") < F.col("persistence_rmse"), F.lit(False))
    )


def compare_predictions(df: DataFrame, predictions: dict[str, str], label: str = LABEL) -> DataFrame:
    """Persistence and every model (name -> prediction column) as rows, all over the same `n` rows: those with the
    label and every prediction."""
    sides = {"Persistence": "aqi", **predictions}
    common = _common_rows(df, [label, *sides.values()])
    one = common.agg(F.count(F.lit(1)).alias("n"), *[c for i, p in enumerate(sides.values()) for c in _metric_columns(label, p, f"_{i}_")])
    base = F.col("_0_rmse")
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("model_name"),
                *[F.col(f"_{i}_{m}").alias(m) for m in ("rmse", "mae", "r2")],
                F.coalesce(F.col(f"_{i}_rmse") < base, F.lit(False)).alias("beats_persistence"),
                F.col("n"),
            )
            for i, name in enumerate(sides)
        ]
    )
    return one.select(F.inline(rows))


def within_tolerance(log: DataFrame, tolerance: float = 15, keys: list[str] | None = None) -> DataFrame:
    """Share (%) of predictions at most `tolerance` off; a missing side counts as a miss."""
    error = F.abs(F.col("predicted_aqi") - F.col("actual_aqi"))
    hit = F.when(error <= tolerance, 1.0).otherwise(0.0)
    return log.groupBy(*(keys or [])).agg((F.avg(hit) * 100).alias("within_pct"))


def rank_models(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy("rmse", "model_name")


def select_best(metrics: DataFrame) -> DataFrame:
    """The lowest RMSE among models that beat persistence; no row means: register none."""
    return rank_models(metrics.filter("beats_persistence")).limit(1)


def forecast_alert(forecast: DataFrame) -> DataFrame:
    """Alert level of each city's highest forecast."""
    top = forecast.groupBy("city").agg(F.max("predicted_aqi").alias("max_aqi"))
    chain = None
    for level, name in ALERT_LEVELS:
        hit = F.col("max_aqi") >= level
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return top.withColumn("alert", chain.otherwise("none"))


def top_features(importances: DataFrame, n: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)
