"""Exact attribution of a linear model's latest prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazeflow.operators.keyed import last_n, latest_row

BACKGROUND_ROWS = 100


def linear_attribution(rows: DataFrame, weights: dict[str, float], background: int = BACKGROUND_ROWS) -> DataFrame:
    """abs(weight * (newest value - mean of the city's last rows)) per city and feature, largest first.

    `rows` are imputed; both sides keep at most `background` rows per city before they meet.
    """
    names = list(weights)
    slim = rows.select("city", "fetched_at", *[F.col(c).cast("double").alias(c) for c in names])
    means = last_n(slim, background).groupBy("city").agg(*[F.avg(c).alias(f"_mean_{c}") for c in names])
    newest = latest_row(slim).join(means, "city")
    effects = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.abs(F.lit(w) * (F.col(c) - F.col(f"_mean_{c}"))).alias("importance")) for c, w in weights.items()]
    )
    return newest.select("city", F.inline(effects)).orderBy("city", F.desc("importance"), "feature")


def model_weights(model, names: list[str]) -> dict[str, float]:
    return dict(zip(names, (float(w) for w in model.coefficients.toArray())))
