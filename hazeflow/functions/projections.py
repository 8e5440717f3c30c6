"""Row-wise table projections and filters; none of them shuffles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from hazeflow.functions import scalars as S
from hazeflow.schemas import FEATURE_SCHEMA, LABEL, float_columns, numeric_columns

# Name parts that mark data-quality columns.
LEAKY_PARTS = ["is_imputed", "outlier", "imputed_"]


def conform_schema(df: DataFrame, schema: StructType = FEATURE_SCHEMA) -> DataFrame:
    """Exactly the declared columns, in order; absent ones NULL, extras dropped."""
    have = dict(df.dtypes)
    columns = []
    for field in schema.fields:
        if field.name not in have:
            column = F.lit(None).cast(field.dataType)
        elif have[field.name] == field.dataType.simpleString():
            column = F.col(field.name)
        elif field.dataType.simpleString() == "timestamp" and have[field.name] == "string":
            column = S.parse_ts(F.col(field.name))
        else:
            column = F.col(field.name).try_cast(field.dataType)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text that is no number becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL for NaN in every floating column; column types stay."""
    types = dict(df.dtypes)
    columns = float_columns(df.schema)
    return df.withColumns({c: S.nan_as_null(F.col(c)).cast(types[c]) for c in columns}) if columns else df


def model_matrix(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Numeric feature columns only: label, key and text columns go."""
    return df.select(*feature_names(df, label))


def feature_names(df: DataFrame, label: str = LABEL) -> list[str]:
    return [c for c in numeric_columns(df.schema) if c not in (label, "fetched_at", "city", "season")]


def leaky_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(part in c.lower() for part in LEAKY_PARTS)]


def drop_leaky(df: DataFrame) -> DataFrame:
    return df.drop(*leaky_columns(df))


def drop_unmeasured(df: DataFrame) -> DataFrame:
    return df.filter(F.col("aqi").isNotNull() | F.col("pm25").isNotNull())


def align_columns(df: DataFrame, expected: list[str], keep: list[str] | None = None) -> DataFrame:
    """The fitted column list in its order; missing ones NULL, others dropped unless in `keep`."""
    kept = [F.col(c) for c in keep or []]
    aligned = [F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in expected]
    return df.select(*kept, *aligned)


def drop_null_label(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.filter(F.col(label).isNotNull())


def drop_null_prediction(df: DataFrame, prediction: str = "predicted_aqi") -> DataFrame:
    return df.filter(F.col(prediction).isNotNull())


def recent_history(df: DataFrame, city: str, now: datetime | str, hours: int = 48) -> DataFrame:
    """Readings of one city (any letter case) from `now - hours` on, oldest first."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")
    recent = df.filter((F.lower("city") == city.lower()) & (F.col("fetched_at") >= since))
    if "day" in df.columns:  # stored tables are partitioned by day: prune whole folders
        recent = recent.filter(F.col("day") >= F.to_date(since))
    return nan_to_null(recent).orderBy("fetched_at", F.xxhash64(*recent.columns))


def recent_predictions(log: DataFrame, now: datetime | str, days: int = 30) -> DataFrame:
    """Logged predictions from `now - days` on, oldest first."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    recent = log.filter(F.col("forecast_timestamp") >= since)
    if "day" in log.columns:
        recent = recent.filter(F.col("day") >= F.to_date(since))
    return recent.orderBy("forecast_timestamp", F.xxhash64(*recent.columns))


def display_row(forecast: DataFrame) -> DataFrame:
    """Forecast rows as shown to people: text time, whole AQI, category, colours."""
    return forecast.select(
        *[c for c in forecast.columns if c == "city"],
        S.display_time(F.col("forecast_timestamp")).alias("time"),
        F.bround("predicted_aqi", 0).cast("int").alias("predicted_aqi"),
        F.col("aqi_category").alias("category"),
        S.category_color(F.col("aqi_category")).alias("color"),
        S.light_text(F.col("aqi_category")).alias("light_text"),
    )
