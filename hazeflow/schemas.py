"""Column lists and declared schemas."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["city", "fetched_at"]

# Column names and their order in the stored tables.
POLLUTANTS = ["pm25", "pm10", "o3", "no2", "so2", "co"]
WEATHER = ["temperature", "humidity", "wind_speed", "pressure"]
CALENDAR = ["hour", "day_of_week", "day_of_month", "month", "is_weekend"]
DERIVED = [
    "aqi_change_rate_1h",
    "aqi_change_rate_24h",
    "aqi_rolling_mean_6h",
    "aqi_rolling_mean_24h",
    "pm25_pm10_ratio",
]
LABEL = "target_aqi_3d"

MEASURES = ["aqi", *POLLUTANTS, *WEATHER]


def _double(names):
    return [T.StructField(n, T.DoubleType()) for n in names]


_KEY_FIELDS = [T.StructField("fetched_at", T.TimestampType()), T.StructField("city", T.StringType())]

SNAPSHOT_SCHEMA = T.StructType(_KEY_FIELDS + _double(MEASURES))

FEATURE_SCHEMA = T.StructType(
    _KEY_FIELDS
    + _double(MEASURES)
    + [T.StructField(n, T.IntegerType()) for n in CALENDAR]
    + [T.StructField("season", T.StringType())]
    + _double([*DERIVED, LABEL])
)

FEATURE_COLUMNS = FEATURE_SCHEMA.fieldNames()

PREDICTION_LOG_SCHEMA = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("forecast_timestamp", T.TimestampType()),
        T.StructField("predicted_aqi", T.DoubleType()),
        T.StructField("actual_aqi", T.DoubleType()),
        T.StructField("model_version", T.StringType()),
    ]
)

METRICS_SCHEMA = T.StructType(
    [T.StructField("model_name", T.StringType())]
    + _double(["rmse", "mae", "r2"])
    + [T.StructField("beats_persistence", T.BooleanType())]
)

NUMERIC_TYPES = (T.NumericType,)


def numeric_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def float_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
