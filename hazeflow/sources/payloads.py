"""Landed JSON payloads to snapshot rows.

Input rows hold the raw text in `payload` next to `city` (and `fetched_at` for current
readings). Each text is parsed once into a variant; a field of the wrong shape is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazeflow.functions import scalars as S
from hazeflow.schemas import MEASURES, POLLUTANTS, WEATHER

# Where the payloads keep each measure.
CURRENT_WEATHER_PATHS = {
    "temperature": "$.main.temp",
    "humidity": "$.main.humidity",
    "wind_speed": "$.wind.speed",
    "pressure": "$.main.pressure",
}
COMPONENT_PATHS = {c: f"$.components.{'pm2_5' if c == 'pm25' else c}" for c in POLLUTANTS}
HISTORY_LISTS = ["history", "daily", "series"]


def _get(v: Column, path: str, kind: str = "double") -> Column:
    return F.try_variant_get(v, path, kind)


def _number(v: Column, path: str) -> Column:
    return S.nan_as_null(_get(v, path))


def _parsed(payloads: DataFrame) -> DataFrame:
    return payloads.withColumn("_v", F.try_parse_json("payload"))


def _succeeded(v: Column) -> Column:
    return F.coalesce(_get(v, "$.status", "string") == "ok", F.lit(False))


def parse_aqicn_current(payloads: DataFrame, keep_failed: bool = False) -> DataFrame:
    """Air readings of payloads with status `ok`; with `keep_failed` the others stay as rows without measures.

    The status is tested on the parsed fields, behind a generator that no filter passes, so that a text is parsed once.
    """
    v = F.col("_v")
    measures = {"aqi": "$.data.aqi", **{c: f"$.data.iaqi.{c}.v" for c in POLLUTANTS}}
    found = F.array(F.struct(_succeeded(v).alias("_ok"), *[_number(v, path).alias(c) for c, path in measures.items()]))
    rows = _parsed(payloads).select("fetched_at", "city", F.inline(found))
    if keep_failed:
        return rows.select("fetched_at", "city", *[F.when(F.col("_ok"), F.col(c)).alias(c) for c in measures])
    return rows.filter("_ok").drop("_ok")


def parse_openweather_current(payloads: DataFrame) -> DataFrame:
    v = F.col("_v")
    measures = [_number(v, path).alias(c) for c, path in CURRENT_WEATHER_PATHS.items()]
    return _parsed(payloads).select("fetched_at", "city", *measures)


def parse_aqicn_history(payloads: DataFrame) -> DataFrame:
    """One row per item of the first non-empty list; `fetched_at` stays the payload's text."""
    v, item = F.col("_v"), F.col("_item")
    lists = [_get(v, f"$.data.{name}", "array<variant>") for name in HISTORY_LISTS]
    first = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    items = _parsed(payloads).select("city", F.explode(F.when(_succeeded(v), first)).alias("_item"))
    times = [_get(item, f"$.{name}", "string") for name in ("time", "timestamp")]
    written = F.coalesce(*[F.when(t != "", t) for t in times])
    rows = items.select(written.alias("fetched_at"), "city", *[_number(item, f"$.{c}").alias(c) for c in MEASURES])
    return rows.filter(F.col("fetched_at").isNotNull())


def _listed(payloads: DataFrame) -> DataFrame:
    """Items of `list` that carry a time, with that time as an instant."""
    items = _parsed(payloads).select("city", F.explode(_get(F.col("_v"), "$.list", "array<variant>")).alias("_item"))
    seconds = _get(F.col("_item"), "$.dt")
    return items.withColumn("fetched_at", F.timestamp_seconds(seconds)).filter(F.col("fetched_at").isNotNull())


def parse_pollution_history(payloads: DataFrame) -> DataFrame:
    """Hourly components; the index comes from PM2.5, weather stays NULL."""
    item = F.col("_item")
    rows = _listed(payloads).select("fetched_at", "city", *[_number(item, path).alias(c) for c, path in COMPONENT_PATHS.items()])
    return rows.select(
        "fetched_at",
        "city",
        S.pm25_to_aqi(F.col("pm25")).alias("aqi"),
        *POLLUTANTS,
        *[F.lit(None).cast("double").alias(c) for c in WEATHER],
    )


def parse_weather_history(payloads: DataFrame) -> DataFrame:
    item = F.col("_item")
    measures = [_number(item, path).alias(c) for c, path in CURRENT_WEATHER_PATHS.items()]
    return _listed(payloads).select("fetched_at", "city", *measures)
