"""Historical payloads to feature rows in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hazeflow.functions.projections import drop_unmeasured
from hazeflow.operators.audit import missing_dates
from hazeflow.operators.lookups import attach_weather
from hazeflow.plans.features import build_features
from hazeflow.sources.payloads import parse_aqicn_history, parse_pollution_history, parse_weather_history


def backfill_features(pollution_payloads: DataFrame, weather_payloads: DataFrame, **options) -> DataFrame:
    """Pollution history joined with weather of the same instant, unmeasured rows dropped, features added."""
    readings = attach_weather(parse_pollution_history(pollution_payloads), parse_weather_history(weather_payloads))
    return build_features(drop_unmeasured(readings), **options)


def feed_history_features(feed_payloads: DataFrame, **options) -> DataFrame:
    """Features from feed payloads that carry a history of their own."""
    return build_features(parse_aqicn_history(feed_payloads), **options)


def skipped_dates(pollution_payloads: DataFrame, start: str, end: str) -> DataFrame:
    return missing_dates(parse_pollution_history(pollution_payloads), start, end)
