"""Window, as-of and feature-row queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeflow.catalog.readings import (
    asof_sql,
    features_sql,
    mean_sql,
    rate_sql,
    readings,
    readings_raw,
    readings_user,
    with_sql,
)
from hazeflow.catalog.registry import query
from hazeflow.operators import lookback as L
from hazeflow.plans.features import build_features
from hazeflow.schemas import FEATURE_COLUMNS

_ALL = ", ".join(FEATURE_COLUMNS)


@query("p2_build_features", with_sql(features_sql("readings"), select=f"SELECT {_ALL} FROM features"))
def p2_build_features(spark, sf_dir):
    return build_features(readings(spark, sf_dir), unique=True)


@query("p2_build_features_raw", with_sql(features_sql("readings_raw"), select=f"SELECT {_ALL} FROM features"))
def p2_build_features_raw(spark, sf_dir):
    return build_features(readings_raw(spark, sf_dir))


@query("p2_build_features_stations", with_sql(features_sql("readings_user"), select=f"SELECT {_ALL} FROM features"))
def p2_build_features_stations(spark, sf_dir):
    return build_features(readings_user(spark, sf_dir))


def _mean_query(name, spec):
    sql = with_sql(select=f"SELECT r.city, r.fetched_at, {mean_sql(int(spec.hours))} AS {spec.name} FROM readings_raw r")

    @query(name, sql)
    def run(spark, sf_dir):
        return L.rolling_mean(readings_raw(spark, sf_dir), spec).select("city", "fetched_at", spec.name)


_mean_query("w1_rolling_mean_6h", L.ROLLING_6H)
_mean_query("w2_rolling_mean_24h", L.ROLLING_24H)


def _nearest_query(hours, tolerance, hours_sql, tolerance_sql):
    sql = with_sql(
        asof_sql("readings_raw", hours_sql, tolerance_sql, "near"),
        select="SELECT r.city, r.fetched_at, n.past_at, n.past_aqi FROM readings_raw r"
        " LEFT JOIN near n ON r.city = n.city AND r.fetched_at = n.fetched_at",
    )

    @query(f"j2_asof_nearest_{hours}h", sql)
    def run(spark, sf_dir):
        found = L.asof_nearest(readings_raw(spark, sf_dir), hours, tolerance)
        return found.select("city", "fetched_at", "past_at", "past_aqi")


_nearest_query(1, 0.5, "1 HOUR", "30 MINUTE")
_nearest_query(24, 2, "24 HOUR", "2 HOUR")


def _rate_query(query_name, spec, name, hours_sql, tolerance_sql):
    sql = with_sql(
        asof_sql("readings_raw", hours_sql, tolerance_sql, "near"),
        select=f"SELECT r.city, r.fetched_at, {rate_sql('n.past_aqi')} AS {name} FROM readings_raw r"
        " LEFT JOIN near n ON r.city = n.city AND r.fetched_at = n.fetched_at",
    )

    @query(query_name, sql)
    def run(spark, sf_dir):
        return L.change_rate(readings_raw(spark, sf_dir), spec, name).select("city", "fetched_at", name)


_rate_query("w3_change_rate_1h", L.PAST_1H, "aqi_change_rate_1h", "1 HOUR", "30 MINUTE")
_rate_query("w4_change_rate_24h", L.PAST_24H, "aqi_change_rate_24h", "24 HOUR", "2 HOUR")


@query(
    "w12_derived_overlay",
    with_sql(
        features_sql(),
        select="SELECT city, fetched_at, aqi, aqi_rolling_mean_6h, aqi_rolling_mean_24h, aqi_change_rate_24h FROM features",
    ),
)
def w12_derived_overlay(spark, sf_dir):
    return L.derived_overlay(readings_raw(spark, sf_dir), unique=True)


@query("w1_w4_narrow_buckets", with_sql(features_sql("readings_raw"), select=f"SELECT {_ALL} FROM features"))
def w1_w4_narrow_buckets(spark, sf_dir):
    """Feature rows with five-hour buckets, as for very dense series; every look-back crosses several."""
    return build_features(readings_raw(spark, sf_dir), width_hours=5)


_OUTLIERS = """
WITH series AS (
  SELECT event_type AS city, ts AS fetched_at,
         CASE WHEN max(event_id) % 97 = 0 THEN 1e17 ELSE floor(max_by(value, event_id) * 8) / 8 END AS aqi
  FROM events GROUP BY 1, 2)
"""


@query(
    "w1_outlier_series",
    _OUTLIERS
    + """SELECT city, fetched_at,
       CASE WHEN count(*) OVER w >= 3 THEN printf('%.2f', avg(aqi) OVER w)::DOUBLE END AS aqi_rolling_mean_6h
FROM series WINDOW w AS (PARTITION BY city ORDER BY fetched_at RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)
QUALIFY max(aqi) OVER w < 1e17""",
)
def w1_outlier_series(spark, sf_dir):
    """Means beside readings of 1e17, of the windows that hold none of them: as if those were not there."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("_outlier_events")
    series = spark.sql(_OUTLIERS.replace("FROM events", "FROM _outlier_events") + "SELECT * FROM series")
    series = series.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    found = L.look_back(series, [L.ROLLING_6H, L.RollingMax(6, "_top")], unique=True)
    top = F.when(F.col("fetched_at").isNull(), F.col("aqi")).otherwise(F.col("_top"))  # a row without a time is its own window
    return found.filter(top < 1e17).select("city", "fetched_at", "aqi_rolling_mean_6h")
