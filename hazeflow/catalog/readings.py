"""Air-quality readings derived from the `events` table.

One event type stands for a city (or one user for a small station), the event value for
PM2.5, and the number `k` in `props` for everything else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazeflow.functions import scalars as S
from hazeflow.session import configure


EVENTS_DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.schema(EVENTS_DDL).parquet(f"{sf_dir}/events.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", k.alias("k"))


def _measures(base: DataFrame) -> DataFrame:
    k, pm25 = F.col("k"), F.col("value")
    return base.select(
        "fetched_at",
        "city",
        F.when(k % 17 != 0, S.pm25_to_aqi(pm25)).alias("aqi"),
        pm25.alias("pm25"),
        F.when(k % 10 != 3, pm25 + k).alias("pm10"),
        (k * F.lit(0.5)).alias("o3"),
        (20 + k % 50).cast("double").alias("no2"),
        (k % 25).cast("double").alias("so2"),
        (300 + 10 * k).cast("double").alias("co"),
        F.when(k % 3 != 0, (10 + k % 30).cast("double")).alias("temperature"),
        (30 + k % 60).cast("double").alias("humidity"),
        F.when(k % 10 != 0, (k % 80) / F.lit(10.0)).alias("wind_speed"),
        (1000 + k % 20).cast("double").alias("pressure"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event per city and hour: hourly cadence with gaps."""
    base = _events(spark, sf_dir).groupBy(
        F.col("event_type").alias("city"), F.date_trunc("HOUR", "ts").alias("fetched_at")
    )
    return _measures(base.agg(F.max_by("value", "event_id").alias("value"), F.max_by("k", "event_id").alias("k")))


def readings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event: irregular cadence."""
    return _measures(_events(spark, sf_dir).withColumnsRenamed({"event_type": "city", "ts": "fetched_at"}))


def readings_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event at its whole second, the last one of those that share city and second."""
    base = _events(spark, sf_dir).groupBy(
        F.col("event_type").alias("city"), F.date_trunc("SECOND", "ts").alias("fetched_at")
    )
    return _measures(base.agg(F.max_by("value", "event_id").alias("value"), F.max_by("k", "event_id").alias("k")))


def readings_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event, one sparse series per user."""
    city = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return _measures(_events(spark, sf_dir).withColumn("city", city).withColumnRenamed("ts", "fetched_at"))


_MEASURES_SQL = """
  SELECT fetched_at, city,
    CASE WHEN k % 17 <> 0 THEN ({aqi}) END AS aqi,
    value AS pm25,
    CASE WHEN k % 10 <> 3 THEN value + k END AS pm10,
    k * 0.5::DOUBLE AS o3,
    (20 + k % 50)::DOUBLE AS no2,
    (k % 25)::DOUBLE AS so2,
    (300 + 10 * k)::DOUBLE AS co,
    CASE WHEN k % 3 <> 0 THEN (10 + k % 30)::DOUBLE END AS temperature,
    (30 + k % 60)::DOUBLE AS humidity,
    CASE WHEN k % 10 <> 0 THEN (k % 80) / 10.0::DOUBLE END AS wind_speed,
    (1000 + k % 20)::DOUBLE AS pressure
  FROM (SELECT *, printf('%.1f', value)::DOUBLE AS c FROM {base})
"""


def aqi_sql(value: str = "value", c: str = "c") -> str:
    """US EPA index of `value`, with `c` the value rounded to one decimal."""
    bands = " ".join(
        f"WHEN {c} BETWEEN {lo}::DOUBLE AND {hi}::DOUBLE THEN round_even(({float(ih - il)}::DOUBLE / ({hi}::DOUBLE - {lo}::DOUBLE))"
        f" * ({c} - {lo}::DOUBLE) + {float(il)}::DOUBLE, 0)"
        for lo, hi, il, ih in S.PM25_BANDS
    )
    return f"CASE WHEN {value} < 0 THEN NULL {bands} WHEN {c} > 500.4::DOUBLE THEN 500.0::DOUBLE END"


_K_SQL = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

BASE_SQL = f"""
readings_hour AS (
  SELECT event_type AS city, date_trunc('hour', ts) AS fetched_at, arg_max(value, event_id) AS value,
         arg_max({_K_SQL}, event_id) AS k
  FROM events GROUP BY 1, 2),
readings_each AS (SELECT event_type AS city, ts AS fetched_at, value, {_K_SQL} AS k FROM events),
readings_person AS (SELECT 'u' || user_id AS city, ts AS fetched_at, value, {_K_SQL} AS k FROM events),
readings AS ({_MEASURES_SQL.format(aqi=aqi_sql(), base="readings_hour")}),
readings_raw AS ({_MEASURES_SQL.format(aqi=aqi_sql(), base="readings_each")}),
readings_user AS ({_MEASURES_SQL.format(aqi=aqi_sql(), base="readings_person")})
"""

SECOND_SQL = f"""readings_at_second AS (
  SELECT event_type AS city, date_trunc('second', ts) AS fetched_at, arg_max(value, event_id) AS value,
         arg_max({_K_SQL}, event_id) AS k
  FROM events GROUP BY 1, 2),
readings_second AS ({_MEASURES_SQL.format(aqi=aqi_sql(), base="readings_at_second")})"""

CALENDAR_SQL = """hour(fetched_at)::INTEGER AS hour, (isodow(fetched_at) - 1)::INTEGER AS day_of_week,
    day(fetched_at)::INTEGER AS day_of_month, month(fetched_at)::INTEGER AS month,
    (CASE WHEN isodow(fetched_at) >= 6 THEN 1 ELSE 0 END)::INTEGER AS is_weekend,
    CASE WHEN month(fetched_at) IN (12, 1, 2) THEN 'winter' WHEN month(fetched_at) IN (3, 4, 5) THEN 'spring'
         WHEN month(fetched_at) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season"""


def asof_sql(table: str, hours: str, tolerance: str, name: str) -> str:
    """Range join: nearest non-null reading around `hours` ago, the older one on a tie."""
    return f"""{name} AS (
  SELECT r.city, r.fetched_at,
         arg_min(h.aqi, [abs(epoch_us(r.fetched_at - INTERVAL {hours}) - epoch_us(h.fetched_at)), epoch_us(h.fetched_at)]) AS past_aqi,
         arg_min(h.fetched_at, [abs(epoch_us(r.fetched_at - INTERVAL {hours}) - epoch_us(h.fetched_at)), epoch_us(h.fetched_at)]) AS past_at
  FROM {table} r JOIN {table} h ON r.city = h.city AND h.aqi IS NOT NULL
   AND h.fetched_at BETWEEN r.fetched_at - INTERVAL {hours} - INTERVAL {tolerance}
                        AND r.fetched_at - INTERVAL {hours} + INTERVAL {tolerance}
  GROUP BY 1, 2)"""


def mean_sql(hours: int) -> str:
    over = f"OVER (PARTITION BY r.city ORDER BY r.fetched_at RANGE BETWEEN INTERVAL {hours} HOUR PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN r.aqi IS NOT NULL AND count(r.aqi) {over} >= 3 THEN printf('%.2f', avg(r.aqi) {over})::DOUBLE END"


def rate_sql(past: str) -> str:
    return f"CASE WHEN {past} > 0 THEN printf('%.4f', (r.aqi - {past}) / {past})::DOUBLE END"


def features_sql(table: str = "readings_raw", name: str = "features") -> str:
    """CTEs that end in the 25-column feature table of `table`."""
    return f"""{asof_sql(table, "1 HOUR", "30 MINUTE", name + "_1h")},
{asof_sql(table, "24 HOUR", "2 HOUR", name + "_24h")},
{name} AS (
  SELECT r.*, {CALENDAR_SQL.replace("fetched_at", "r.fetched_at")},
    {rate_sql("a.past_aqi")} AS aqi_change_rate_1h,
    {rate_sql("b.past_aqi")} AS aqi_change_rate_24h,
    {mean_sql(6)} AS aqi_rolling_mean_6h,
    {mean_sql(24)} AS aqi_rolling_mean_24h,
    CASE WHEN r.pm10 > 0 THEN printf('%.4f', r.pm25 / r.pm10)::DOUBLE END AS pm25_pm10_ratio,
    NULL::DOUBLE AS target_aqi_3d
  FROM {table} r
  LEFT JOIN {name}_1h a ON r.city = a.city AND r.fetched_at = a.fetched_at
  LEFT JOIN {name}_24h b ON r.city = b.city AND r.fetched_at = b.fetched_at)"""


def with_sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join([BASE_SQL.strip(), *ctes]) + "\n" + select
