"""Scalar functions and row-wise projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeflow.catalog.readings import CALENDAR_SQL, aqi_sql, events, features_sql, readings, readings_raw, with_sql
from hazeflow.catalog.registry import query
from hazeflow.functions import projections as P
from hazeflow.functions import scalars as S
from hazeflow.operators import lookups
from hazeflow.operators.stats import exceedance_hours
from hazeflow.plans.features import build_features
from hazeflow.schemas import FEATURE_COLUMNS, FEATURE_SCHEMA

# Each event's time as text in one of five styles, chosen by k: no offset, Z, two offsets, garbage.
_TEXTS_SQL = """texts AS (
  SELECT event_id, ts, k % 5 AS style,
    CASE k % 5 WHEN 4 THEN 'n/a ' || event_id
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'Z' WHEN 2 THEN '+05:00' ELSE '-0330' END
    END AS written
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def _texts(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    style = F.get_json_object("props", "$.k").cast("int") % 5
    suffix = F.when(style == 0, "").when(style == 1, "Z").when(style == 2, "+05:00").otherwise("-0330")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), suffix)
    bad = F.concat(F.lit("n/a "), F.col("event_id").cast("string"))
    return ev.select("event_id", F.when(style == 4, bad).otherwise(iso).alias("written"))


@query(
    "sc1_parse_ts",
    with_sql(
        _TEXTS_SQL,
        select="""SELECT event_id, written, CASE style WHEN 0 THEN ts WHEN 1 THEN ts WHEN 2 THEN ts - INTERVAL 5 HOUR
          WHEN 3 THEN ts + INTERVAL 210 MINUTE END AS parsed FROM texts""",
    ),
)
def sc1_parse_ts(spark, sf_dir):
    return _texts(spark, sf_dir).withColumn("parsed", S.parse_ts(F.col("written")))


@query(
    "sc2_time_features",
    with_sql(
        _TEXTS_SQL,
        select=f"SELECT event_id, {CALENDAR_SQL} FROM (SELECT event_id, CASE WHEN style < 4 THEN ts END AS fetched_at FROM texts)".replace(
            "(CASE WHEN isodow(fetched_at) >= 6 THEN 1 ELSE 0 END)", "(CASE WHEN isodow(fetched_at) >= 6 THEN 1 WHEN fetched_at IS NOT NULL THEN 0 END)"
        ).replace("ELSE 'autumn' END", "WHEN fetched_at IS NOT NULL THEN 'autumn' END"),
    ),
)
def sc2_time_features(spark, sf_dir):
    """Calendar columns follow the clock written in the text, whatever its offset."""
    clock = S.wall_clock(F.col("written"))
    return _texts(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in S.time_features(clock).items()])


@query(
    "sc3_season",
    """SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring'
       WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season FROM orders""",
)
def sc3_season(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", S.season(F.month("o_orderdate")).alias("season"))


@query("sc4_pm25_to_aqi", f"SELECT event_id, value, {aqi_sql()} AS aqi FROM (SELECT *, printf('%.1f', value)::DOUBLE AS c FROM events)")
def sc4_pm25_to_aqi(spark, sf_dir):
    ev = events(spark, sf_dir)
    return ev.select("event_id", "value", S.pm25_to_aqi(F.col("value")).alias("aqi"))


_BANDS = [(0.0, 10.0, 0, 10), (10.0, 100.0, 10, 60), (100.0, 600.0, 60, 100)]


@query(
    "j5_aqi_breakpoint_lookup",
    """SELECT event_id, round(CASE WHEN value >= 0 AND value <= 10 THEN (10::DOUBLE / 10) * value
        WHEN value <= 100 THEN (50::DOUBLE / 90) * (value - 10) + 10
        WHEN value <= 600 THEN (40::DOUBLE / 500) * (value - 100) + 60 END, 6) AS band_index
       FROM events""",
)
def j5_aqi_breakpoint_lookup(spark, sf_dir):
    """Band interpolation with a band table of the caller's."""
    ev = events(spark, sf_dir)
    return ev.select("event_id", F.round(S.band_lookup(F.col("value"), _BANDS), 6).alias("band_index"))


_SUPPLIER_BANDS = """SELECT (s_suppkey - 1) * 2.5::DOUBLE AS low, (s_suppkey - 1) * 2.5::DOUBLE + CASE WHEN s_suppkey % 50 = 0 THEN 100 ELSE 1 + s_suppkey % 3 END AS high,
  s_nationkey AS index_low, s_nationkey + 10 AS index_high FROM supplier"""


@query(
    "j5_band_table",
    f"""WITH bands AS ({_SUPPLIER_BANDS}),
    ranked AS (SELECT event_id, value, b.*, row_number() OVER (PARTITION BY event_id ORDER BY low NULLS LAST, high, index_low) AS place
      FROM events LEFT JOIN bands b ON value BETWEEN low AND high)
    SELECT event_id, round((index_high - index_low)::DOUBLE / (high - low) * (value - low) + index_low, 6) AS band_index FROM ranked WHERE place = 1""",
)
def j5_band_table(spark, sf_dir):
    """Every event's place in a table of bands, one for each supplier, with overlaps and gaps."""
    start = (F.col("s_suppkey") - 1) * 2.5
    width = F.when(F.col("s_suppkey") % 50 == 0, 100).otherwise(1 + F.col("s_suppkey") % 3)
    bands = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        start.alias("low"), (start + width).alias("high"), F.col("s_nationkey").alias("index_low"), (F.col("s_nationkey") + 10).alias("index_high")
    )
    found = lookups.band_join(events(spark, sf_dir).select("event_id", "value"), "value", bands)
    return found.select("event_id", F.round("band_index", 6).alias("band_index"))


@query(
    "sc5_pm_ratio",
    with_sql(select="SELECT city, fetched_at, CASE WHEN pm10 > 0 THEN printf('%.4f', pm25 / pm10)::DOUBLE END AS pm25_pm10_ratio FROM readings_raw"),
)
def sc5_pm_ratio(spark, sf_dir):
    ratio = S.pm_ratio(F.col("pm25"), F.col("pm10"))
    return readings_raw(spark, sf_dir).select("city", "fetched_at", ratio.alias("pm25_pm10_ratio"))


CATEGORY_SQL = """CASE WHEN {0} IS NULL THEN 'Unknown' WHEN round_even({0}, 0) <= 50 THEN 'Good' WHEN round_even({0}, 0) <= 100 THEN 'Moderate'
  WHEN round_even({0}, 0) <= 150 THEN 'Unhealthy for Sensitive Groups' WHEN round_even({0}, 0) <= 200 THEN 'Unhealthy'
  WHEN round_even({0}, 0) <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END"""


@query("sc6_aqi_category", with_sql(select=f"SELECT city, fetched_at, {CATEGORY_SQL.format('aqi')} AS category FROM readings_raw"))
def sc6_aqi_category(spark, sf_dir):
    return readings_raw(spark, sf_dir).select("city", "fetched_at", S.aqi_category(F.col("aqi")).alias("category"))


@query(
    "sc7_category_color",
    with_sql(
        select=f"""SELECT city, fetched_at, CASE category WHEN 'Good' THEN '#00e400' WHEN 'Moderate' THEN '#ffff00'
          WHEN 'Unhealthy for Sensitive Groups' THEN '#ff7e00' WHEN 'Unhealthy' THEN '#ff0000' WHEN 'Very Unhealthy' THEN '#8f3f97'
          WHEN 'Hazardous' THEN '#7e0023' ELSE '#cccccc' END AS color, category NOT IN ('Good', 'Moderate', 'Unknown') AS light_text
          FROM (SELECT *, {CATEGORY_SQL.format('aqi')} AS category FROM readings_raw)"""
    ),
)
def sc7_category_color(spark, sf_dir):
    category = S.aqi_category(F.col("aqi"))
    return readings_raw(spark, sf_dir).select(
        "city", "fetched_at", S.category_color(category).alias("color"), S.light_text(category).alias("light_text")
    )


@query("sc8_forecast_ts", "SELECT event_id, ts + INTERVAL 72 HOUR AS forecast_timestamp FROM events")
def sc8_forecast_ts(spark, sf_dir):
    ev = events(spark, sf_dir)
    return ev.select("event_id", S.forecast_ts(F.col("ts").cast("timestamp")).alias("forecast_timestamp"))


@query(
    "sc9_day_name",
    "SELECT event_id, CASE WHEN n < 7 THEN dayname('2024-01-01'::DATE + n) ELSE CAST(n AS VARCHAR) END AS day_name FROM"
    " (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 9 AS n FROM events)",
)
def sc9_day_name(spark, sf_dir):
    ev = events(spark, sf_dir)
    n = F.get_json_object("props", "$.k").cast("int") % 9
    return ev.select("event_id", S.day_name(n).alias("day_name"))


@query(
    "sc10_display_row",
    with_sql(
        select=f"""SELECT city, strftime(fetched_at + INTERVAL 72 HOUR, '%a, %b %d - %I:%M %p') AS "time",
          round_even(pm25, 0)::INTEGER AS predicted_aqi, category,
          CASE category WHEN 'Good' THEN '#00e400' WHEN 'Moderate' THEN '#ffff00' WHEN 'Unhealthy for Sensitive Groups' THEN '#ff7e00'
            WHEN 'Unhealthy' THEN '#ff0000' WHEN 'Very Unhealthy' THEN '#8f3f97' ELSE '#7e0023' END AS color,
          category NOT IN ('Good', 'Moderate') AS light_text
          FROM (SELECT *, {CATEGORY_SQL.format('pm25')} AS category FROM readings_raw)"""
    ),
)
def sc10_display_row(spark, sf_dir):
    rows = readings_raw(spark, sf_dir).select(
        "city",
        S.forecast_ts(F.col("fetched_at")).alias("forecast_timestamp"),
        F.col("pm25").alias("predicted_aqi"),
        S.aqi_category(F.col("pm25")).alias("aqi_category"),
    )
    return P.display_row(rows)


@query("sc11_abs_error", with_sql(select="SELECT city, fetched_at, round(abs(pm25 - aqi), 6) AS abs_error FROM readings_raw"))
def sc11_abs_error(spark, sf_dir):
    error = S.abs_error(F.col("pm25"), F.col("aqi"))
    return readings_raw(spark, sf_dir).select("city", "fetched_at", F.round(error, 6).alias("abs_error"))


@query(
    "sc12_exceeds",
    with_sql(
        select="SELECT city, count(*) FILTER (aqi > 150) AS above_150, count(*) FILTER (aqi > 200) AS above_200,"
        " count(*) FILTER (aqi > 300) AS above_300 FROM readings_raw GROUP BY city"
    ),
)
def sc12_exceeds(spark, sf_dir):
    return exceedance_hours(readings_raw(spark, sf_dir))


_BLANK = [c for c in FEATURE_COLUMNS if c not in ("fetched_at", "city", "aqi", "pm25", "pm10", "o3", "no2", "so2", "co", "temperature", "humidity", "wind_speed", "pressure")]
_SQL_TYPES = {"double": "DOUBLE", "int": "INTEGER", "string": "VARCHAR"}
_BLANK_SQL = ", ".join(f"NULL::{_SQL_TYPES[FEATURE_SCHEMA[c].dataType.simpleString()]} AS {c}" for c in _BLANK)


@query("p1_conform_schema", with_sql(select=f"SELECT *, {_BLANK_SQL} FROM readings_raw"))
def p1_conform_schema(spark, sf_dir):
    return P.conform_schema(readings_raw(spark, sf_dir).withColumn("station_note", F.lit("extra")))


@query(
    "p3_coerce_numeric",
    with_sql(
        select="SELECT city, fetched_at, TRY_CAST(CASE WHEN so2 = 3 THEN '-' ELSE CAST(pm25 AS VARCHAR) END AS DOUBLE) AS pm25 FROM readings_raw"
    ),
)
def p3_coerce_numeric(spark, sf_dir):
    text = F.when(F.col("so2") == 3, "-").otherwise(F.col("pm25").cast("string"))
    return P.coerce_numeric(readings_raw(spark, sf_dir).select("city", "fetched_at", text.alias("pm25")), ["pm25"])


_MATRIX = [c for c in FEATURE_COLUMNS if c not in ("fetched_at", "city", "season", "target_aqi_3d")]


@query("p4_model_matrix", with_sql(features_sql(), select=f"SELECT {', '.join(_MATRIX)} FROM features"))
def p4_model_matrix(spark, sf_dir):
    return P.model_matrix(build_features(readings_raw(spark, sf_dir), unique=True))


@query("p5_drop_leaky", with_sql(select="SELECT * FROM readings_raw"))
def p5_drop_leaky(spark, sf_dir):
    flags = {"Is_Imputed_gap": F.col("aqi").isNull(), "pm25_outlier": F.col("pm25") > 400, "imputed_pm10": F.col("pm10").isNull()}
    return P.drop_leaky(readings_raw(spark, sf_dir).withColumns(flags))


@query(
    "p6_drop_unmeasured",
    with_sql(
        select="SELECT city, fetched_at, aqi, pm25 FROM (SELECT * REPLACE (CASE WHEN so2 > 9 THEN pm25 END AS pm25) FROM readings_raw)"
        " WHERE aqi IS NOT NULL OR pm25 IS NOT NULL"
    ),
)
def p6_drop_unmeasured(spark, sf_dir):
    holes = readings_raw(spark, sf_dir).withColumn("pm25", F.when(F.col("so2") > 9, F.col("pm25")))
    return P.drop_unmeasured(holes).select("city", "fetched_at", "aqi", "pm25")


@query(
    "p7_recent_history",
    with_sql(
        select="SELECT * FROM readings_raw WHERE lower(city) = 'click' AND fetched_at >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 48 HOUR"
    ),
)
def p7_recent_history(spark, sf_dir):
    return P.recent_history(readings_raw(spark, sf_dir), "Click", "2024-01-20 12:00:00")


@query(
    "p9_nan_to_null",
    with_sql(select="SELECT city, fetched_at, CASE WHEN so2 <> 3 THEN pm25 END AS pm25, aqi FROM readings_raw"),
)
def p9_nan_to_null(spark, sf_dir):
    nan = F.when(F.col("so2") == 3, F.lit(float("nan"))).otherwise(F.col("pm25"))
    return P.nan_to_null(readings_raw(spark, sf_dir).select("city", "fetched_at", nan.alias("pm25"), "aqi"))


@query("p10_align_columns", with_sql(select="SELECT city, fetched_at, pm10, aqi, NULL::DOUBLE AS dew_point, pm25 FROM readings_raw"))
def p10_align_columns(spark, sf_dir):
    return P.align_columns(readings_raw(spark, sf_dir), ["pm10", "aqi", "dew_point", "pm25"], keep=["city", "fetched_at"])


