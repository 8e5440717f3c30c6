"""Audit, exploratory statistics, ordering and keyed-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeflow.catalog.readings import events, features_sql, readings, readings_raw, readings_user, with_sql
from hazeflow.catalog.registry import query
from hazeflow.operators import audit, keyed, stats
from hazeflow.plans.features import build_features
from hazeflow.schemas import FEATURE_SCHEMA, MEASURES, numeric_columns

_NUMERIC = numeric_columns(FEATURE_SCHEMA)


def _features(spark, sf_dir):
    return build_features(readings_raw(spark, sf_dir), unique=True)


def _rows(template: str, columns, table: str) -> str:
    return "\nUNION ALL ".join(template.format(c=c, i=i + 1, t=table) for i, c in enumerate(columns))


_FEATURE_NAMES = FEATURE_SCHEMA.fieldNames()


@query(
    "a1_null_audit",
    with_sql(
        features_sql(),
        select="SELECT *, null_pct > 30.0 AS needs_attention FROM ("
        + _rows(
            "SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count,"
            " printf('%.2f', (count(*) - count({c})) / count(*)::DOUBLE * 100.0::DOUBLE)::DOUBLE AS null_pct FROM {t}",
            _FEATURE_NAMES,
            "features",
        )
        + ")",
    ),
)
def a1_null_audit(spark, sf_dir):
    return audit.null_audit(_features(spark, sf_dir))


@query(
    "a2_coverage",
    with_sql(
        select="""SELECT *, least(100.0::DOUBLE, printf('%.2f', total_rows / greatest(expected_slots, 1)::DOUBLE * 100.0::DOUBLE)::DOUBLE) AS completeness_pct
        FROM (SELECT city, count(*) AS total_rows, min(fetched_at) AS start_at, max(fetched_at) AS end_at,
          floor((epoch_us(max(fetched_at)) - epoch_us(min(fetched_at))) / 1e6::DOUBLE / 3600.0::DOUBLE)::BIGINT + 1 AS expected_slots
          FROM readings GROUP BY city)"""
    ),
)
def a2_coverage(spark, sf_dir):
    return audit.coverage(readings(spark, sf_dir))


def _gaps_sql(table: str) -> str:
    return with_sql(
        select=f"""SELECT city, prev AS gap_start, fetched_at AS gap_end, printf('%.2f', h)::DOUBLE AS gap_hours,
          greatest(1, round_even(printf('%.1f', h - 1.0::DOUBLE)::DOUBLE, 0)::INTEGER) AS missing_slots
        FROM (SELECT *, (epoch_us(fetched_at) - epoch_us(prev)) / 1e6::DOUBLE / 3600.0::DOUBLE AS h
          FROM (SELECT city, fetched_at, lag(fetched_at) OVER (PARTITION BY city ORDER BY fetched_at) AS prev FROM {table}))
        WHERE h >= 1.5"""
    )


@query("w5_find_gaps", _gaps_sql("readings"))
def w5_find_gaps(spark, sf_dir):
    return audit.find_gaps(readings(spark, sf_dir))


@query("w5_find_gaps_stations", _gaps_sql("readings_user"))
def w5_find_gaps_stations(spark, sf_dir):
    return audit.find_gaps(readings_user(spark, sf_dir))


@query(
    "j4_missing_dates",
    with_sql(
        select="""SELECT c.city, d.date FROM (SELECT DISTINCT city FROM readings_user) c,
          (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY))::DATE AS date) d
        EXCEPT SELECT city, fetched_at::DATE FROM readings_user"""
    ),
)
def j4_missing_dates(spark, sf_dir):
    return audit.missing_dates(readings_user(spark, sf_dir), "2023-12-25", "2024-02-05")


@query(
    "u2_date_difference",
    with_sql(
        select="""SELECT c.city, d.date FROM (SELECT DISTINCT city FROM readings) c,
          (SELECT unnest(generate_series(DATE '2023-12-31', DATE '2024-02-01', INTERVAL 1 DAY))::DATE AS date) d
        EXCEPT SELECT city, fetched_at::DATE FROM readings"""
    ),
)
def u2_date_difference(spark, sf_dir):
    """Calendar minus dates seen, on the hourly readings."""
    return audit.missing_dates(readings(spark, sf_dir), "2023-12-31", "2024-02-01")


_STATS_ORDER = [c for c in audit.SUMMARY_FIRST if c in _NUMERIC] + [c for c in _NUMERIC if c not in audit.SUMMARY_FIRST]


@query(
    "a3_summary_stats",
    with_sql(
        features_sql(),
        select=_rows(
            "SELECT {i}::INTEGER AS position, '{c}' AS column_name, count({c}) AS count, round_even(avg({c}::DOUBLE) * 100, 0) / 100 AS mean,"
            " round_even(stddev_samp({c}::DOUBLE) * 100, 0) / 100 AS std, round_even(min({c}::DOUBLE) * 100, 0) / 100 AS min,"
            " round_even(quantile_cont({c}::DOUBLE, 0.25) * 100, 0) / 100 AS p25, round_even(quantile_cont({c}::DOUBLE, 0.5) * 100, 0) / 100 AS p50,"
            " round_even(quantile_cont({c}::DOUBLE, 0.75) * 100, 0) / 100 AS p75, round_even(max({c}::DOUBLE) * 100, 0) / 100 AS max FROM {t}",
            _STATS_ORDER,
            "features",
        ),
    ),
)
def a3_summary_stats(spark, sf_dir):
    return audit.summary_stats(_features(spark, sf_dir))


_CORR = [c for c in _NUMERIC if c not in ("target_aqi_3d",)]


def _r_sql(x: str, y: str) -> str:
    r = f"corr({x}::DOUBLE, {y}::DOUBLE)"
    return f"CASE WHEN NOT isnan({r}) THEN round({r}, 6) END"


@query(
    "a7_correlation_matrix",
    with_sql(
        features_sql(),
        select="\nUNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, {_r_sql(x, y)} AS r FROM features" for x in MEASURES for y in MEASURES),
    ),
)
def a7_correlation_matrix(spark, sf_dir):
    return stats.correlation_matrix(_features(spark, sf_dir), MEASURES).withColumn("r", F.round("r", 6))


@query(
    "a7_correlation_matrix_all",
    with_sql(
        features_sql(),
        "nums AS MATERIALIZED (SELECT * FROM features)",
        select="\nUNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, {_r_sql(x, y)} AS r FROM nums" for x in _CORR for y in _CORR),
    ),
)
def a7_correlation_matrix_all(spark, sf_dir):
    return stats.correlation_matrix(_features(spark, sf_dir), _CORR).withColumn("r", F.round("r", 6))


@query(
    "o4_top_correlated",
    with_sql(
        features_sql(),
        select="SELECT feature, round(r, 6) AS r, round(abs(r), 6) AS magnitude FROM ("
        + "\nUNION ALL ".join(f"SELECT '{x}' AS feature, corr({x}::DOUBLE, aqi) AS r FROM features" for x in _CORR if x != "aqi")
        + ") WHERE NOT isnan(r) ORDER BY abs(r) DESC LIMIT 5",
    ),
)
def o4_top_correlated(spark, sf_dir):
    top = stats.top_correlated(_features(spark, sf_dir), 5)
    return top.select("feature", F.round("r", 6).alias("r"), F.round("magnitude", 6).alias("magnitude"))


def _box_sql(by: str) -> str:
    return with_sql(
        features_sql(),
        f"""q AS (SELECT {by}, count(*) AS n, avg(aqi) AS mean, quantile_cont(aqi, 0.25) AS p25, quantile_cont(aqi, 0.5) AS p50,
          quantile_cont(aqi, 0.75) AS p75 FROM features WHERE aqi IS NOT NULL GROUP BY 1)""",
        select=f"""SELECT q.{by}, any_value(n) AS n, round(any_value(mean), 6) AS mean, any_value(p25) AS p25, any_value(p50) AS p50,
          any_value(p75) AS p75,
          least(min(aqi) FILTER (aqi >= p25 - 1.5 * (p75 - p25)), any_value(p25)) AS whisker_low,
          greatest(max(aqi) FILTER (aqi <= p75 + 1.5 * (p75 - p25)), any_value(p75)) AS whisker_high,
          count(*) FILTER (aqi < p25 - 1.5 * (p75 - p25) OR aqi > p75 + 1.5 * (p75 - p25)) AS outliers
        FROM features f JOIN q ON f.{by} = q.{by} WHERE aqi IS NOT NULL GROUP BY q.{by}""",
    )


def _box_query(name: str, by: str):
    @query(name, _box_sql(by))
    def run(spark, sf_dir):
        return stats.box_stats(_features(spark, sf_dir), by).withColumn("mean", F.round("mean", 6))


_box_query("a8_box_stats_hour", "hour")
_box_query("a8_box_stats_weekday", "day_of_week")
_box_query("a8_box_stats_month", "month")
_box_query("a8_box_stats_season", "season")


@query(
    "a9_choose_season_axis",
    with_sql(
        features_sql(),
        select="""SELECT count(DISTINCT month) AS months, count(DISTINCT season) AS seasons,
          CASE WHEN count(DISTINCT month) > 1 THEN 'month' WHEN count(DISTINCT season) > 1 THEN 'season' ELSE 'histogram' END AS axis FROM features""",
    ),
)
def a9_choose_season_axis(spark, sf_dir):
    return stats.season_axis(_features(spark, sf_dir))


@query(
    "a9_seasonal_profile",
    with_sql(select="SELECT floor(aqi / 50) * 50.0::DOUBLE AS bin_start, count(*) AS n FROM readings_raw WHERE aqi IS NOT NULL GROUP BY 1"),
)
def a9_seasonal_profile(spark, sf_dir):
    """One month of data, so the histogram is chosen."""
    return stats.seasonal_profile(_features(spark, sf_dir))


@query(
    "a10_linear_trend",
    with_sql(
        select=_rows(
            "SELECT '{c}' AS x, round(regr_slope(aqi, {c}), 6) AS slope, round(regr_intercept(aqi, {c}), 6) AS intercept,"
            " round(regr_r2(aqi, {c}), 6) AS r2, regr_count(aqi, {c})::BIGINT AS n FROM {t}",
            ["pm25", "pm10", "wind_speed"],
            "readings_raw",
        )
    ),
)
def a10_linear_trend(spark, sf_dir):
    trend = stats.linear_trend(readings_raw(spark, sf_dir), ["pm25", "pm10", "wind_speed"])
    return trend.withColumns({c: F.round(c, 6) for c in ("slope", "intercept", "r2")})


@query("o1_chronological", with_sql(select="SELECT * FROM readings_raw ORDER BY city, fetched_at"))
def o1_chronological(spark, sf_dir):
    return keyed.chronological(readings_raw(spark, sf_dir))


_NEWEST = "row_number() OVER (PARTITION BY city ORDER BY fetched_at DESC)"


@query("o2_latest_row", with_sql(select=f"SELECT * FROM readings_user QUALIFY {_NEWEST} = 1"))
def o2_latest_row(spark, sf_dir):
    return keyed.latest_row(readings_user(spark, sf_dir))


@query("o3_last_n", with_sql(select=f"SELECT * FROM readings_raw QUALIFY {_NEWEST} <= 48"))
def o3_last_n(spark, sf_dir):
    return keyed.last_n(readings_raw(spark, sf_dir), 48)


@query("o6_preview", with_sql(select="SELECT * FROM readings_raw ORDER BY fetched_at, city LIMIT 3"))
def o6_preview(spark, sf_dir):
    return keyed.preview(readings_raw(spark, sf_dir), 3, ["fetched_at", "city"])


@query(
    "o6_preview_gaps",
    "SELECT greatest(count(*) - 10, 0) AS remaining FROM (" + _gaps_sql("readings") + ")",
)
def o6_preview_gaps(spark, sf_dir):
    """How many gaps follow the first ten shown."""
    return keyed.preview_rest(audit.find_gaps(readings(spark, sf_dir)), 10)


@query(
    "w9_keep_last",
    with_sql(
        select="""SELECT city, fetched_at, arg_max(pm25, event_id) AS pm25, max(event_id) AS event_id FROM
          (SELECT event_type AS city, date_trunc('day', ts) AS fetched_at, value AS pm25, event_id FROM events) GROUP BY 1, 2"""
    ),
)
def w9_keep_last(spark, sf_dir):
    ev = events(spark, sf_dir)
    day = F.date_trunc("DAY", F.col("ts").cast("timestamp"))
    writes = ev.select(F.col("event_type").alias("city"), day.alias("fetched_at"), F.col("value").alias("pm25"), "event_id")
    return keyed.keep_last(writes, order=["event_id"])


@query(
    "u1_append",
    with_sql(
        select="""SELECT city, fetched_at, pm25, NULL::DOUBLE AS aqi, 0 AS _seq FROM readings
          UNION ALL SELECT city, fetched_at, pm25, aqi, 1 FROM readings_raw"""
    ),
)
def u1_append(spark, sf_dir):
    old = readings(spark, sf_dir).select("city", "fetched_at", "pm25")
    new = readings_raw(spark, sf_dir).select("city", "fetched_at", "pm25", "aqi")
    return keyed.append(old, new).select("city", "fetched_at", "pm25", "aqi", "_seq")
