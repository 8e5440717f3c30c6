"""Payload parsing, joins of sources, tables on disk, keyed upserts and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeflow.catalog import training_queries as TQ
from hazeflow.catalog.readings import SECOND_SQL, aqi_sql, features_sql, readings, readings_raw, readings_second, with_sql
from hazeflow.catalog.registry import query
from hazeflow.operators import lookups
from hazeflow.plans.backfill import backfill_features
from hazeflow.plans.features import build_features
from hazeflow.schemas import FEATURE_COLUMNS, MEASURES, POLLUTANTS, WEATHER
from hazeflow.scratch import scratch_path
from hazeflow.sources import payloads, store, tables
from hazeflow.streaming.feature_stream import stream_features

_ALL = ", ".join(FEATURE_COLUMNS)


def _air_payloads(df):
    """Current air readings as text: failed ones, text instead of an index, a bare number for ozone."""
    def text(aqi, ozone):
        parts = [F.struct(F.col(c).alias("v")).alias(c) for c in POLLUTANTS if c != "o3"]
        data = F.struct(aqi.alias("aqi"), F.struct(*parts, ozone.alias("o3")).alias("iaqi"))
        return F.to_json(F.struct(F.when(F.col("so2") == 3, "error").otherwise("ok").alias("status"), data.alias("data")))

    whole = F.struct(F.col("o3").alias("v"))
    payload = (
        F.when(F.col("aqi").isNull(), text(F.lit("-"), whole))
        .when(F.col("so2") == 5, text(F.col("aqi"), F.lit(7)))
        .otherwise(text(F.col("aqi"), whole))
    )
    return df.select("city", "fetched_at", payload.alias("payload"))


def _weather_payloads(df):
    main = F.struct(F.col("temperature").alias("temp"), "humidity", "pressure")
    text = F.to_json(F.struct(main.alias("main"), F.struct(F.col("wind_speed").alias("speed")).alias("wind")))
    return df.select("city", "fetched_at", text.alias("payload"))


_AIR = """air AS (SELECT fetched_at, city, aqi, pm25, pm10, CASE WHEN aqi IS NULL OR so2 <> 5 THEN o3 END AS o3, no2, so2, co
  FROM readings_raw WHERE so2 <> 3)"""
_SKY = "sky AS (SELECT fetched_at, city, temperature, humidity, wind_speed, pressure FROM readings_raw)"


@query("so1_parse_aqicn_current", with_sql(_AIR, select="SELECT * FROM air"))
def so1_parse_aqicn_current(spark, sf_dir):
    return payloads.parse_aqicn_current(_air_payloads(readings_raw(spark, sf_dir)))


@query("so2_parse_openweather_current", with_sql(_SKY, select="SELECT * FROM sky"))
def so2_parse_openweather_current(spark, sf_dir):
    return payloads.parse_openweather_current(_weather_payloads(readings_raw(spark, sf_dir)))


_LANDED_AIR = "landed AS (SELECT fetched_at, city, " + ", ".join(
    f"CASE WHEN so2 <> 3{' AND (aqi IS NULL OR so2 <> 5)' if c == 'o3' else ''} THEN {c} END AS {c}" for c in ("aqi", *POLLUTANTS)
) + " FROM readings_raw)"


@query("so3_merge_snapshot", with_sql(_LANDED_AIR, _SKY, select="SELECT * FROM landed FULL JOIN (SELECT * FROM sky WHERE humidity > 45) s USING (fetched_at, city)"))
def so3_merge_snapshot(spark, sf_dir):
    """Air payloads fail for some rows, weather payloads are missing for others."""
    rows = readings_raw(spark, sf_dir)
    air = payloads.parse_aqicn_current(_air_payloads(rows), keep_failed=True)
    weather = payloads.parse_openweather_current(_weather_payloads(rows.filter("humidity > 45")))
    return lookups.merge_snapshot(air, weather)


def _daily(df, item, wrap, unit="DAY"):
    """One payload per city and day (at most 24 hourly items each), or per shorter `unit`."""
    listed = df.groupBy("city", F.date_trunc(unit, "fetched_at").alias("_day")).agg(F.collect_list(item).alias("_items"))
    return listed.select("city", F.to_json(wrap(F.col("_items"), F.dayofmonth("_day"))).alias("payload"))


@query(
    "so4_parse_aqicn_history",
    with_sql(
        select="SELECT strftime(fetched_at, '%Y-%m-%dT%H:%M:%S') || 'Z' AS fetched_at, city, "
        + ", ".join(MEASURES)
        + " FROM readings WHERE so2 <> 7"
    ),
)
def so4_parse_aqicn_history(spark, sf_dir):
    """Lists under three names, times under two; items without a time are skipped."""
    return payloads.parse_aqicn_history(_history_payloads(readings(spark, sf_dir)))


def _history_payloads(df, unit="DAY"):
    when = F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.struct(
        F.when((F.col("so2") != 7) & (F.col("so2") % 2 == 0), when).alias("time"),
        F.when(F.col("so2") != 7, when).alias("timestamp"),
        *MEASURES,
    )

    def wrap(items, day):
        empty = F.filter(items, lambda _: F.lit(False))
        data = F.struct(
            F.when(day % 3 == 0, items).otherwise(empty).alias("history"),
            F.when(day % 3 == 1, items).alias("daily"),
            F.when(day % 3 == 2, items).alias("series"),
        )
        return F.struct(F.lit("ok").alias("status"), data.alias("data"))

    return _daily(df, item, wrap, unit)


@query(
    "so4_parse_aqicn_history_raw",
    with_sql(
        SECOND_SQL,
        select="SELECT strftime(fetched_at, '%Y-%m-%dT%H:%M:%S') || 'Z' AS fetched_at, city, "
        + ", ".join(MEASURES)
        + " FROM readings_second WHERE so2 <> 7",
    ),
)
def so4_parse_aqicn_history_raw(spark, sf_dir):
    """Every event, a payload per city and hour."""
    return payloads.parse_aqicn_history(_history_payloads(readings_second(spark, sf_dir), "HOUR"))


def _listed(items, _day):
    return F.struct(items.alias("list"))


def _pollution_payloads(df, unit="DAY"):
    dt = F.when(F.col("so2") != 7, F.unix_timestamp("fetched_at"))
    components = F.struct(*[F.col(c).alias("pm2_5" if c == "pm25" else c) for c in POLLUTANTS])
    return _daily(df, F.struct(dt.alias("dt"), components.alias("components")), _listed, unit)


def _weather_history_payloads(df, unit="DAY"):
    main = F.struct(F.col("temperature").alias("temp"), "humidity", "pressure")
    wind = F.struct(F.col("wind_speed").alias("speed"))
    return _daily(df, F.struct(F.unix_timestamp("fetched_at").alias("dt"), main.alias("main"), wind.alias("wind")), _listed, unit)


_POLLUTION = f"""pollution AS (SELECT fetched_at, city, {aqi_sql("pm25", "printf('%.1f', pm25)::DOUBLE")} AS aqi, pm25, pm10, o3, no2, so2, co
  FROM readings WHERE so2 <> 7)"""


@query("so5_parse_pollution_history", with_sql(_POLLUTION, select="SELECT *, " + ", ".join(f"NULL::DOUBLE AS {c}" for c in WEATHER) + " FROM pollution"))
def so5_parse_pollution_history(spark, sf_dir):
    return payloads.parse_pollution_history(_pollution_payloads(readings(spark, sf_dir)))


@query("so6_parse_weather_history", with_sql(select="SELECT fetched_at, city, temperature, humidity, wind_speed, pressure FROM readings"))
def so6_parse_weather_history(spark, sf_dir):
    return payloads.parse_weather_history(_weather_history_payloads(readings(spark, sf_dir)))


@query(
    "j1_attach_weather",
    with_sql(
        select="SELECT fetched_at, city, aqi, pm25, pm10, o3, no2, so2, co, "
        + ", ".join(f"CASE WHEN humidity > 45 THEN {c} END AS {c}" for c in WEATHER)
        + " FROM readings"
    ),
)
def j1_attach_weather(spark, sf_dir):
    rows = readings(spark, sf_dir)
    return lookups.attach_weather(rows, rows.filter("humidity > 45").select("city", "fetched_at", *WEATHER))


@query(
    "p2_backfill",
    with_sql(
        _POLLUTION,
        f"merged AS (SELECT p.*, {', '.join('w.' + c for c in WEATHER)} FROM pollution p JOIN readings w ON p.city = w.city AND p.fetched_at = w.fetched_at)",
        features_sql("merged"),
        select=f"SELECT {_ALL} FROM features",
    ),
)
def p2_backfill(spark, sf_dir):
    """History payloads of both sources to feature rows."""
    rows = readings(spark, sf_dir)
    return backfill_features(_pollution_payloads(rows), _weather_history_payloads(rows))


_POLLUTION_RAW = _POLLUTION.replace("FROM readings", "FROM readings_second")


@query("so5_parse_pollution_history_raw", with_sql(SECOND_SQL, _POLLUTION_RAW, select="SELECT *, " + ", ".join(f"NULL::DOUBLE AS {c}" for c in WEATHER) + " FROM pollution"))
def so5_parse_pollution_history_raw(spark, sf_dir):
    """Every event, a payload per city and hour."""
    return payloads.parse_pollution_history(_pollution_payloads(readings_second(spark, sf_dir), "HOUR"))


@query("so6_parse_weather_history_raw", with_sql(SECOND_SQL, select="SELECT fetched_at, city, temperature, humidity, wind_speed, pressure FROM readings_second"))
def so6_parse_weather_history_raw(spark, sf_dir):
    """Every event, a payload per city and hour."""
    return payloads.parse_weather_history(_weather_history_payloads(readings_second(spark, sf_dir), "HOUR"))


@query(
    "j1_attach_weather_raw",
    with_sql(
        SECOND_SQL,
        select="SELECT fetched_at, city, aqi, pm25, pm10, o3, no2, so2, co, "
        + ", ".join(f"CASE WHEN humidity > 45 THEN {c} END AS {c}" for c in WEATHER)
        + " FROM readings_second",
    ),
)
def j1_attach_weather_raw(spark, sf_dir):
    """Every event."""
    rows = readings_second(spark, sf_dir)
    return lookups.attach_weather(rows, rows.filter("humidity > 45").select("city", "fetched_at", *WEATHER))


@query(
    "p2_backfill_raw",
    with_sql(
        SECOND_SQL,
        _POLLUTION_RAW,
        f"merged AS (SELECT p.*, {', '.join('w.' + c for c in WEATHER)} FROM pollution p JOIN readings_second w ON p.city = w.city AND p.fetched_at = w.fetched_at)",
        features_sql("merged"),
        select=f"SELECT {_ALL} FROM features",
    ),
)
def p2_backfill_raw(spark, sf_dir):
    """History payloads of every event, a payload per city and hour, to feature rows."""
    rows = readings_second(spark, sf_dir)
    return backfill_features(_pollution_payloads(rows, "HOUR"), _weather_history_payloads(rows, "HOUR"))


def _features(spark, sf_dir):
    return build_features(readings_raw(spark, sf_dir), unique=True)


_FEATURES_SQL = with_sql(features_sql(), select=f"SELECT {_ALL} FROM features")


@query("so7_read_features", _FEATURES_SQL)
def so7_read_features(spark, sf_dir):
    path = scratch_path(spark, "features")
    store.upsert_features(_features(spark, sf_dir), path)
    return tables.read_features(spark, path).drop("day")


@query("so8_read_snapshot_csv", _FEATURES_SQL)
def so8_read_snapshot_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    tables.write_snapshot_csv(_features(spark, sf_dir), path)
    return tables.read_snapshot_csv(spark, path)


@query("sk1_write_snapshot_csv", with_sql(select=f"SELECT fetched_at, city, {', '.join(MEASURES)} FROM readings_raw"))
def sk1_write_snapshot_csv(spark, sf_dir):
    """Times keep their microseconds through the text form."""
    path = scratch_path(spark, "csv")
    tables.write_snapshot_csv(readings_raw(spark, sf_dir), path)
    return tables.read_snapshot_csv(spark, path).select("fetched_at", "city", *MEASURES)


@query(
    "sk2_upsert_features",
    with_sql(
        select="SELECT fetched_at, city, CASE WHEN fetched_at >= TIMESTAMP '2024-01-15' THEN aqi + 1 ELSE aqi END AS aqi, pm25 FROM readings_raw"
    ),
)
def sk2_upsert_features(spark, sf_dir):
    """The first 20 days, then corrected rows from day 15 on, then the same again."""
    path = scratch_path(spark, "features")
    rows = readings_raw(spark, sf_dir)
    later = rows.filter("fetched_at >= TIMESTAMP '2024-01-15'").withColumn("aqi", F.col("aqi") + 1)
    store.upsert_features(rows.filter("fetched_at < TIMESTAMP '2024-01-21'"), path)
    store.upsert_features(later, path)
    store.upsert_features(later, path)
    return store.feature_table(spark, path).read().select("fetched_at", "city", "aqi", "pm25")


@query("sk3_write_splits", with_sql(*TQ._TO_PARTS, select="SELECT split, city, fetched_at, aqi, target_aqi_3d FROM parts"))
def sk3_write_splits(spark, sf_dir):
    path = scratch_path(spark, "splits")
    parts = TQ.parts(spark, sf_dir)
    tables.write_splits(parts, path)
    return tables.read_splits(spark, path, parts.schema).select("split", "city", "fetched_at", "aqi", "target_aqi_3d")


@query(
    "sk4_upsert_prediction_log",
    with_sql(
        features_sql(),
        TQ._LABELLED,
        TQ._LOG,
        select="""SELECT city, forecast_timestamp, round(CASE WHEN city = 'click' THEN predicted_aqi + 5 ELSE predicted_aqi END, 6) AS predicted_aqi,
          actual_aqi, CASE WHEN city = 'click' THEN 'Linear2' ELSE model_version END AS model_version FROM log""",
    ),
)
def sk4_upsert_prediction_log(spark, sf_dir):
    path = scratch_path(spark, "log")
    log = TQ.prediction_log(TQ.labelled(spark, sf_dir))
    again = log.filter("city = 'click'").withColumns({"predicted_aqi": F.col("predicted_aqi") + 5, "model_version": F.lit("Linear2")})
    store.upsert_prediction_log(log, path)
    store.upsert_prediction_log(again, path)
    return store.prediction_log(spark, path).read().drop("day").withColumn("predicted_aqi", F.round("predicted_aqi", 6))


@query("sk5_write_metrics", with_sql(features_sql(), TQ._LABELLED, TQ._COMPARISON, select="SELECT * EXCLUDE (n) FROM comparison"))
def sk5_write_metrics(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    tables.write_metrics(TQ._comparison(spark, sf_dir), path)
    return tables.read_metrics(spark, path)


def _run_stream(spark, landings, recompute_late=False):
    """Land each part in turn and let the scheduled job catch up after each."""
    landing, table, checkpoint = (scratch_path(spark, n) for n in ("landing", "features", "progress"))
    for part in landings:
        part.write.mode("append").parquet(landing)
        stream_features(spark, landing, table, checkpoint, recompute_late=recompute_late).awaitTermination()
    return tables.read_features(spark, table).drop("day")


@query("st1_stream_features", _FEATURES_SQL)
def st1_stream_features(spark, sf_dir):
    """Three deliveries in time order give what one batch run gives."""
    rows = readings_raw(spark, sf_dir)
    cuts = ["2024-01-01", "2024-01-11", "2024-01-21 05:00:00", "2024-03-01"]
    parts = [rows.filter(f"fetched_at >= TIMESTAMP '{a}' AND fetched_at < TIMESTAMP '{b}'") for a, b in zip(cuts, cuts[1:])]
    return _run_stream(spark, parts)


@query("st2_recompute_late", _FEATURES_SQL)
def st2_recompute_late(spark, sf_dir):
    """Rows of some hours arrive late and twice; affected rows are recomputed."""
    rows = readings_raw(spark, sf_dir)
    late = F.col("so2") % 4 == 1
    return _run_stream(spark, [rows.filter(~late), rows.filter(late), rows.filter(late)], recompute_late=True)
