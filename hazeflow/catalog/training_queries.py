"""Labels, splits, fills, sequences, imputation, metrics and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeflow.catalog.readings import features_sql, readings, readings_raw, with_sql
from hazeflow.catalog.registry import query
from hazeflow.functions import projections as P
from hazeflow.functions import scalars as S
from hazeflow.operators import labels, lookups, metrics, preparing
from hazeflow.operators.stats import top_correlated
from hazeflow.plans.features import build_features
from hazeflow.schemas import MEASURES
from hazeflow.scratch import materialize

_LABELLED = """labelled AS (
  SELECT * FROM (SELECT * EXCLUDE (target_aqi_3d), lead(aqi, 72) OVER (PARTITION BY city ORDER BY fetched_at) AS target_aqi_3d FROM features)
  WHERE target_aqi_3d IS NOT NULL)"""

_TRAIN, _VAL = 1 - (0.15 + 0.15), 1 - 0.15
_SPLIT = f"""parts AS (
  SELECT * EXCLUDE (pos, n), CASE WHEN pos < floor(n * {_TRAIN!r}::DOUBLE) THEN 'train' WHEN pos < floor(n * {_VAL!r}::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY fetched_at, city) - 1 AS pos, count(*) OVER () AS n FROM labelled))"""

_TO_PARTS = (features_sql(), _LABELLED, _SPLIT)


def labelled(spark, sf_dir):
    return labels.forecast_target(build_features(readings_raw(spark, sf_dir), unique=True))


def parts(spark, sf_dir):
    return labels.chrono_split(materialize(labelled(spark, sf_dir), "labelled"))


def _metrics_sql(table: str, y: str, p: str, where: str = "TRUE") -> str:
    return (
        f"SELECT round(sqrt(avg(({y} - {p}) ^ 2)), 6) AS rmse, round(avg(abs({y} - {p})), 6) AS mae,"
        f" round(1 - sum(({y} - {p}) ^ 2) / (var_pop({y}) * count(*)), 6) AS r2 FROM {table} WHERE {y} IS NOT NULL AND {p} IS NOT NULL AND {where}"
    )


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    "w6_forecast_target",
    with_sql(features_sql(), _LABELLED, select="SELECT city, fetched_at, aqi, target_aqi_3d FROM labelled"),
)
def w6_forecast_target(spark, sf_dir):
    return labelled(spark, sf_dir).select("city", "fetched_at", "aqi", "target_aqi_3d")


@query(
    "w6_forecast_target_lag",
    with_sql(
        select="""SELECT * FROM (SELECT city, fetched_at, aqi, lead(aqi, 24) OVER w AS target_aqi_24h,
            (epoch_us(lead(fetched_at, 24) OVER w) - epoch_us(fetched_at)) / 1e6::DOUBLE / 3600.0::DOUBLE AS lag_hours
          FROM readings WINDOW w AS (PARTITION BY city ORDER BY fetched_at)) WHERE target_aqi_24h IS NOT NULL"""
    ),
)
def w6_forecast_target_lag(spark, sf_dir):
    """24 rows ahead, with how many hours that really is."""
    slim = readings(spark, sf_dir).select("city", "fetched_at", "aqi")
    return labels.forecast_target(slim, 24, lag="lag_hours")


@query(
    "w6_forecast_target_time",
    with_sql(
        select="""SELECT r.city, r.fetched_at, r.aqi, f.aqi AS target_aqi_3d FROM readings r
          JOIN readings f ON r.city = f.city AND f.fetched_at = r.fetched_at + INTERVAL 72 HOUR WHERE f.aqi IS NOT NULL"""
    ),
)
def w6_forecast_target_time(spark, sf_dir):
    return labels.forecast_target(readings(spark, sf_dir).select("city", "fetched_at", "aqi"), mode="time")


@query("w7_chrono_split", with_sql(*_TO_PARTS, select="SELECT city, fetched_at, target_aqi_3d, split FROM parts"))
def w7_chrono_split(spark, sf_dir):
    return parts(spark, sf_dir).select("city", "fetched_at", "target_aqi_3d", "split")


@query(
    "w7_chrono_split_two",
    with_sql(
        select=f"""SELECT city, fetched_at, CASE WHEN pos < floor(n * {1 - 0.2!r}::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM
          (SELECT *, row_number() OVER (ORDER BY fetched_at, city) - 1 AS pos, count(*) OVER () AS n FROM readings_raw)"""
    ),
)
def w7_chrono_split_two(spark, sf_dir):
    return labels.chrono_split(readings_raw(spark, sf_dir).select("city", "fetched_at"), 0.0, 0.2)


_FILLED = ["temperature", "wind_speed", "pm10", "aqi_rolling_mean_6h"]


@query(
    "w8_ffill_bfill",
    with_sql(
        *_TO_PARTS,
        select="SELECT city, fetched_at, split, "
        + ", ".join(
            f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY split, city ORDER BY fetched_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
            f" first_value({c} IGNORE NULLS) OVER (PARTITION BY split, city ORDER BY fetched_at ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
            for c in _FILLED
        )
        + " FROM parts",
    ),
)
def w8_ffill_bfill(spark, sf_dir):
    slim = parts(spark, sf_dir).select("city", "fetched_at", "split", *_FILLED)
    return labels.ffill_bfill(slim, _FILLED, ["split", "city"])


def _sequence_sql(last: str) -> str:
    listed = ", ".join(f"list({c}) OVER w AS {c}_seq" for c in ("pm25", "humidity"))
    return with_sql(
        *_TO_PARTS,
        select=f"""SELECT split, city, fetched_at, target_aqi_3d, list_aggregate(pm25_seq::VARCHAR[], 'string_agg', ',') AS pm25_seq,
          list_sum(humidity_seq) AS humidity_sum
        FROM (SELECT split, city, fetched_at, target_aqi_3d, {listed}, row_number() OVER (PARTITION BY split, city ORDER BY fetched_at) AS rn,
            count(*) OVER (PARTITION BY split, city) AS n FROM parts
          WINDOW w AS (PARTITION BY split, city ORDER BY fetched_at ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
        WHERE rn >= 24 AND {last}""",
    )


def _sequence_query(name: str, drop_last: bool):
    @query(name, _sequence_sql("rn < n" if drop_last else "TRUE"))
    def run(spark, sf_dir):
        listed = labels.make_sequences(parts(spark, sf_dir), ["pm25", "humidity"], ["split", "city"], drop_last=drop_last)
        text = F.array_join(F.transform("sequence", lambda s: s["pm25"].cast("string")), ",")
        total = F.aggregate("sequence", F.lit(0.0), lambda acc, s: acc + s["humidity"])
        return listed.select("split", "city", "fetched_at", "target_aqi_3d", text.alias("pm25_seq"), total.alias("humidity_sum"))


_sequence_query("w10_make_sequences", True)
_sequence_query("w10_make_sequences_serving", False)


@query(
    "w11_sequence_persistence",
    with_sql(
        *_TO_PARTS,
        """ends AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY split, city) AS n FROM parts
          WINDOW w AS (PARTITION BY split, city ORDER BY fetched_at))""",
        select=_metrics_sql("ends", "target_aqi_3d", "aqi", "rn >= 24 AND rn < n"),
    ),
)
def w11_sequence_persistence(spark, sf_dir):
    return _round(labels.sequence_persistence(parts(spark, sf_dir), ["split", "city"]), "rmse", "mae", "r2")


_PRED = "0.6::DOUBLE * pm25 + 0.3::DOUBLE * humidity + 40.0::DOUBLE"


def _scored(df):
    """A fixed linear formula stands in for a fitted model, so SQL can follow."""
    return df.withColumn("prediction", F.lit(0.6) * F.col("pm25") + F.lit(0.3) * F.col("humidity") + F.lit(40.0))


@query(
    "a4_regression_metrics",
    with_sql(
        features_sql(),
        _LABELLED,
        select=_metrics_sql(f"(SELECT *, {_PRED} AS prediction FROM labelled)", "target_aqi_3d", "prediction").replace("SELECT ", "SELECT city, ", 1)
        + " GROUP BY city",
    ),
)
def a4_regression_metrics(spark, sf_dir):
    scored = _scored(labelled(spark, sf_dir))
    return _round(metrics.regression_metrics(scored, "target_aqi_3d", "prediction", ["city"]), "rmse", "mae", "r2")


@query("a5_persistence_baseline", with_sql(features_sql(), _LABELLED, select=_metrics_sql("labelled", "target_aqi_3d", "aqi")))
def a5_persistence_baseline(spark, sf_dir):
    return _round(metrics.persistence_baseline(labelled(spark, sf_dir)), "rmse", "mae", "r2")


@query(
    "a5_evaluate",
    with_sql(
        features_sql(),
        _LABELLED,
        f"both_sides AS (SELECT *, {_PRED} AS prediction FROM labelled WHERE aqi IS NOT NULL AND {_PRED} IS NOT NULL AND target_aqi_3d IS NOT NULL)",
        f"m AS ({_metrics_sql('both_sides', 'target_aqi_3d', 'prediction')})",
        f"p AS ({_metrics_sql('both_sides', 'target_aqi_3d', 'aqi')})",
        select="""SELECT (SELECT count(*) FROM both_sides) AS n, m.rmse AS model_rmse, m.mae AS model_mae, m.r2 AS model_r2, p.rmse AS persistence_rmse, p.mae AS persistence_mae,
          p.r2 AS persistence_r2, round(p.rmse - m.rmse, 5) AS improvement_rmse, m.rmse < p.rmse AS beats_persistence FROM m, p""",
    ),
)
def a5_evaluate(spark, sf_dir):
    one = metrics.evaluate(_scored(labelled(spark, sf_dir)), "prediction")
    names = [f"{side}_{m}" for side in ("model", "persistence") for m in ("rmse", "mae", "r2")]
    return _round(one, *names).withColumn("improvement_rmse", F.round(F.col("persistence_rmse") - F.col("model_rmse"), 5))


def prediction_log(df):
    """Log rows of the stand-in model."""
    return _scored(df).select(
        "city",
        S.forecast_ts(F.col("fetched_at")).alias("forecast_timestamp"),
        F.col("prediction").alias("predicted_aqi"),
        F.col("target_aqi_3d").alias("actual_aqi"),
        F.lit("Linear").alias("model_version"),
    )


_LOG = f"""log AS (SELECT city, fetched_at + INTERVAL 72 HOUR AS forecast_timestamp, {_PRED} AS predicted_aqi, target_aqi_3d AS actual_aqi,
  'Linear' AS model_version FROM labelled)"""


@query(
    "p8_recent_predictions",
    with_sql(
        features_sql(),
        _LABELLED,
        _LOG,
        select="SELECT * REPLACE (round(predicted_aqi, 6) AS predicted_aqi) FROM log WHERE forecast_timestamp >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 14 DAY",
    ),
)
def p8_recent_predictions(spark, sf_dir):
    log = prediction_log(labelled(spark, sf_dir))
    return _round(P.recent_predictions(log, "2024-02-01 00:00:00", 14), "predicted_aqi")


@query(
    "a6_within_tolerance",
    with_sql(
        features_sql(),
        _LABELLED,
        _LOG,
        select="SELECT city, round(avg(CASE WHEN abs(predicted_aqi - actual_aqi) <= 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 6) AS within_pct FROM log GROUP BY city",
    ),
)
def a6_within_tolerance(spark, sf_dir):
    return _round(metrics.within_tolerance(prediction_log(labelled(spark, sf_dir)), 15, ["city"]), "within_pct")


@query("p11_drop_null_label", with_sql(features_sql(), _LABELLED, select="SELECT city, fetched_at, target_aqi_3d FROM labelled WHERE aqi IS NOT NULL"))
def p11_drop_null_label(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("city", "fetched_at", "aqi", "target_aqi_3d")
    return P.drop_null_prediction(P.drop_null_label(rows), "aqi").drop("aqi")


_IMPUTED = ["aqi", "pm10", "temperature", "wind_speed", "aqi_change_rate_24h"]


@query(
    "a11_median_imputer",
    with_sql(
        *_TO_PARTS,
        "medians AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}_m" for c in _IMPUTED) + " FROM parts WHERE split = 'train')",
        select="SELECT split, city, fetched_at, " + ", ".join(f"coalesce({c}, {c}_m) AS {c}" for c in _IMPUTED) + " FROM parts, medians",
    ),
)
def a11_median_imputer(spark, sf_dir):
    rows = parts(spark, sf_dir)
    medians = preparing.fit_median_imputer(rows.filter("split = 'train'"), _IMPUTED)
    return preparing.apply_imputer(rows, medians).select("split", "city", "fetched_at", *_IMPUTED)


_SCALED = ["pm25", "humidity", "month"]


@query(
    "a12_standard_scaler",
    with_sql(
        *_TO_PARTS,
        "fitted AS (SELECT "
        + ", ".join(
            f"avg({c}::DOUBLE) AS {c}_m, CASE WHEN stddev_pop({c}::DOUBLE) = 0 THEN 1.0 ELSE stddev_pop({c}::DOUBLE) END AS {c}_s" for c in _SCALED
        )
        + " FROM parts WHERE split = 'train')",
        select="SELECT split, city, fetched_at, " + ", ".join(f"round(({c} - {c}_m) / {c}_s, 6) AS {c}" for c in _SCALED) + " FROM parts, fitted",
    ),
)
def a12_standard_scaler(spark, sf_dir):
    rows = parts(spark, sf_dir)
    fitted = preparing.fit_standard_scaler(rows.filter("split = 'train'"), _SCALED)
    scaled = preparing.apply_scaler(rows, fitted).select("split", "city", "fetched_at", *_SCALED)
    return _round(scaled, *_SCALED)


_FORECAST = f"""scored AS (SELECT city, fetched_at, {_PRED} AS prediction FROM readings_raw),
latest AS (SELECT city, max(fetched_at) AS t FROM scored GROUP BY city),
forecast AS (
  SELECT l.city, l.t + to_hours(h) AS forecast_timestamp, arg_min(s.prediction, [abs(epoch_us(s.fetched_at) - epoch_us(l.t - to_hours(72 - h))), epoch_us(s.fetched_at)]) AS predicted_aqi
  FROM latest l, (VALUES (12), (24), (36), (48), (60), (72)) hs(h), scored s
  WHERE s.city = l.city AND abs(epoch_us(s.fetched_at) - epoch_us(l.t - to_hours(72 - h))) <= 7200000000
  GROUP BY l.city, l.t, h)"""


def _forecast(spark, sf_dir):
    return lookups.forecast_horizons(_scored(readings_raw(spark, sf_dir)))


@query("j3_forecast_horizons", with_sql(_FORECAST, select="SELECT city, forecast_timestamp, round(predicted_aqi, 6) AS predicted_aqi FROM forecast"))
def j3_forecast_horizons(spark, sf_dir):
    return _round(_forecast(spark, sf_dir), "predicted_aqi")


@query(
    "a13_forecast_alert",
    with_sql(
        _FORECAST,
        select="""SELECT city, round(max(predicted_aqi), 6) AS max_aqi, CASE WHEN max(predicted_aqi) >= 300 THEN 'hazardous'
          WHEN max(predicted_aqi) >= 200 THEN 'very unhealthy' WHEN max(predicted_aqi) >= 150 THEN 'unhealthy' ELSE 'none' END AS alert
          FROM forecast GROUP BY city""",
    ),
)
def a13_forecast_alert(spark, sf_dir):
    return _round(metrics.forecast_alert(_forecast(spark, sf_dir)), "max_aqi")


_CANDIDATES = {"Persistence": "aqi", "Steady": "100.0::DOUBLE", "Linear": _PRED, "Particles": "0.5::DOUBLE * pm10"}


def _comparison(spark, sf_dir):
    """Quality of fixed formulas on the labelled rows, one pass."""
    rows = _scored(labelled(spark, sf_dir)).withColumns({"steady": F.lit(100.0), "particles": F.col("pm10") * 0.5})
    table = metrics.compare_predictions(rows, {"Steady": "steady", "Linear": "prediction", "Particles": "particles"})
    return _round(table, "rmse", "mae", "r2")


_ALL_SIDES = " AND ".join(f"({p}) IS NOT NULL" for p in ("target_aqi_3d", *_CANDIDATES.values()))
_COMPARISON = f"common AS (SELECT * FROM labelled WHERE {_ALL_SIDES}),\nquality AS (" + "\nUNION ALL ".join(
    f"SELECT '{n}' AS model_name, *, (SELECT count(*) FROM common) AS n FROM"
    f" ({_metrics_sql(f'(SELECT target_aqi_3d, {p} AS p FROM common)', 'target_aqi_3d', 'p')})"
    for n, p in _CANDIDATES.items()
) + "),\ncomparison AS (SELECT *, rmse < (SELECT rmse FROM quality WHERE model_name = 'Persistence') AS beats_persistence FROM quality)"


@query("o7_rank_models", with_sql(features_sql(), _LABELLED, _COMPARISON, select="SELECT * FROM comparison ORDER BY rmse"))
def o7_rank_models(spark, sf_dir):
    return metrics.rank_models(_comparison(spark, sf_dir))


@query(
    "m6_select_best",
    with_sql(features_sql(), _LABELLED, _COMPARISON, select="SELECT * FROM comparison WHERE beats_persistence ORDER BY rmse LIMIT 1"),
)
def m6_select_best(spark, sf_dir):
    return metrics.select_best(_comparison(spark, sf_dir))


@query(
    "o5_top_features",
    with_sql(
        features_sql(),
        select="SELECT feature, round(importance, 6) AS importance FROM ("
        + "\nUNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, aqi)) AS importance FROM features" for c in MEASURES if c != "aqi")
        + ") ORDER BY importance DESC LIMIT 10",
    ),
)
def o5_top_features(spark, sf_dir):
    rows = build_features(readings_raw(spark, sf_dir), unique=True).select(*MEASURES)
    impact = top_correlated(rows, len(MEASURES)).select("feature", F.col("magnitude").alias("importance"))
    return _round(metrics.top_features(impact, 10), "importance")
