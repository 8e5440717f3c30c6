import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import at, hourly
from hazeflow.models import regressors as R
from hazeflow.models.explain import linear_attribution, model_weights
from hazeflow.operators import labels, metrics, preparing
from hazeflow.plans import serving
from hazeflow.plans.training import train


def test_label_is_rows_ahead(scattered):
    df = hourly(scattered, 100)
    ten = labels.forecast_target(df, 10)
    assert ten.count() == 90 and ten.orderBy("fetched_at").first()["target_aqi_10h"] == 110.0
    three_days = labels.forecast_target(df)
    assert three_days.count() == 28 and three_days.orderBy("fetched_at").first()["target_aqi_3d"] == 172.0
    assert labels.forecast_target(hourly(scattered, 60)).count() == 0


def test_label_stays_in_its_city_and_reports_the_lag(scattered):
    df = hourly(scattered, 20, step=2).unionByName(hourly(scattered, 20, city="B", value=lambda i: None if i == 15 else float(i)))
    got = labels.forecast_target(df, 10, lag="lag")
    assert {(r.city, r["lag"]) for r in got.collect()} == {("A", 20.0), ("B", 10.0)}
    assert got.filter("city = 'B'").count() == 9  # a missing reading inside is no label
    assert labels.forecast_target(df, 10, mode="time").filter("city = 'A'").count() == 15


def test_split_cuts_one_timeline(scattered):
    df = hourly(scattered, 90).unionByName(hourly(scattered, 10, city="B", start="2025-12-01"))
    rows = labels.chrono_split(df).orderBy("fetched_at", "city").collect()
    assert [r.split for r in rows] == ["train"] * 70 + ["val"] * 15 + ["test"] * 15
    two = labels.chrono_split(hourly(scattered, 90), 0.0, 0.2).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in two} == {"train": 72, "test": 18}


def test_split_orders_same_instants_by_city(scattered):
    df = hourly(scattered, 1).unionByName(hourly(scattered, 1, city="B")).unionByName(hourly(scattered, 1, city="C"))
    got = {r.city: r.split for r in labels.chrono_split(df, 0.34, 0.33).collect()}
    assert got == {"A": "train" if int(3 * (1 - 0.67)) else "val", "B": "val", "C": "test"}


def test_fill_stays_in_its_part(scattered):
    df = hourly(scattered, 6, value=lambda i: [None, 1.0, None, None, 5.0, None][i])
    df = df.withColumn("split", F.when(F.col("fetched_at") < F.lit("2026-01-01 03:00:00").cast("timestamp"), "train").otherwise("val"))
    got = [r.aqi for r in labels.ffill_bfill(df, ["aqi"], ["split", "city"]).orderBy("fetched_at").collect()]
    assert got == [1.0, 1.0, 1.0, 5.0, 5.0, 5.0]


def test_sequences(scattered):
    df = hourly(scattered, 30).unionByName(hourly(scattered, 10, city="B")).withColumn("target_aqi_3d", F.col("aqi") + 1)
    df = df.withColumn("split", F.lit("train"))
    kept = labels.make_sequences(df, ["aqi"], ["split", "city"]).orderBy("fetched_at").collect()
    assert len(kept) == 6 and [s.aqi for s in kept[0]["sequence"]] == [100.0 + i for i in range(24)]
    assert kept[0].target_aqi_3d == 124.0
    assert labels.make_sequences(df, ["aqi"], ["split", "city"], drop_last=False).count() == 7
    assert abs(labels.sequence_persistence(df, ["split", "city"]).first()["rmse"] - 1.0) < 1e-12


def test_metrics_match_their_formulas(spark):
    rng = np.random.default_rng(1)
    y, p = rng.normal(150, 40, 200), rng.normal(150, 40, 200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)] + [(None, 1.0)], "y double, p double")
    row = metrics.regression_metrics(df, "y", "p").first()
    expected = (math.sqrt(np.mean((y - p) ** 2)), np.mean(abs(y - p)), 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert np.allclose((row.rmse, row.mae, row.r2), expected, rtol=1e-12)
    flat = spark.createDataFrame([(5.0, 5.0), (5.0, 6.0)], "y double, p double")
    assert metrics.regression_metrics(flat, "y", "p").first()["r2"] == 0.0


def test_tolerance_counts_missing_as_miss(spark):
    log = spark.createDataFrame([(10.0, 25.0), (10.0, 25.1), (10.0, None), (10.0, 10.0)], "predicted_aqi double, actual_aqi double")
    assert metrics.within_tolerance(log).first()["within_pct"] == 50.0


def test_gate_and_ranking(spark):
    table = spark.createDataFrame([("Ridge", 18.7, True), ("Persistence", 62.7, False), ("Bad", 70.0, False)], "model_name string, rmse double, beats_persistence boolean")
    assert metrics.select_best(table).first()["model_name"] == "Ridge"
    assert [r.model_name for r in metrics.rank_models(table).collect()] == ["Ridge", "Persistence", "Bad"]
    assert metrics.select_best(table.filter("model_name <> 'Ridge'")).first() is None


@pytest.mark.parametrize("top,alert", [(149.9, "none"), (150.0, "unhealthy"), (200.0, "very unhealthy"), (300.0, "hazardous")])
def test_alert_edges(spark, top, alert):
    df = spark.createDataFrame([("A", 10.0), ("A", top)], "city string, predicted_aqi double")
    assert metrics.forecast_alert(df).first()["alert"] == alert


def test_imputer_and_scaler_learn_from_train_only(scattered):
    df = scattered.createDataFrame([(float(i), None, 7.0) for i in (1, 2, 3, 4)] + [(None, None, 7.0)], "a double, b double, c double")
    medians = preparing.fit_median_imputer(df, ["a", "b", "c"])
    assert medians == {"a": 2.5, "c": 7.0}
    filled = preparing.apply_imputer(df, medians, ["a", "b", "c"])
    assert filled.columns == ["a", "c"] and filled.filter("a = 2.5").count() == 1
    scaled = preparing.apply_scaler(df, preparing.fit_standard_scaler(df, ["a", "c"])).select("a", "c").collect()
    assert np.allclose([r.a for r in scaled[:4]], (np.array([1, 2, 3, 4]) - 2.5) / np.std([1, 2, 3, 4])) and scaled[0].c == 0.0


def model_rows(spark, n=400):
    rng = np.random.default_rng(42)
    start, rows = at("2026-01-01"), []
    for i in range(n):
        aqi, pm25, wind = rng.uniform(50, 300), rng.uniform(5, 200), None if i % 10 == 0 else rng.uniform(0, 8)
        rows.append((start + dt.timedelta(hours=i), "A", float(aqi), float(pm25), wind, 1.0, None, float(1.05 * aqi + 0.3 * pm25 + rng.normal(0, 5))))
    return spark.createDataFrame(rows, "fetched_at timestamp, city string, aqi double, pm25 double, wind_speed double, flat double, gone double, target_aqi_3d double")


def test_ridge_is_the_closed_form(spark):
    parts = labels.chrono_split(model_rows(spark).drop("flat"))
    matrix = R.Matrix.fit(parts.filter("split = 'train'"))
    assert matrix.names == ["aqi", "pm25", "wind_speed"] and matrix.empty == ["gone"]
    train_part, val_part = R.training_vectors(parts, matrix)
    search = R.grid_ridge(train_part, val_part)
    assert list(search.errors) == R.RIDGE_ALPHAS
    rows = train_part.collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([r.target_aqi_3d for r in rows])
    xc, yc = x - x.mean(0), y - y.mean()
    best = min(search.errors, key=search.errors.get)
    for alpha, model in [(best, search.model), (100.0, R.grid_ridge(train_part, val_part, [100.0]).model)]:
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
        assert np.allclose(model.coefficients.toArray(), w, rtol=1e-10, atol=1e-11)
        assert abs(model.intercept - (y.mean() - x.mean(0) @ w)) < 1e-9


def test_ridge_gives_a_constant_column_no_weight(spark):
    parts = labels.chrono_split(model_rows(spark))
    matrix = R.Matrix.fit(parts.filter("split = 'train'"))
    model = R.grid_ridge(*R.training_vectors(parts, matrix), [1.0]).model
    assert model_weights(model, matrix.names)["flat"] == 0.0


def test_forest_grid_and_importances(spark):
    parts = labels.chrono_split(model_rows(spark, 200))
    matrix = R.Matrix.fit(parts.filter("split = 'train'"))
    search = R.grid_forest(*R.training_vectors(parts, matrix), trees=[3, 5], depths=[2, None])
    assert set(search.errors) == {(3, 2), (3, None), (5, 2), (5, None)}
    values = [r.importance for r in R.feature_importances(search.model, matrix.names, spark).collect()]
    assert values == sorted(values, reverse=True) and abs(sum(values) - 1) < 1e-9


def test_training_run_selects_logs_and_serves(spark):
    base = model_rows(spark, 500).drop("target_aqi_3d").withColumn("aqi", 150 + 100 * F.sin(F.unix_timestamp("fetched_at") / 3600 / 20))
    run = train(base.withColumn("noise_outlier", F.lit(1.0)), forest=False)
    assert [r.model_name for r in run.metrics.collect()] == ["Ridge", "Persistence"] and run.best == "Ridge"
    assert "noise_outlier" not in run.matrix.names
    log = run.log_rows()
    assert log.count() == run.parts.filter("split = 'test'").count()
    forecast = serving.forecast(run.models["Ridge"], run.matrix, base.drop("wind_speed"))
    assert forecast.count() == 6 and forecast.filter("aqi_category = 'Unknown'").count() == 0
    assert serving.explain_latest(run.models["Ridge"], run.matrix, base).count() == len(run.matrix.names)
    assert serving.current_state(base).first()["current_aqi_category"] is not None


def test_attribution_formula(spark):
    df = hourly(spark, 150).withColumn("pm25", F.col("aqi") * 2)
    got = {r.feature: r.importance for r in linear_attribution(df, {"aqi": -1.0, "pm25": 0.25}).collect()}
    assert got == {"aqi": 49.5, "pm25": 24.75}
    assert list(got) == ["aqi", "pm25"]


def test_weights_follow_the_columns():
    class Fitted:
        class coefficients:
            @staticmethod
            def toArray():
                return [1, 2]

    assert model_weights(Fitted, ["a", "b"]) == {"a": 1.0, "b": 2.0}
