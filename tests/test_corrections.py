"""Cases that once went wrong."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import at, hourly, naive
from hazeflow.functions import scalars as S
from hazeflow.models import regressors as R
from hazeflow.operators import labels, lookups, metrics
from hazeflow.sources import payloads


def test_every_landed_instant_stays(spark):
    ok = json.dumps({"status": "ok", "data": {"aqi": 45, "iaqi": {"pm25": {"v": 12}}}})
    rows = [("A", at("2026-01-01T00:00:00"), ok), ("A", at("2026-01-01T01:00:00"), '{"status": "error"}'), ("A", at("2026-01-01T02:00:00"), "junk")]
    landed = spark.createDataFrame(rows, "city string, fetched_at timestamp, payload string")
    weather = payloads.parse_openweather_current(landed.limit(0))
    merged = lookups.merge_snapshot(payloads.parse_aqicn_current(landed, keep_failed=True), weather)
    assert sorted((naive(r.fetched_at).hour, r.aqi, r.pm25, r.temperature) for r in merged.collect()) == [(0, 45.0, 12.0, None), (1, None, None, None), (2, None, None, None)]
    assert payloads.parse_aqicn_current(landed).count() == 1


def test_models_and_persistence_share_their_rows(spark):
    rows = spark.createDataFrame([(1.0, 2.0, None), (5.0, 6.0, 5.5), (9.0, 7.0, 8.0), (None, 1.0, 1.0)], "target_aqi_3d double, p double, aqi double")
    one = metrics.evaluate(rows, "p").first()
    assert one.n == 2 and one.model_mae == 1.5 and one.persistence_mae == 0.75
    table = {r.model_name: (r.mae, r.n) for r in metrics.compare_predictions(rows, {"M": "p"}).collect()}
    assert table == {"Persistence": (0.75, 2), "M": (1.5, 2)}


def test_split_with_null_cities(spark):
    df = hourly(spark, 100, city="A").unionByName(hourly(spark, 50, city="B")).withColumn("city", F.when(F.col("city") == "A", F.col("city")))
    rows = labels.chrono_split(df, 1 / 3, 1 / 3).collect()
    ordered = sorted(rows, key=lambda r: (r.fetched_at, r.city is not None, r.city or ""))
    counts = {s: sum(r.split == s for r in rows) for s in ("train", "val", "test")}
    assert counts["train"] in (49, 50) and sum(counts.values()) == 150
    assert [r.split for r in ordered] == ["train"] * counts["train"] + ["val"] * counts["val"] + ["test"] * counts["test"]


def test_too_deep_trees_are_refused(spark):
    empty = spark.createDataFrame([], "x double")
    with pytest.raises(ValueError):
        R.grid_forest(empty, empty, depths=[10, 31])


def test_fine_fractions_are_cut_off(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00.123456789Z",), ("2026-01-01 05:00:00.1234567+05:00",), ("2026-01-01T00:00:00.5Z",)], "t string")
    got = [r.us for r in df.select(F.unix_micros(S.parse_ts(F.col("t"))).alias("us")).collect()]
    base = 1_767_225_600_000_000
    assert got == [base + 123456, base + 123456, base + 500000]
