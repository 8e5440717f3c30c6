import datetime as dt
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from conftest import at, hourly, naive
from hazeflow.operators.lookups import merge_snapshot
from hazeflow.plans.backfill import backfill_features, feed_history_features, skipped_dates
from hazeflow.sources import payloads, store, tables, versions


def landed(spark, *docs, city="A"):
    rows = [(city, at("2026-01-01") + dt.timedelta(hours=i), d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "city string, fetched_at timestamp, payload string")


def test_current_air(spark):
    good = {"status": "ok", "data": {"aqi": 45, "iaqi": {"pm25": {"v": 12}, "pm10": {"v": 25.5}, "o3": 7, "no2": None}}}
    texty = {"status": "ok", "data": {"aqi": "-"}}
    rows = payloads.parse_aqicn_current(landed(spark, good, {"status": "error", "data": "Unknown"}, texty, "not json", None)).orderBy("fetched_at").collect()
    assert [(r.aqi, r.pm25, r.pm10, r.o3, r.no2) for r in rows] == [(45.0, 12.0, 25.5, None, None), (None,) * 5]


def test_current_weather_and_merge(spark):
    doc = {"main": {"temp": 19.5, "humidity": 65, "pressure": 1013}, "wind": {"speed": 3.6}}
    weather = payloads.parse_openweather_current(landed(spark, doc, {"main": {}}))
    assert tuple(weather.orderBy("fetched_at").first())[2:] == (19.5, 65.0, 3.6, 1013.0)
    air = payloads.parse_aqicn_current(landed(spark, {"status": "error"}, {"status": "ok", "data": {"aqi": 50}}, {"status": "ok", "data": {"aqi": 60}}))
    rows = merge_snapshot(air, weather).orderBy("fetched_at").collect()
    assert [(r.aqi, r.temperature) for r in rows] == [(None, 19.5), (50.0, None), (60.0, None)]


def test_feed_history(spark):
    items = [{"time": "2026-01-01T00:00:00Z", "aqi": 150, "pm25": 55}, {"timestamp": "2026-01-01T01:00:00Z", "aqi": 155}, {"aqi": 1}, {"time": "", "timestamp": None}]
    docs = landed(spark, {"status": "ok", "data": {"history": [], "daily": items}}, {"status": "ok", "data": {"aqi": 3}}, {"status": "ok", "data": {"series": items[:1]}})
    rows = payloads.parse_aqicn_history(docs).collect()
    assert sorted((r.fetched_at, r.aqi) for r in rows) == [("2026-01-01T00:00:00Z", 150.0)] * 2 + [("2026-01-01T01:00:00Z", 155.0)]
    assert feed_history_features(docs).filter("hour = 1 AND aqi_change_rate_1h IS NOT NULL").count() == 1


def test_pollution_history_and_backfill(spark):
    first = 1_700_000_000
    items = [{"dt": first + 3600 * i, "components": {"pm2_5": v, "pm10": 50.0, "o3": 1}} for i, v in enumerate((35.4, 55.4, 12.0))]
    items += [{"components": {"pm2_5": 1.0}}, {"dt": first + 4 * 3600, "components": {}}]
    sky = [{"dt": first, "main": {"temp": 20.0}, "wind": {"speed": 2.0}}, {"dt": first + 60, "main": {"temp": 99.0}}]
    pollution, weather = landed(spark, {"list": items}), landed(spark, {"list": sky})
    rows = payloads.parse_pollution_history(pollution).orderBy("fetched_at").collect()
    assert [r.aqi for r in rows] == [100.0, 150.0, 50.0, None] and naive(rows[0].fetched_at) == dt.datetime(2023, 11, 14, 22, 13, 20)
    features = backfill_features(pollution, weather).orderBy("fetched_at").collect()
    assert len(features) == 3 and features[2].aqi_rolling_mean_6h == 100.0
    assert [r.temperature for r in features] == [20.0, None, None]
    assert [r.date.day for r in skipped_dates(pollution, "2023-11-13", "2023-11-16").orderBy("date").collect()] == [13, 16]


def test_csv_keeps_times_and_whole_numbers(spark, tmp_path):
    df = hourly(spark, 3).withColumn("fetched_at", F.col("fetched_at") + F.expr("INTERVAL '0.123456' SECOND")).withColumn("month", F.lit(8))
    tables.write_snapshot_csv(df, str(tmp_path / "a"))
    got = tables.read_snapshot_csv(spark, str(tmp_path / "a"))
    assert got.select("fetched_at", "city", "aqi", "month").exceptAll(df.select("fetched_at", "city", "aqi", "month")).count() == 0
    (tmp_path / "b.csv").write_text("city,month,fetched_at,aqi\nA,8.0,2026-08-18 15:15:00.5+00:00,\n")
    row = tables.read_snapshot_csv(spark, str(tmp_path / "b.csv")).first()
    assert (row.city, row.month, row.aqi, naive(row.fetched_at)) == ("A", 8, None, dt.datetime(2026, 8, 18, 15, 15, 0, 500000))


def files_by_day(path):
    return {d: sorted(f.name for f in path.glob(f"data/*/{d}/*.parquet")) for d in {p.name for p in path.glob("data/*/day=*")}}


def test_upsert_replaces_keys_and_touches_only_its_days(spark, tmp_path):
    path = tmp_path / "features"
    store.upsert_features(hourly(spark, 72), str(path))
    before = files_by_day(path)
    change = hourly(spark, 3, start="2026-01-02", value=lambda i: -1.0).unionByName(hourly(spark, 1, start="2026-01-02", city="B"))
    for _ in range(2):
        store.upsert_features(change, str(path))
    got = store.feature_table(spark, str(path)).read()
    assert got.count() == 73 and got.filter("aqi = -1").count() == 3
    after = files_by_day(path)
    assert sorted(d for d in before if before[d] == after[d]) == ["day=2026-01-01", "day=2026-01-03"]
    assert set(before["day=2026-01-02"]) < set(after["day=2026-01-02"])  # nothing was moved or written again


def test_unfinished_upsert_is_not_seen(spark, tmp_path):
    path = tmp_path / "features"
    table = store.feature_table(spark, str(path))
    table.upsert(hourly(spark, 24))
    left, _ = table._write(table.read().withColumn("aqi", F.lit(7.0)))
    assert table.read().filter("aqi = 7").count() == 0 and table.read().count() == 24
    table.vacuum(hours=1)
    assert (path / "data" / f"commit={left}").exists()  # it may belong to a running writer
    table.vacuum(hours=-1)
    assert not (path / "data" / f"commit={left}").exists() and table.read().count() == 24


def test_writers_at_the_same_time_all_land(spark, tmp_path):
    path = str(tmp_path / "features")
    one, two = (store.feature_table(spark, path) for _ in "ab")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda c: store.feature_table(spark, path).upsert(hourly(spark, 30, city=c)), "ABCD"))
    assert one.read().groupBy("city").count().filter("count = 30").count() == 4
    assert one._latest()[0] == 4

    # a writer that read manifest 4 and meets manifest 5 adds to it
    stale, commits = one._latest(), [one._write(hourly(spark, 1, city=c, value=lambda i: v).withColumn("day", F.to_date("fetched_at"))) for c, v in (("A", 8.0), ("B", 9.0))]
    assert one._manifests().claim("000000000005", json.dumps({**stale[1], "2026-01-01": [*stale[1]["2026-01-01"], commits[0][0]]}))
    assert not one._manifests().claim("000000000005", "{}")
    two._commit(lambda now: {**now, "2026-01-01": [*now["2026-01-01"], commits[1][0]]})
    assert {(r.city, r.aqi) for r in one.read().filter("aqi IN (8, 9)").select("city", "aqi").collect()} == {("A", 8.0), ("B", 9.0)}


def test_days_are_compacted(spark, tmp_path):
    path = tmp_path / "features"
    table = store.feature_table(spark, str(path))
    for i in range(store.MAX_FOLDERS + 2):
        table.upsert(hourly(spark, 2, start=f"2026-01-01 {i:02d}:00:00", value=lambda _: float(i)))
    assert len(table._latest()[1]["2026-01-01"]) == 2
    expected = [float(i) for i in range(store.MAX_FOLDERS + 2)]
    assert [r.aqi for r in table.read().orderBy("fetched_at").collect()] == [*expected, expected[-1]]
    held = table._latest()[1]["2026-01-01"]
    table.compact()
    table.vacuum(hours=-1)
    assert [p.name for p in (path / "data").glob("commit=*")] == [f"commit={table._latest()[1]['2026-01-01'][0]}"] and held != table._latest()[1]["2026-01-01"]
    assert table.read().count() == len(expected) + 1 and len(table._manifests().names()) == 1


def test_day_filters_reach_the_files(spark, tmp_path):
    path = str(tmp_path / "features")
    for v in (1.0, 2.0):
        store.upsert_features(hourly(spark, 72, value=lambda i: v), path)
    plan = store.feature_table(spark, path).read().filter("day = DATE '2026-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2026-01-02" in plan


def test_refusals_and_empty_upserts(spark, tmp_path):
    table = store.feature_table(spark, str(tmp_path / "t"))
    assert table.read().count() == 0 and table.days() == []
    table.upsert(hourly(spark, 0))
    assert not table.exists()
    with pytest.raises(ValueError, match="no key"):
        table.upsert(hourly(spark, 2).withColumn("fetched_at", F.lit(None).cast("timestamp")))
    assert not table.exists()
    (tmp_path / "plain" / "day=2026-01-01").mkdir(parents=True)
    with pytest.raises(ValueError, match="plain"):
        store.feature_table(spark, str(tmp_path / "plain")).read()


def test_a_rename_never_replaces(spark, tmp_path):
    folder = store.Folder(spark, str(tmp_path))
    for name, text in (("a", "1"), ("b", "2")):
        (tmp_path / name).write_text(text)
    at = lambda n: folder._hadoop.Path(f"file:{tmp_path}/{n}")
    assert not folder._renamed(at("a"), at("b")) and (tmp_path / "b").read_text() == "2"
    assert folder._renamed(at("a"), at("c")) and (tmp_path / "c").read_text() == "1"


def test_log_keeps_the_last_write(spark, tmp_path):
    path = str(tmp_path / "log")
    log = hourly(spark, 3).select("city", F.col("fetched_at").alias("forecast_timestamp"), F.col("aqi").alias("predicted_aqi"), F.lit(1.0).alias("actual_aqi"), F.lit("Ridge").alias("model_version"))
    store.upsert_prediction_log(log, path)
    twice = log.withColumn("seq", F.lit(1)).unionByName(log.withColumns({"seq": F.lit(2), "predicted_aqi": F.lit(0.0)}))
    store.upsert_prediction_log(twice, path, ["seq"])
    assert [r.predicted_aqi for r in store.prediction_log(spark, path).read().collect()] == [0.0] * 3


def test_versions(spark, tmp_path):
    path = str(tmp_path / "versions")
    for i, rmse in enumerate((20.0, 18.0, 19.0)):
        m = {"model_name": "Ridge", "rmse": rmse, "mae": 1.0, "r2": 0.5}
        assert versions.register_version(spark, path, "forecaster", m, None, at("2026-01-01") + dt.timedelta(days=i)) == i + 1
    table = versions.read_versions(spark, path)
    assert versions.latest_version(table).first()["rmse"] == 19.0
    assert versions.best_version(table).first()["version"] == 2
    assert [r.version for r in versions.numbered_versions(table.drop("version")).orderBy("created_at").collect()] == [1, 2, 3]


def test_versions_registered_at_the_same_time(spark, tmp_path):
    path = str(tmp_path / "versions")
    m = {"model_name": "Ridge", "rmse": 1.0, "mae": 1.0, "r2": 0.5}
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda i: versions.register_version(spark, path, "a/b", m, str(i), at("2026-01-01")), range(6)))
    assert sorted(numbers) == list(range(1, 7))
    stored = {(r.version, int(r.location)) for r in versions.read_versions(spark, path).collect()}
    assert stored == {(n, i) for i, n in enumerate(numbers)}
