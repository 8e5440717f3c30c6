import datetime as dt
import math

import pandas as pd
from pyspark.sql import functions as F

from conftest import at, hourly, naive
from hazeflow.operators import audit, keyed, lookups, stats


def series(spark, hours, city="A"):
    rows = [(at("2026-01-01") + dt.timedelta(hours=h), city, 50.0 * (i + 1)) for i, h in enumerate(hours)]
    return spark.createDataFrame(rows, "fetched_at timestamp, city string, aqi double")


def test_coverage_and_gap(spark):
    df = series(spark, [0, 1, 5, 6])
    row = audit.coverage(df).first()
    assert (row.total_rows, row.expected_slots, row.completeness_pct) == (4, 7, 57.14)
    (gap,) = audit.find_gaps(df).collect()
    assert (naive(gap.gap_start).hour, naive(gap.gap_end).hour, gap.gap_hours, gap.missing_slots) == (1, 5, 4.0, 3)


def test_gap_of_exactly_the_threshold_counts(spark):
    assert audit.find_gaps(series(spark, [0, 1.5, 2.5, 3.99])).count() == 1


def test_gaps_cross_eras_and_the_epoch(spark):
    rows = [(at("1969-12-31T23:20:00"), "A"), (at("1970-01-01T01:10:00"), "A"), (at("1999-01-01"), "A"), (at("1999-01-01T00:30:00"), "A"), (at("1999-01-01"), "B")]
    df = spark.createDataFrame(rows, "fetched_at timestamp, city string")
    assert sorted(g.gap_hours for g in audit.find_gaps(df).collect()) == [1.83, 254206.83]


def test_gaps_ignore_copies_and_match_a_plain_lag(scattered):
    hours = sorted({(i * 7919 % 3000) / 4 for i in range(400)})
    got = audit.find_gaps(series(scattered, hours + hours)).count()
    assert got == sum(b - a >= 1.5 for a, b in zip(hours, hours[1:]))


def test_null_audit_flags_above_thirty_percent(spark):
    rows = [(1.0, None, float("nan") if i < 3 else 1.0, None if i < 4 else "x") for i in range(10)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d string")
    got = {r.column_name: (r.null_count, r.null_pct, r.needs_attention) for r in audit.null_audit(df).collect()}
    assert got == {"a": (0, 0.0, False), "b": (10, 100.0, True), "c": (3, 30.0, False), "d": (4, 40.0, True)}
    assert audit.null_audit(df.limit(0)).count() == 0


def test_summary_stats(scattered):
    pdf = pd.DataFrame({"pm25": [1.0, 2.0, None, 7.5], "aqi": [50.0, 100.0, 150.0, 200.0], "month": [1, 1, 1, 1], "city": list("abcd"), "gone": [None] * 4})
    df = scattered.createDataFrame(pdf, "pm25 double, aqi double, month int, city string, gone double")
    rows = audit.summary_stats(df).orderBy("position").collect()
    assert [r.column_name for r in rows] == ["aqi", "pm25", "month", "gone"]
    expected = pdf[["aqi", "pm25", "month"]].describe().T.round(2)
    for r in rows[:3]:
        assert [r["count"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]] == expected.loc[r.column_name].tolist()
    assert (rows[3]["count"], rows[3]["mean"], rows[3]["p50"]) == (0, None, None)
    quick = audit.summary_stats(df, approximate=10000).orderBy("position").collect()
    assert [(r.column_name, r["count"], r["mean"], r["std"]) for r in quick] == [(r.column_name, r["count"], r["mean"], r["std"]) for r in rows]


def test_missing_dates(spark):
    df = series(spark, [0, 30, 100])
    got = audit.missing_dates(df, "2025-12-31", "2026-01-06").orderBy("date").collect()
    assert [r.date.day for r in got] == [31, 3, 4, 6]


def test_correlation_and_trend(spark):
    pdf = pd.DataFrame({"aqi": [1.0, 2.0, 3.0, 5.0, None], "pm25": [2.0, 4.1, None, 9.0, 1.0], "flat": [3.0] * 5})
    df = spark.createDataFrame(pdf, "aqi double, pm25 double, flat double")
    got = {(r.x, r.y): r.r for r in stats.correlation_matrix(df).collect()}
    expected = pdf.corr()
    for (x, y), r in got.items():
        e = expected.loc[x, y]
        assert (r is None) if math.isnan(e) else abs(r - e) < 1e-12, (x, y)
    assert [r.feature for r in stats.top_correlated(df).collect()] == ["pm25"]
    trend = {r.x: r for r in stats.linear_trend(df, ["pm25", "flat"]).collect()}
    assert trend["flat"].slope is None and trend["pm25"].n == 3


def test_box_whiskers_stop_at_the_box(spark):
    df = spark.createDataFrame([(1, v) for v in (0.0, 10.0, 10.0, 10.0)] + [(2, v) for v in (1.0, 2.0, 3.0, 4.0, 100.0)], "hour int, aqi double")
    one, two = stats.box_stats(df, "hour").orderBy("hour").collect()
    assert (one.p25, one.p75, one.whisker_low, one.whisker_high, one.outliers) == (7.5, 10.0, 7.5, 10.0, 1)
    assert (two.p50, two.whisker_low, two.whisker_high, two.outliers, two.mean) == (3.0, 1.0, 4.0, 1, 22.0)


def test_season_axis(spark):
    def axis(rows):
        return stats.season_axis(spark.createDataFrame(rows, "month int, season string")).first()["axis"]

    assert axis([(1, "winter"), (2, "winter")]) == "month"
    assert axis([(1, "winter"), (None, "spring")]) == "season"
    assert axis([(1, "winter"), (None, None)]) == "histogram"


def test_keyed_rows(spark):
    df = hourly(spark, 5).unionByName(hourly(spark, 2, city="B"))
    newest = {r.city: r.aqi for r in keyed.latest_row(df).collect()}
    assert newest == {"A": 104.0, "B": 101.0}
    assert keyed.last_n(df, 3).count() == 5
    writes = spark.createDataFrame([("A", 1, 5.0, 1), ("A", 1, 6.0, 3), ("A", 1, 7.0, 2)], "city string, fetched_at int, v double, seq int")
    assert keyed.keep_last(writes, order=["seq"]).first()["v"] == 6.0


def test_horizons_pick_the_nearest_row(spark):
    t = at("2026-01-10T00:30:00")
    rows = [(t, 1.0), (t - dt.timedelta(hours=10), 2.0), (t - dt.timedelta(hours=14), 3.0), (t - dt.timedelta(hours=24, minutes=121), 4.0), (t - dt.timedelta(hours=36), None)]
    scored = spark.createDataFrame([("A", a, p) for a, p in rows], "city string, fetched_at timestamp, prediction double")
    got = {(naive(r.forecast_timestamp) - naive(t)).total_seconds() / 3600: r.predicted_aqi for r in lookups.forecast_horizons(scored).collect()}
    assert got == {72: 1.0, 60: 3.0, 36: None}  # equally far: the earlier row; 121 minutes off: no row


def test_weather_joins_on_the_instant(spark):
    air = hourly(spark, 3).withColumns({c: F.lit(None).cast("double") for c in ("temperature", "humidity", "wind_speed", "pressure")})
    sky = hourly(spark, 2).select("city", "fetched_at", F.lit(20.0).alias("temperature"), F.lit(50.0).alias("humidity"), F.lit(1.0).alias("wind_speed"), F.lit(1000.0).alias("pressure"))
    got = lookups.attach_weather(air, sky.unionByName(sky)).orderBy("fetched_at").collect()
    assert [r.temperature for r in got] == [20.0, 20.0, None]
