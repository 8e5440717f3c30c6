import pytest
from pyspark.sql import functions as F

from conftest import at, naive
from hazeflow.functions import projections as P
from hazeflow.functions import scalars as S
from hazeflow.schemas import FEATURE_COLUMNS


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", expression(F.col("x"))).orderBy("i").collect()]


def test_pm25_index_at_band_edges(spark):
    values = [None, -5.0, 0.0, 12.0, 35.4, 55.4, 150.4, 250.4, 600.0, float("nan"), float("inf")]
    assert column(spark, values, "double", S.pm25_to_aqi) == [None, None, 0, 50, 100, 150, 200, 300, 500, None, 500]


def test_pm25_index_near_ties_keep_the_double_formula(spark):
    def expected(c):
        for lo, hi, il, ih in S.PM25_BANDS:
            if lo <= c <= hi:
                return float(round(((ih - il) / (hi - lo)) * (c - lo) + il))

    values = [i / 10 for i in range(0, 5005)]
    assert column(spark, values, "double", S.pm25_to_aqi) == [expected(c) for c in values]


@pytest.mark.parametrize(
    "aqi,category",
    [(None, "Unknown"), (float("nan"), "Unknown"), (-3.0, "Good"), (50.5, "Good"), (51.0, "Moderate"), (150.0, "Unhealthy for Sensitive Groups"),
     (150.6, "Unhealthy"), (200.4, "Unhealthy"), (300.0, "Very Unhealthy"), (301.0, "Hazardous")],
)
def test_category(spark, aqi, category):
    assert column(spark, [aqi], "double", S.aqi_category) == [category]


def test_colors(spark):
    assert column(spark, ["Good", "Hazardous", "else", None], "string", S.category_color) == ["#00e400", "#7e0023", "#cccccc", "#cccccc"]
    assert column(spark, ["Good", "Hazardous", "Unknown"], "string", S.light_text) == [False, True, False]


def test_parse_ts_reads_offsets_and_rejects_garbage(spark):
    texts = ["2026-07-31T14:30:00Z", "2026-07-31T23:30:00+05:00", "2026-07-31 10:00:00", "2026-07-31T10:00:00.250+0130", "not a time", "", None, "2026"]
    got = column(spark, texts, "string", lambda c: S.parse_ts(c).cast("timestamp_ntz"))
    assert [g and g.isoformat() for g in got] == [
        "2026-07-31T14:30:00", "2026-07-31T18:30:00", "2026-07-31T10:00:00", "2026-07-31T08:30:00.250000", None, None, None, None
    ]


def test_calendar_follows_the_written_clock(spark):
    texts = ["2026-07-31T14:30:00Z", "2026-07-31T23:30:00+05:00", "2026-08-01T00:10:00-03:00", "bad"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", *[c.alias(n) for n, c in S.time_features(S.wall_clock(F.col("t"))).items()]).orderBy("i").collect()
    assert tuple(rows[0])[1:] == (14, 4, 31, 7, 0, "summer")
    assert tuple(rows[1])[1:] == (23, 4, 31, 7, 0, "summer")
    assert tuple(rows[2])[1:] == (0, 5, 1, 8, 1, "summer")
    assert set(tuple(rows[3])[1:]) == {None}


def test_season_and_day_names(spark):
    assert column(spark, [12, 2, 3, 5, 6, 8, 9, 11, None], "int", S.season) == [
        "winter", "winter", "spring", "spring", "summer", "summer", "autumn", "autumn", None
    ]
    assert column(spark, [0, 6, 7, -1], "int", S.day_name) == ["Monday", "Sunday", "7", "-1"]


def test_ratio_guards(spark):
    df = spark.createDataFrame([(25.0, 50.0), (25.0, 0.0), (25.0, None), (None, 50.0), (1.0, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(S.pm_ratio(F.col("a"), F.col("b"))).collect()] == [0.5, None, None, None, 0.3333]


def test_conform_fills_and_drops(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00Z", "A", "-", "8.5", 1)], "fetched_at string, city string, aqi string, pm25 string, extra int")
    row = P.conform_schema(df).first()
    assert row.__fields__ == FEATURE_COLUMNS
    assert (naive(row.fetched_at).isoformat(), row.aqi, row.pm25, row.month) == ("2026-01-01T00:00:00", None, 8.5, None)


def test_projection_helpers(spark):
    df = spark.createDataFrame([(1.0, float("nan"), "3", True)], "aqi double, pm25 double, IS_IMPUTED_x string, temp_Outlier boolean")
    assert P.drop_leaky(df).columns == ["aqi", "pm25"]
    assert P.nan_to_null(df).first()["pm25"] is None
    assert P.model_matrix(df.withColumn("target_aqi_3d", F.lit(1.0))).columns == ["aqi", "pm25"]
    assert P.align_columns(df, ["pm25", "dew", "aqi"]).columns == ["pm25", "dew", "aqi"]


def test_recent_history_is_inclusive_and_ignores_case(spark):
    now = "2026-01-03 00:00:00"
    rows = [("Paris", at("2026-01-01T00:00:00")), ("PARIS", at("2026-01-02T23:00:00")), ("London", at("2026-01-02T23:00:00")), ("paris", at("2025-12-31T23:59:59"))]
    df = spark.createDataFrame(rows, "city string, fetched_at timestamp")
    assert sorted(r.city for r in P.recent_history(df, "paris", now).collect()) == ["PARIS", "Paris"]


def test_display_row(spark):
    df = spark.createDataFrame([("A", at("2026-08-18T15:05:00"), 101.5, "Moderate")], "city string, forecast_timestamp timestamp, predicted_aqi double, aqi_category string")
    row = P.display_row(df).first()
    assert (row.time, row.predicted_aqi, row.color, row.light_text) == ("Tue, Aug 18 - 03:05 PM", 102, "#ffff00", False)
