import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import at, hourly
from hazeflow.operators import lookback as L
from hazeflow.plans.features import build_features

DERIVED = ["aqi_change_rate_1h", "aqi_change_rate_24h", "aqi_rolling_mean_6h", "aqi_rolling_mean_24h"]


def brute_force(rows):
    """Straight from the definition: rows are (time, city, aqi) with unique keys."""
    out = {}
    for t, city, aqi in rows:
        past = sorted((h, v) for h, c, v in rows if c == city and v is not None and h < t)
        row = dict.fromkeys(DERIVED)
        if aqi is not None:
            for hours, name in ((6, "aqi_rolling_mean_6h"), (24, "aqi_rolling_mean_24h")):
                points = [v for h, v in past if t - h <= dt.timedelta(hours=hours)] + [aqi]
                if len(points) >= 3:
                    row[name] = round(sum(points) / len(points), 2)
            for hours, tol, name in ((1, 0.5, "aqi_change_rate_1h"), (24, 2, "aqi_change_rate_24h")):
                gaps = [(abs((t - h) - dt.timedelta(hours=hours)), v) for h, v in past]
                near = [g for g in gaps if g[0] <= dt.timedelta(hours=tol)]
                if near:
                    value = min(near, key=lambda g: g[0])[1]
                    if value > 0:
                        row[name] = round((aqi - value) / value, 4)
        out[(city, t)] = tuple(row[c] for c in DERIVED)
    return out


def collected(df):
    return {(r.city, r.us): tuple(r[c] for c in DERIVED) for r in df.withColumn("us", F.unix_micros("fetched_at")).collect()}


def by_micros(expected):
    return {(c, int(t.timestamp()) * 1_000_000 + t.microsecond): v for (c, t), v in expected.items()}


def random_rows(seed, n=300):
    rng = random.Random(seed)
    start, rows = at("2026-01-01"), {}
    for _ in range(n):
        city = rng.choice("AAAB")
        t = start + dt.timedelta(minutes=rng.choice([15, 30, 1]) * rng.randrange(4 * 24 * 5))
        rows[(t, city)] = rng.choice([None, 0.0, *[float(rng.randrange(1, 300)) for _ in range(8)]])
    return [(t, c, v) for (t, c), v in rows.items()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "fetched_at timestamp, city string, aqi double")


def test_worked_example(spark):
    now = at("2026-07-31T12:00:00")
    rows = [(now - dt.timedelta(hours=h), "A", v) for h, v in ((24, 50.0), (2, 60.0), (1, 80.0))]
    df = frame(spark, rows + [(now, "A", 100.0)]).withColumns({"pm25": F.lit(25.0), "pm10": F.lit(50.0)})
    row = build_features(df).filter(F.col("aqi") == 100).first()
    assert (row.aqi_change_rate_1h, row.aqi_change_rate_24h, row.aqi_rolling_mean_6h, row.aqi_rolling_mean_24h, row.pm25_pm10_ratio) == (0.25, 1.0, 80.0, 72.5, 0.5)
    assert (row.hour, row.day_of_week, row.season, row.target_aqi_3d) == (12, 4, "summer", None)


def test_no_history_and_missing_pm10(spark):
    row = build_features(frame(spark, [(at("2026-07-31T12:00:00"), "A", 100.0)]).withColumn("pm25", F.lit(25.0))).first()
    assert [row[c] for c in DERIVED] == [None] * 4 and row.pm25_pm10_ratio is None


def test_forms_agree_with_the_definition(scattered):
    for seed in range(3):
        rows = random_rows(seed)
        expected = by_micros(brute_force(rows))
        df = frame(scattered, rows)
        assert collected(L.derived_features(df.withColumns({"pm25": F.lit(1.0), "pm10": F.lit(1.0)}))) == expected
        assert collected(build_features(df, width_hours=5)) == expected  # look-backs cross many buckets
        assert collected(build_features(df, width_hours=24)) == expected


def test_large_values_spoil_only_their_windows(scattered):
    """Fractions around one reading of 1e17: every width gives the sums of the readings in the window."""
    rng = random.Random(4)
    start = at("2026-01-01")
    rows = [(start + dt.timedelta(minutes=20 * i), "A", 1e17 if i == 40 else rng.randrange(1, 3000) / 8) for i in range(300)]
    rows += [(start + dt.timedelta(hours=i), "B", 1e17 if i == 0 else 10.0 * i) for i in range(40)]
    spoilt = {(c, t) for c, big in (("A", rows[40][0]), ("B", start)) for t in (r[0] for r in rows) if dt.timedelta(0) <= t - big <= dt.timedelta(hours=26)}
    expected = brute_force(rows)
    for width in (5, 24, 168):
        got = collected(build_features(frame(scattered, rows), width_hours=width))
        exact = by_micros({k: v for k, v in expected.items() if k not in spoilt})
        assert {k: got[k] for k in exact} == exact
    worked = [(start, "A", 1e17)] + [(start + dt.timedelta(hours=h), "A", 10.0 * h) for h in range(1, 13)]
    means = {k[1]: v[2] for k, v in collected(build_features(frame(scattered, worked))).items()}
    at_hour = lambda h: means[int((start + dt.timedelta(hours=h)).timestamp()) * 1_000_000]
    assert (at_hour(7), at_hour(12)) == (40.0, 90.0)


def test_one_crowded_bucket_holds_most_rows(scattered):
    """A third of all rows within minutes of one city; the rest spread out."""
    rng = random.Random(9)
    start = at("2026-01-01")
    dense = {start + dt.timedelta(hours=30, seconds=rng.randrange(1800)): float(rng.randrange(1, 300)) for _ in range(250)}
    rows = [(t, "hot", v) for t, v in dense.items()] + [(start + dt.timedelta(hours=i), c, float(i + 1)) for c in ("hot", "cool", "mild") for i in range(60)]
    rows = list({(t, c): (t, c, v) for t, c, v in rows}.values())
    assert collected(build_features(frame(scattered, rows), width_hours=24)) == by_micros(brute_force(rows))


def test_tie_takes_the_older_reading(spark):
    t = at("2026-01-01T12:00:00")
    rows = [(t - dt.timedelta(minutes=75), "A", 50.0), (t - dt.timedelta(minutes=45), "A", 200.0), (t, "A", 100.0)]
    assert L.change_rate(frame(spark, rows)).filter("aqi = 100").first()["aqi_change_rate_1h"] == 1.0


def test_nearest_zero_gives_no_second_choice(spark):
    t = at("2026-01-01T12:00:00")
    rows = [(t - dt.timedelta(minutes=60), "A", 0.0), (t - dt.timedelta(minutes=70), "A", 50.0), (t, "A", 100.0)]
    assert L.change_rate(frame(spark, rows)).filter("aqi = 100").first()["aqi_change_rate_1h"] is None


def test_half_way_means_round_to_even(spark):
    values = [1.0] * 7 + [2.0]  # 1.125
    df = hourly(spark, 8, value=lambda i: values[i], step=0.5)
    assert L.rolling_mean(df).orderBy(F.desc("fetched_at")).first()["aqi_rolling_mean_6h"] == 1.12


def test_nan_counts_as_missing(spark):
    t = at("2026-01-01T12:00:00")
    rows = [(t - dt.timedelta(hours=h), "A", v) for h, v in ((3, 10.0), (2, float("nan")), (1, 20.0), (0, 30.0))]
    row = build_features(frame(spark, rows)).filter("aqi = 30").first()
    assert row.aqi_rolling_mean_6h == 20.0 and row.aqi_change_rate_1h == 0.5


def test_copies_count_once_and_rows_without_time_stay(spark):
    t = at("2026-01-01T12:00:00")
    rows = [(t - dt.timedelta(hours=1), "A", 10.0)] * 5 + [(t, "A", 30.0), (None, "A", 1.0), (None, "A", 2.0)]
    got = build_features(frame(spark, rows))
    assert got.count() == 4
    assert got.filter("aqi = 30").first()["aqi_rolling_mean_6h"] is None  # two points only
    assert got.filter("fetched_at IS NULL").select("hour", *DERIVED).distinct().collect() == [(None,) * 5]


def test_later_rows_never_change_a_feature(spark):
    rows = random_rows(5)
    cut = at("2026-01-04")
    early = [r for r in rows if r[0] < cut]
    whole = collected(build_features(frame(spark, rows)))
    for key, value in collected(build_features(frame(spark, early))).items():
        assert whole[key] == value


def test_text_times_keep_their_clock(spark):
    rows = [("2026-07-31T23:30:00+05:00", "A", 10.0), ("2026-07-31T17:30:00Z", "A", 5.0), ("junk", "A", 7.0)]
    df = spark.createDataFrame(rows, "fetched_at string, city string, aqi double")
    row = build_features(df).filter("aqi = 10").first()
    assert (row.hour, row.day_of_week, row.aqi_change_rate_1h) == (23, 4, 1.0)
    assert build_features(df).count() == 3


def test_dense_series_get_narrower_buckets_and_more_tasks(scattered, monkeypatch):
    """The rows of a task follow from the layout's bounds, not from the table; the results stay."""
    rows = random_rows(11, 900)
    expected = by_micros(brute_force(rows))
    monkeypatch.setattr(L, "BUCKET_ROWS", 300)
    monkeypatch.setattr(L, "TASK_ROWS", 100)
    df = frame(scattered, rows)
    width, tasks = L._layout(L._base(df, "aqi"), L.PAST_24H.reach, None)
    assert width == 21 * 3_600_000_000 and 15 <= tasks <= 30
    built = build_features(df, unique=True)
    assert built.rdd.getNumPartitions() == tasks and collected(built) == expected
    assert L._layout(L._base(df.limit(20), "aqi"), L.PAST_24H.reach, None) == (7 * 24 * 3_600_000_000, None)
    assert L._layout(L._base(df.limit(0), "aqi"), L.PAST_24H.reach, None)[1] is None


def test_greatest_reading_of_a_window(scattered):
    rows = random_rows(5)
    df = frame(scattered, rows)
    for width in (5, 168):
        found = L.look_back(df, [L.RollingMax(6, "top"), L.ROLLING_24H], width_hours=width, unique=True).collect()
        assert len(found) == len(rows)
        for r in found:
            times = [(h.timestamp(), v) for h, c, v in rows if c == r.city and v is not None]
            t = r.fetched_at.timestamp()
            assert r.top == max((v for h, v in times if t - 6 * 3600 <= h <= t), default=None)
