from pyspark.sql import functions as F

from conftest import hourly
from hazeflow.plans.features import build_features
from hazeflow.schemas import MEASURES
from hazeflow.sources.store import feature_table
from hazeflow.streaming.feature_stream import add_readings, stream_features


def snapshots(spark, n=60):
    df = hourly(spark, n, value=lambda i: float(50 + (i * 37) % 101)).unionByName(hourly(spark, n, city="B", step=1.5))
    return df.withColumns({c: F.lit(10.0) for c in MEASURES if c != "aqi"})


def same(a, b):
    columns = sorted(b.columns)
    a, b = a.select(columns), b.select(columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def run(spark, tmp_path, parts, **options):
    landing, table = str(tmp_path / "landing"), str(tmp_path / "table")
    for part in parts:
        part.write.mode("append").parquet(landing)
        stream_features(spark, landing, table, str(tmp_path / "progress"), **options).awaitTermination()
    return feature_table(spark, table).read().drop("day")


def test_stream_in_order_equals_batch(spark, tmp_path):
    rows = snapshots(spark)
    cut = F.lit("2026-01-02 10:00:00").cast("timestamp")
    got = run(spark, tmp_path, [rows.filter(F.col("fetched_at") < cut), rows.filter(F.col("fetched_at") >= cut)])
    assert same(got, build_features(rows))


def test_several_files_per_run_and_none(spark, tmp_path):
    rows = snapshots(spark, 20)
    got = run(spark, tmp_path, [rows.repartition(3)], files_per_batch=None)
    stream_features(spark, str(tmp_path / "landing"), str(tmp_path / "table"), str(tmp_path / "progress")).awaitTermination()
    assert same(got, build_features(rows))


def test_late_row_is_added_but_changes_no_stored_row(spark, tmp_path):
    rows = snapshots(spark, 30)
    late = (F.col("city") == "A") & (F.hour("fetched_at") == 5)
    table = feature_table(spark, str(tmp_path / "table"))
    add_readings(rows.filter(~late), table)
    before = table.read().drop("day").collect()
    add_readings(rows.filter(late), table)
    after = table.read().drop("day")
    assert same(after.filter(~late), spark.createDataFrame(before, after.schema))
    assert same(after.filter(late), build_features(rows).filter(late))


def test_late_row_with_recompute_equals_batch(spark, tmp_path):
    rows = snapshots(spark, 60)
    late = (F.col("city") == "A") & (F.hour("fetched_at") == 5)
    table = feature_table(spark, str(tmp_path / "table"))
    for part in (rows.filter(~late), rows.filter(late)):
        add_readings(part, table, recompute_late=True)
    assert same(table.read().drop("day"), build_features(rows))


def test_delivering_again_changes_nothing(spark, tmp_path):
    rows = snapshots(spark, 30)
    table = feature_table(spark, str(tmp_path / "table"))
    for _ in range(2):
        add_readings(rows, table)
    assert same(table.read().drop("day"), build_features(rows))
