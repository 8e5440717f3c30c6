"""What the physical plans must and must not contain."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from conftest import hourly
from hazeflow.catalog.readings import readings_raw
from hazeflow.functions.projections import recent_history
from hazeflow.operators import audit, keyed, lookback, lookups
from hazeflow.plans.features import build_features
from hazeflow.sources import store

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def shuffles(text):
    tree = text.split("\n\n")[0]
    return len(re.findall(r"\bExchange\b", tree))


def test_features_take_one_shuffle_and_no_python(spark):
    df = hourly(spark, 48)
    path_df = df.withColumns({"pm25": F.lit(1.0), "pm10": F.lit(2.0)})
    text = plan(build_features(path_df, unique=True))
    assert shuffles(text) == 1
    assert "hashpartitioning(city" in text and "_bucket" in text
    assert "SinglePartition" not in text
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups", text)


def test_windows_share_one_layout(spark):
    """Both means need their spans in either direction; all sorts are local to the one layout."""
    text = plan(build_features(hourly(spark, 48), unique=True)).split("\n\n")[0]
    assert shuffles(text) == 1 and len(re.findall(r"\bSort\b", text)) <= 6


def test_scan_reads_only_what_the_query_needs(spark):
    text = plan(audit.coverage(readings_raw(spark, SF)))
    schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert schema == "ts:timestamp_ntz,event_type:string"


def test_recent_history_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "features")
    store.upsert_features(hourly(spark, 96), path)
    recent = recent_history(store.feature_table(spark, path).read(), "a", "2026-01-05 00:00:00", 24)
    text = plan(recent)
    assert re.search(r"PartitionFilters: \[.*day.*>=.*\]", text) and "PushedFilters: [" in text
    assert recent.count() == 24


def test_last_rows_are_trimmed_before_the_shuffle(spark):
    text = plan(keyed.last_n(readings_raw(spark, SF), 3)).split("\n\n")[0]
    assert len(re.findall(r"WindowGroupLimit", text)) == 2


def test_keep_last_limits_before_the_shuffle(spark):
    text = plan(keyed.keep_last(hourly(spark, 5))).split("\n\n")[0]
    assert [len(re.findall(r"\bWindowGroupLimit\b", text)), shuffles(text)] == [2, 1] and "SortAggregate" not in text


def test_gap_cells_are_aggregated_before_the_shuffle(spark):
    assert "SinglePartition" not in plan(audit.find_gaps(readings_raw(spark, SF)))


def test_no_cross_joins(spark):
    scored = readings_raw(spark, SF).withColumn("prediction", F.col("pm25"))
    for df in (lookups.forecast_horizons(scored), audit.missing_dates(scored, "2024-01-01", "2024-02-01"), lookback.asof_nearest(scored, 1, 0.5)):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
