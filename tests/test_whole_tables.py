"""Catalogue queries read every event."""

import os
from types import SimpleNamespace

import pytest

from hazeflow.catalog import model_queries as M, registry
from hazeflow.catalog.readings import events

SF = os.environ.get("HAZEFLOW_TEST_SF", "/root/testdata/sf0.001")
QUERIES = registry.all_queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not present")


def _instants(spark):
    return events(spark, SF).select("event_type", "ts").distinct().count()


def test_forest_queries_search_on_all_events_each_time(spark, monkeypatch):
    prepared, searched = [], []
    prepare_parts = M.prepare_parts

    def counted(features):
        prepared.append(features.count())
        return prepare_parts(features)

    def search(*vectors):
        searched.append(vectors)
        return SimpleNamespace(errors={(10, 5): 1.0}, model=None)

    monkeypatch.setattr(M, "prepare_parts", counted)
    monkeypatch.setattr(M.R, "grid_forest", search)
    monkeypatch.setattr(M.R, "feature_importances", lambda model, names, spark: names)
    for name in ("m2_grid_forest", "m3_feature_importances"):
        QUERIES[name](spark, SF)
    assert len(searched) == 2 and min(prepared) >= _instants(spark)


def test_models_are_compared_on_all_events(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(M, "train", lambda features: SimpleNamespace(metrics=rows.append(features.count())))
    QUERIES["m5_compare_models"](spark, SF)
    assert rows[0] >= _instants(spark)


@pytest.mark.parametrize("name", ["so6_parse_weather_history_raw", "j1_attach_weather_raw"])
def test_history_queries_keep_every_city_and_second(spark, name):
    wanted = events(spark, SF).selectExpr("event_type AS city", "date_trunc('SECOND', cast(ts AS timestamp)) AS fetched_at").distinct()
    got = QUERIES[name](spark, SF).select("city", "fetched_at")
    assert got.count() == wanted.count() and not got.exceptAll(wanted).count()
