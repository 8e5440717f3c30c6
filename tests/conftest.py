import datetime as dt

import pytest

from hazeflow import build_session, configure

UTC = dt.timezone.utc


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture
def scattered(spark):
    """Small tables keep several partitions, so what crosses their edges is exercised."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    configure(spark)


def at(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC)


def naive(value):
    """Collected timestamps as UTC wall time."""
    return value.astimezone(UTC).replace(tzinfo=None)


def hourly(spark, n, start="2026-01-01", city="A", value=lambda i: 100.0 + i, step=1.0):
    first = at(start)
    rows = [(first + dt.timedelta(hours=i * step), city, value(i)) for i in range(n)]
    return spark.createDataFrame(rows, "fetched_at timestamp, city string, aqi double")
