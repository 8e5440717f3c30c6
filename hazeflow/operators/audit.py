"""Completeness, coverage, gaps and distribution of a feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hazeflow.functions import scalars as S
from hazeflow.operators.ranks import column_quantiles
from hazeflow.scratch import discard, materialize
from hazeflow.schemas import float_columns, numeric_columns

ATTENTION_PCT = 30.0
# Columns shown first in the summary.
SUMMARY_FIRST = ["aqi", "target_aqi_3d", "pm25", "pm10", "temperature", "humidity"]
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}

_ERA_CELLS = 4096


def null_audit(df: DataFrame, threshold: float = ATTENTION_PCT) -> DataFrame:
    """Null count and share per column from one aggregate over the table."""
    floats = set(float_columns(df.schema))

    def missing(c):
        return F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull()

    counts = df.agg(
        F.count(F.lit(1)).alias("_total"), *[F.count_if(missing(c)).alias(f"_n{i}") for i, c in enumerate(df.columns)]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("null_count")) for i, c in enumerate(df.columns)])
    pct = S.round_exact(F.col("null_count") / F.col("_total") * 100.0, 2)
    return (
        counts.filter(F.col("_total") > 0)
        .select("_total", F.inline(rows))
        .select("column_name", "null_count", pct.alias("null_pct"))
        .withColumn("needs_attention", F.col("null_pct") > threshold)
    )


def coverage(df: DataFrame, cadence_hours: float = 1.0) -> DataFrame:
    """Rows against the slots expected between each city's first and last reading."""
    spans = df.groupBy("city").agg(
        F.count(F.lit(1)).alias("total_rows"), F.min("fetched_at").alias("start_at"), F.max("fetched_at").alias("end_at")
    )
    seconds = (F.unix_micros("end_at") - F.unix_micros("start_at")) / 1e6
    slots = F.floor(seconds / 3600.0 / cadence_hours) + 1
    share = S.round_exact(F.col("total_rows") / F.greatest(F.col("expected_slots"), F.lit(1)) * 100.0, 2)
    return spans.withColumn("expected_slots", slots).withColumn("completeness_pct", F.least(F.lit(100.0), share))


def find_gaps(df: DataFrame, cadence_hours: float = 1.0, threshold_hours: float = 1.5) -> DataFrame:
    """Consecutive readings of a city at least `threshold_hours` apart.

    Two such readings never share a time cell as wide as the threshold, so the first and last
    reading of each cell (aggregated map-side) are all that is shuffled. Cells are compared
    inside eras of many cells, and eras with their neighbours.
    """
    width = round(threshold_hours * S.HOUR_US)
    us = S.micros(F.col("fetched_at"))
    timed = df.filter(F.col("fetched_at").isNotNull()).select("city", us.alias("_us"))
    cells = (
        timed.groupBy("city", F.expr(f"(_us - pmod(_us, {width})) div {width}").alias("_cell"))
        .agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"))
        .withColumn("_era", F.expr(f"_cell div {_ERA_CELLS}"))
    )
    eras = cells.groupBy("city", "_era").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    inside = Window.partitionBy("city", "_era").orderBy("_cell")
    between = Window.partitionBy("city").orderBy("_era")
    steps = cells.select("city", F.lag("_last").over(inside).alias("_from"), F.col("_first").alias("_to")).unionByName(
        eras.select("city", F.lag("_last").over(between).alias("_from"), F.col("_first").alias("_to"))
    )
    hours = (F.col("_to") - F.col("_from")) / 1e6 / 3600.0
    slots = F.bround(S.round_exact(F.col("_hours") - cadence_hours, 1), 0).cast("int")
    return (
        steps.filter(F.col("_to") - F.col("_from") >= width)
        .withColumn("_hours", hours)
        .select(
            "city",
            F.timestamp_micros("_from").alias("gap_start"),
            F.timestamp_micros("_to").alias("gap_end"),
            S.round_exact(F.col("_hours"), 2).alias("gap_hours"),
            F.greatest(F.lit(1), slots).alias("missing_slots"),
        )
    )


def missing_dates(df: DataFrame, start: str, end: str) -> DataFrame:
    """Calendar dates from start to end, both included, on which a city has no reading."""
    seen = df.select("city", F.to_date("fetched_at").alias("date")).distinct()
    calendar = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    expected = seen.select("city").distinct().select("city", F.explode(calendar).alias("date"))
    return expected.join(seen, ["city", "date"], "left_anti")


def long_form(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """One (column_name, value) row per numeric cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*(keep or []), F.inline(cells))


def _one_pass_stats(df: DataFrame, shown: list[str], accuracy: int) -> DataFrame:
    """Summary rows from a single aggregate, quartiles approximate."""
    def stats(c):
        v = S.nan_as_null(F.col(c).cast("double"))
        q = F.percentile_approx(v, list(QUARTILES.values()), accuracy)
        return F.struct(
            F.lit(c).alias("column_name"),
            F.count(v).alias("count"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"),
            *[F.get(q, F.lit(i)).alias(name) for i, name in enumerate(QUARTILES)],
            F.max(v).alias("max"),
        )

    one = df.agg(*[stats(c).alias(f"_s{i}") for i, c in enumerate(shown)])
    return one.select(F.inline(F.array(*[F.col(f"_s{i}") for i in range(len(shown))])))


def _exact_stats(df: DataFrame, shown: list[str]) -> DataFrame:
    """Summary rows from one aggregate, with quartiles by rank selection."""
    def basic(c):
        v = S.nan_as_null(F.col(c).cast("double"))
        return F.struct(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))

    slim = materialize(df.select(*shown), "summary-columns")
    one = slim.agg(*[basic(c).alias(f"_s{i}") for i, c in enumerate(shown)]).first()
    found = column_quantiles(slim, QUARTILES, {c: s["count"] for c, s in zip(shown, one)})
    discard(slim)
    rows = [(c, s["count"], s["mean"], s["std"], s["min"], *(found.get(c, {}).get(name) for name in QUARTILES), s["max"]) for c, s in zip(shown, one)]
    quartiles = ", ".join(f"{name} double" for name in QUARTILES)
    return df.sparkSession.createDataFrame(rows, f"column_name string, count long, mean double, std double, min double, {quartiles}, max double")


def summary_stats(df: DataFrame, columns: list[str] | None = None, approximate: int | None = None) -> DataFrame:
    """Count, mean, deviation and quartiles of every numeric column, two decimals.

    Quartiles are exact and cost a few scans of a copy of the columns (`operators/ranks.py`); `approximate`
    names the accuracy of `percentile_approx` instead, which needs one pass and no copy.
    """
    columns = columns or numeric_columns(df.schema)
    shown = [c for c in SUMMARY_FIRST if c in columns] + [c for c in columns if c not in SUMMARY_FIRST]
    rows = _one_pass_stats(df, shown, approximate) if approximate else _exact_stats(df, shown)
    place = F.array_position(F.array(*[F.lit(c) for c in shown]), F.col("column_name")).cast("int")
    rounded = {c: F.rint(F.col(c) * 100) / 100 for c in ("mean", "std", "min", "p25", "p50", "p75", "max")}
    return rows.withColumns(rounded).select(
        place.alias("position"), "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )
