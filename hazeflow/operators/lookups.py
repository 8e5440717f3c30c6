"""Equi-joins between sources and the lookup behind the forecast horizons."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from hazeflow.functions import scalars as S
from hazeflow.operators.keyed import keep_last
from hazeflow.schemas import KEYS, WEATHER
from hazeflow.scratch import materialize

# Hours ahead that a forecast covers, and the tolerance for the row behind each.
HORIZONS = [12, 24, 36, 48, 60, 72]
HORIZON_TOLERANCE_HOURS = 2
MODEL_HORIZON = 72


def merge_snapshot(air: DataFrame, weather: DataFrame) -> DataFrame:
    """One row per landed city and time; a source that failed leaves its columns NULL.

    Give `air` with its failed payloads as rows without measures, so that their instants stay.
    Copies of a key collapse on either side first, so no key meets itself many times.
    """
    return keep_last(air, KEYS).join(keep_last(weather.select(*KEYS, *WEATHER), KEYS), KEYS, "full")


def attach_weather(pollution: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather of the same city and instant; NULL where there is none.

    Repeated weather rows count once, the last of them. Weather without a city serves all.
    """
    keys = [k for k in KEYS if k in weather.columns]
    base = pollution.drop(*WEATHER)
    joined = base.join(keep_last(weather.select(*keys, *WEATHER), keys), keys, "left")
    return joined.select(*base.columns, *WEATHER)


def forecast_horizons(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    """For each city's latest time T and each horizon h, the prediction made nearest to T-(72-h).

    Each wanted instant is spread over the hour cells its tolerance touches; joining on
    (city, hour cell) leaves the bulk of the history behind without gathering a city.
    """
    tol = HORIZON_TOLERANCE_HOURS * S.HOUR_US
    timed = scored.select("city", F.unix_micros("fetched_at").alias("_us"), F.col(prediction).alias("_p"))
    timed = timed.filter(F.col("_us").isNotNull())
    latest = timed.groupBy("city").agg(F.max("_us").alias("_latest"))
    horizons = F.explode(F.array(*[F.lit(h) for h in HORIZONS])).alias("_h")
    asked = latest.select("city", "_latest", horizons).withColumn(
        "_target", F.col("_latest") - (MODEL_HORIZON - F.col("_h")) * F.lit(S.HOUR_US)
    )
    cells = F.sequence(F.expr(f"(_target - {tol}) div {S.HOUR_US}"), F.expr(f"(_target + {tol}) div {S.HOUR_US}"))
    asked = asked.withColumn("_cell", F.explode(cells))
    rows = timed.withColumn("_cell", F.expr(f"_us div {S.HOUR_US}"))
    off = F.abs(F.col("_us") - F.col("_target"))
    near = rows.join(asked, ["city", "_cell"]).filter(off <= tol)
    best = near.groupBy("city", "_latest", "_h").agg(F.min_by(F.struct("_p"), F.struct(off, "_us", "_p")).alias("_best"))
    value = S.nan_as_null(F.col("_best._p").cast("double"))
    return best.select(
        "city",
        F.timestamp_micros(F.col("_latest") + F.col("_h") * F.lit(S.HOUR_US)).alias("forecast_timestamp"),
        value.alias("predicted_aqi"),
    )


CELL_BITS = 50  # the narrowest cells are this many halvings below the whole range, so that cell numbers stay exact


def band_join(df: DataFrame, value: str, bands: DataFrame, out: str = "band_index") -> DataFrame:
    """`df` with the index that a table of bands (low, high, index_low, index_high) gives to `value`, interpolated linearly.

    Both ends belong to a band. Where bands overlap, the one with the least `low` counts (ties: least `high`, then
    indices). NULL where no band holds the value. Bands with a missing bound or `low > high` hold nothing; a band of one
    point gives its `index_low`; infinite bounds are refused. Rows and columns of `df` stay as they are.

    A band lies in the at most two cells, as wide as the next power of two, that it reaches into; a row looks up its own cell at every
    width there is. So each width is an equi-join on unique cells, no row is copied, and a cell lists its own bands
    only: few, unless many bands of like widths overlap.
    """
    ends = ("low", "high", "index_low", "index_high")
    whole = bands.select(*[S.nan_as_null(F.col(c).cast("double")).alias(c) for c in ends]).dropna(subset=["low", "high"]).filter("low <= high").distinct()
    low, span = whole.agg(F.min("low"), F.max("high") - F.min("low")).first()
    if low is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    if not (math.isfinite(low) and math.isfinite(span)):
        raise ValueError("bands must end at finite values")
    least = math.ceil(math.log2(span)) - CELL_BITS if span else 0
    width = F.col("high") - F.col("low")
    level = F.greatest(F.when(width > 0, F.ceil(F.log2(width))).cast("int"), F.lit(least))
    levels = materialize(whole.withColumn("level", level), "bands")
    x = S.nan_as_null(F.col(f"`{value}`").cast("double"))

    def cell(c, k):
        return F.floor((c - F.lit(low)) / F.lit(2.0**k))

    found = df
    held = []
    for i, (k,) in enumerate(levels.select("level").distinct().orderBy("level").collect()):  # CELL_BITS + 1 at most
        own = levels.filter(F.col("level") == k)
        spread = own.select(F.explode(F.sequence(cell(F.col("low"), k), cell(F.col("high"), k))).alias(f"_cell{i}"), F.struct(*ends).alias("band"))
        listed = spread.groupBy(f"_cell{i}").agg(F.array_sort(F.collect_list("band")).alias(f"_bands{i}"))
        inside = (x >= F.lit(low)) & (x <= F.lit(low + span))
        found = found.join(listed, F.when(inside, cell(x, k)) == F.col(f"_cell{i}"), "left").drop(f"_cell{i}")
        first = F.get(F.filter(f"_bands{i}", lambda b: (x >= b["low"]) & (x <= b["high"])), F.lit(0))
        found = found.withColumn(f"_bands{i}", first)
        held.append(F.col(f"_bands{i}"))
    band = F.array_min(F.array_compact(F.array(*held)))
    slope = F.try_divide(band["index_high"] - band["index_low"], band["high"] - band["low"])
    index = F.when(band["low"] == band["high"], band["index_low"]).otherwise(slope * (x - band["low"]) + band["index_low"])
    return found.withColumn(out, index).select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)
