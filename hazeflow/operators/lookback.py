"""Rolling means, as-of lookups and change rates over a bounded stretch of the past.

A city's series is cut into time buckets; each bucket also receives copies of the readings
its first rows look back to, so a big city spreads over many tasks with one shuffle. Inside a
bucket all frames start at a first row and only grow, which Spark evaluates in one pass. The
reading nearest to an instant is either the last one before it or that one's successor.

A window sum is never a difference of running sums, which one large value would spoil for all later
windows. Time is cut into spans as long as the window: a window then covers the end of one span and the
beginning of the next, so its sum is one sum up to the row plus one from the window's start on, and
only readings inside the window enter it. The result does not depend on the buckets.

Work per task is a city's readings in a bucket and the look-back before it. The width follows from the readings of the
densest city and day, the number of tasks from all readings, so that neither bucket nor task grows with the table until
a single day and its look-back have more than `BUCKET_ROWS`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazeflow.functions import scalars as S
from hazeflow.operators.keyed import keep_last
from hazeflow.schemas import KEYS

WIDTH_HOURS = 7 * 24
NARROWEST_HOURS = 21  # an eighth of a week; below it copies outnumber readings too much
BUCKET_ROWS = 1 << 17  # readings and copies of a bucket, beyond which it gets narrower
TASK_ROWS = 1 << 16  # readings and copies of an average task
STRAY_BUCKET = -(1 << 40)  # below any time bucket
MIN_POINTS = 3


@dataclass(frozen=True)
class RollingMean:
    """Mean of the readings in [t - hours, t], given at least three of them."""

    hours: float
    name: str

    @property
    def reach(self) -> int:
        return _us(self.hours)


@dataclass(frozen=True)
class RollingMax(RollingMean):
    """Greatest reading in [t - hours, t], however many there are."""


@dataclass(frozen=True)
class Nearest:
    """Reading nearest to t - hours, at most `tolerance` hours off; the older one on a tie."""

    hours: float
    tolerance: float
    name: str

    def __post_init__(self):
        if not 0 <= self.tolerance < self.hours:
            raise ValueError("tolerance must be smaller than the look-back")

    @property
    def reach(self) -> int:
        return _us(self.hours + self.tolerance)


ROLLING_6H = RollingMean(6, "aqi_rolling_mean_6h")
ROLLING_24H = RollingMean(24, "aqi_rolling_mean_24h")
PAST_1H = Nearest(1, 0.5, "past_1h")
PAST_24H = Nearest(24, 2, "past_24h")


def _us(hours: float) -> int:
    return round(hours * S.HOUR_US)


def _pick_nearest(spec: Nearest, us: Column, older: Column, newer: Column) -> Column:
    """Struct (us, value) of the nearer candidate within tolerance, else NULL."""
    target, tol = us - _us(spec.hours), _us(spec.tolerance)
    old_gap, new_gap = target - older["us"], newer["us"] - target
    old = F.when(old_gap <= tol, older)
    new = F.when(new_gap <= tol, newer)
    return F.when(old.isNotNull() & (new.isNull() | (old_gap <= new_gap)), old).otherwise(new)


def _finish_mean(total: Column, n: Column, current: Column) -> Column:
    return F.when(current.isNotNull() & (n >= MIN_POINTS), S.round_exact(total / n, 2))


def _base(df: DataFrame, value: str) -> DataFrame:
    us = S.micros(F.col("fetched_at"))
    v = F.when(us.isNotNull(), S.finite(F.col(value).cast("double")))
    return df.withColumn("_us", us).withColumn("_v", v)


def _layout(base: DataFrame, reach: int, width_hours: float | None) -> tuple[int, int | None]:
    """Width of a bucket in microseconds, and the number of tasks (None where few rows leave it to Spark)."""
    days = base.groupBy("city", F.expr(f"_us div {24 * S.HOUR_US}").alias("_day")).agg(F.count(F.lit(1)).alias("n"))
    dated = F.when(F.col("_day").isNotNull(), F.col("n"))
    total, densest = days.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(dated), F.lit(0))).first()
    hours = width_hours or WIDTH_HOURS
    while width_hours is None and hours > NARROWEST_HOURS and densest / 24 * (hours + reach / S.HOUR_US) > BUCKET_ROWS:
        hours /= 2
    width = round(hours * S.HOUR_US)
    copies = total * (1 + reach / width)
    return width, math.ceil(copies / TASK_ROWS) if copies > 4 * TASK_ROWS else None


def _spread(base: DataFrame, reach: int, width: int) -> DataFrame:
    """Rows, packed in `_row`, plus slim copies in the buckets whose first rows look back to them."""
    home = F.expr(f"_us div {width}")
    last = F.expr(f"(_us + {reach}) div {width}")
    # rows without a time have no past: spread them by content instead of by bucket
    stray = F.array(F.lit(STRAY_BUCKET) - F.pmod(F.xxhash64(*base.columns), F.lit(4096)))
    buckets = F.when(F.col("_us").isNotNull(), F.sequence(home, last)).otherwise(stray)
    out = base.withColumn("_bucket", F.explode(buckets)).withColumn(
        "_home", F.col("_us").isNull() | (F.col("_bucket") == home)
    )
    row = F.struct(*[F.col(c) for c in base.columns if c not in ("city", "_us", "_v")])
    return out.select("city", "_us", "_v", "_bucket", "_home", F.when(F.col("_home"), row).alias("_row"))


def _span_sums(rows: DataFrame, means: list[RollingMean]) -> DataFrame:
    """Adds, per row and mean, sum and count (or maximum) from the row's span's first reading on (`up`) and to its last one (`down`).

    Shorter spans that fill longer ones are ordered inside these, so that all share a sort in each direction.
    """
    spans = {s: F.expr(f"_us div {s.reach}") for s in means}
    rows = rows.withColumns({f"_span_{s.name}": at for s, at in spans.items()} | {f"_back_{s.name}": -at for s, at in spans.items()})
    by_reach = sorted(means, key=lambda s: -s.reach)
    for name, part, time in (("up", "_span", F.col("_us")), ("down", "_back", F.desc("_us"))):
        for s in by_reach:
            longer = [f"{part}_{m.name}" for m in by_reach if m.reach > s.reach and m.reach % s.reach == 0]
            shorter = [f"{part}_{m.name}" for m in by_reach if m.reach < s.reach and s.reach % m.reach == 0]
            w = Window.partitionBy("city", "_bucket", *longer, f"{part}_{s.name}").orderBy(*shorter, time)
            w = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
            if isinstance(s, RollingMax):
                found = [F.max("_v").over(w).alias("max")]
            else:
                found = [F.sum("_v").over(w).alias("sum"), F.count("_v").over(w).alias("n")]
            rows = rows.withColumn(f"_{name}_{s.name}", F.struct(*found))
    return rows.drop(*[f"_back_{s.name}" for s in means])


def _windows(spread: DataFrame, specs: list) -> DataFrame:
    w = Window.partitionBy("city", "_bucket").orderBy("_us")
    start = Window.unboundedPreceding
    over = "over (partition by city, _bucket order by _us)"
    means = [s for s in specs if isinstance(s, RollingMean)]
    columns = {}
    spread = _span_sums(spread, means)
    for s in means:
        edge = F.struct(F.col(f"_span_{s.name}").alias("span"), F.col(f"_down_{s.name}").alias("down"))
        # what a window holds of the span before its row's: the end of that span from the window's first reading on
        spread = spread.withColumn(f"_edge_{s.name}", edge)
        spread = spread.withColumn(f"_next_{s.name}", F.expr(f"lead(_edge_{s.name}, 1) {over}"))
        columns[f"_first_{s.name}"] = F.first(f"_edge_{s.name}").over(w.rangeBetween(start, 0))
        columns[f"_from_{s.name}"] = F.last(f"_next_{s.name}").over(w.rangeBetween(start, -s.reach - 1))
        columns[f"_older_{s.name}"] = F.count(F.lit(1)).over(w.rangeBetween(start, -s.reach - 1))
    if len(means) < len(specs):
        point = F.when(F.col("_v").isNotNull(), F.struct(F.col("_us").alias("us"), F.col("_v").alias("value")))
        spread = spread.withColumn("_pt", point)
        spread = spread.withColumn("_succ", F.expr(f"lead(_pt, 1) ignore nulls {over}"))
        spread = spread.withColumn("_pair", F.when(F.col("_pt").isNotNull(), F.struct("_pt", "_succ")))
        columns["_first"] = F.first("_pt", ignorenulls=True).over(w.rangeBetween(start, 0))
    for s in specs:
        if isinstance(s, Nearest):
            columns[f"_at_{s.name}"] = F.last("_pair", ignorenulls=True).over(w.rangeBetween(start, -_us(s.hours)))
    framed = spread.withColumns(columns).filter("_home")
    us, v = F.col("_us"), F.col("_v")
    finished = {}
    for s in specs:
        if isinstance(s, Nearest):
            pair = F.col(f"_at_{s.name}")
            newer = F.when(pair.isNull(), F.col("_first")).otherwise(pair["_succ"])
            # the first reading counts as "newer" only when it lies after the target instant
            finished[s.name] = _pick_nearest(s, us, pair["_pt"], newer)
        else:
            entry = F.when(F.col(f"_older_{s.name}") > 0, F.col(f"_from_{s.name}")).otherwise(F.col(f"_first_{s.name}"))
            before = F.when(entry["span"] < F.col(f"_span_{s.name}"), entry["down"])
            up, zero = F.col(f"_up_{s.name}"), F.lit(0)
            if isinstance(s, RollingMax):
                finished[s.name] = F.greatest(before["max"], up["max"])
                continue
            total = F.coalesce(before["sum"], F.lit(0.0)) + up["sum"]
            finished[s.name] = _finish_mean(total, F.coalesce(before["n"], zero) + up["n"], v)
    return framed.withColumns(finished)


def look_back(
    df: DataFrame,
    specs: list,
    value: str = "aqi",
    unique: bool = False,
    width_hours: float | None = None,
) -> DataFrame:
    """Add one column per spec: a mean, a maximum, or a struct (us, value) for the nearest reading.

    `unique=True` promises that (city, fetched_at) is a key; otherwise one row per key is kept,
    the greatest by its other columns. The result does not depend on `width_hours`; without it the density decides, which
    reads keys and times once.
    """
    reach = max(s.reach for s in specs)
    width, tasks = _layout(_base(df, value).select("city", "_us"), reach, width_hours)
    names = [s.name for s in specs]
    if not unique:
        # rows without a time are no copies of each other: keep them apart by content
        stray = F.when(F.col("fetched_at").isNull(), F.xxhash64(*df.columns))
        df = keep_last(df.withColumn("_stray", stray), [*KEYS, "_stray"]).drop("_stray")
    # laid out once; the windows over parts of a bucket need no other layout
    spread = _spread(_base(df, value), reach, width).repartition(*([tasks] if tasks else []), "city", "_bucket")
    row = [F.col("city") if c == "city" else F.col("_row")[c].alias(c) for c in df.columns]
    return _windows(spread, specs).select(*row, *names)


def rolling_mean(df: DataFrame, spec: RollingMean = ROLLING_6H, **options) -> DataFrame:
    return look_back(df, [spec], **options)


def asof_nearest(df: DataFrame, hours: float, tolerance: float, **options) -> DataFrame:
    """Adds `past_at` and `past_aqi`: the non-null reading nearest to `hours` ago."""
    spec = Nearest(hours, tolerance, "_near")
    found = look_back(df, [spec], **options)
    return found.withColumns(
        {"past_at": F.timestamp_micros(F.col("_near")["us"]), "past_aqi": F.col("_near")["value"]}
    ).drop("_near")


def rate(current: Column, past: Column) -> Column:
    """Relative change, 4 decimals; NULL without a positive past value."""
    return F.when(past > 0, S.round_exact((current - past) / past, 4))


def change_rate(df: DataFrame, spec: Nearest = PAST_1H, name: str = "aqi_change_rate_1h", **options) -> DataFrame:
    found = look_back(df, [spec], **options)
    return found.withColumn(name, rate(S.finite(F.col("aqi")), F.col(spec.name)["value"])).drop(spec.name)


def derived_features(df: DataFrame, **options) -> DataFrame:
    """Both change rates, both rolling means and the particle ratio from one shuffle and sort."""
    found = look_back(df, [ROLLING_6H, ROLLING_24H, PAST_1H, PAST_24H], **options)
    aqi = S.finite(F.col("aqi"))
    return found.withColumns(
        {
            "aqi_change_rate_1h": rate(aqi, F.col("past_1h")["value"]),
            "aqi_change_rate_24h": rate(aqi, F.col("past_24h")["value"]),
            "pm25_pm10_ratio": S.pm_ratio(S.nan_as_null(F.col("pm25")), S.nan_as_null(F.col("pm10"))),
        }
    ).drop("past_1h", "past_24h")


def derived_overlay(df: DataFrame, **options) -> DataFrame:
    """Raw index next to its smoothed forms, for checking the smoothing."""
    return derived_features(df, **options).select(
        "city", "fetched_at", "aqi", "aqi_rolling_mean_6h", "aqi_rolling_mean_24h", "aqi_change_rate_24h"
    )
