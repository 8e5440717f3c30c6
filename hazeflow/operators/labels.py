"""Forecast labels, chronological splits, fills and sequences.

Row-offset operators work on equal blocks of a global (city, time) order with copies of the
few rows past each edge, so neither a long series nor a dense stretch makes a big task.
They expect (city, fetched_at) to be unique, as it is in the stored tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazeflow.operators.keyed import keep_last
from hazeflow.operators.metrics import regression_metrics
from hazeflow.operators.ordering import (
    block_window,
    lay_out,
    order_index,
    own_rows,
    pick_positions,
    row_blocks,
    running_with_carry,
    same_series,
    value_counts,
)
from hazeflow.schemas import KEYS, LABEL

HORIZON = 72
LOOKBACK = 24


def label_name(horizon: int) -> str:
    return LABEL if horizon == HORIZON else f"target_aqi_{horizon}h"


def forecast_target(df: DataFrame, horizon: int = HORIZON, value: str = "aqi", mode: str = "row", lag: str | None = None) -> DataFrame:
    """Adds the value `horizon` rows later in the same city; rows without one are dropped.

    With gaps the row lies further away than `horizon` hours: `lag` names a column for the
    actual hours, and mode="time" takes the reading exactly `horizon` hours later instead.
    Needs unique (city, fetched_at).
    """
    name = label_name(horizon)
    kept = [c for c in df.columns if c != name]
    if mode == "time":
        ahead = df.select("city", (F.col("fetched_at") - F.expr(f"INTERVAL {horizon} HOURS")).alias("fetched_at"), F.col(value).alias(name))
        ahead = keep_last(ahead.filter(F.col(name).isNotNull()), KEYS)
        return df.select(*kept).join(ahead, KEYS).select(*kept, name)
    rows = row_blocks(order_index(df.select(*kept), KEYS), after=horizon)
    w = block_window(rows)
    there = same_series(w, ["city"], horizon)
    labelled = rows.withColumn(name, F.when(there, F.lead(value, horizon).over(w)))
    extra = []
    if lag:
        seconds = (F.unix_micros(F.lead("fetched_at", horizon).over(w)) - F.unix_micros("fetched_at")) / 1e6
        labelled, extra = labelled.withColumn(lag, F.when(there, seconds / 3600.0)), [lag]
    return own_rows(labelled).filter(F.col(name).isNotNull()).select(*kept, name, *extra)


def chrono_split(df: DataFrame, val_size: float = 0.15, test_size: float = 0.15) -> DataFrame:
    """Adds `split`: the earliest rows train, the latest test, in one order over all cities.

    Only (fetched_at, city) is ordered, to find the two rows where the parts begin; the table
    itself is labelled by comparison with them and not moved. Needs unique (city, fetched_at).
    """
    n = df.count()
    cuts = {"val": int(n * (1 - (val_size + test_size))), "test": int(n * (1 - test_size))}
    spark = df.sparkSession
    wanted = spark.createDataFrame([(0, p) for p in sorted(set(cuts.values())) if p < n], "_all int, _at long")
    timed = df.filter(F.col("fetched_at").isNotNull())  # rows without a time sort last
    keys = timed.select(F.lit(0).alias("_all"), F.struct("fetched_at", "city").alias("_key"))
    found = pick_positions(value_counts(keys, ["_all"], "_key"), ["_all"], "_key", F.broadcast(wanted), "_at")
    starts = {r["_at"]: (r["us"], r["city"]) for r in found.select("_at", F.unix_micros("_key.fetched_at").alias("us"), "_key.city").collect()}

    def before(cut: int) -> Column:
        if cut not in starts:
            return F.lit(True)
        us, city = starts[cut]
        here = F.unix_micros("fetched_at")
        # a null city comes first, as in the order
        lower = F.lit(False) if city is None else F.col("city").isNull() | (F.col("city") < city)
        return F.coalesce((here < us) | ((here == us) & lower), F.lit(False))

    label = F.when(before(cuts["val"]), "train")
    if cuts["val"] != cuts["test"]:
        label = label.when(before(cuts["test"]), "val")
    return df.withColumn("split", label.otherwise("test"))


def ffill_bfill(df: DataFrame, columns: list[str], series: list[str]) -> DataFrame:
    """Nearest earlier value, else nearest later one, within each series (such as split and city)."""
    laid = lay_out(df, [*series, "fetched_at"])
    run = running_with_carry(laid, series, forward=columns, backward=columns)
    filled = {c: F.coalesce(f"{c}__prev", f"{c}__next") for c in columns}
    return run.withColumns(filled).select(*df.columns)


def _with_full_window(df: DataFrame, series: list[str], lookback: int, drop_last: bool):
    rows = row_blocks(order_index(df, [*series, "fetched_at"]), before=lookback - 1, after=1 if drop_last else 0)
    w = block_window(rows)
    full = same_series(w, series, -(lookback - 1))
    if drop_last:
        full = full & same_series(w, series, 1)
    return rows.withColumn("_full", full), w


def make_sequences(
    df: DataFrame, features: list[str], series: list[str], lookback: int = LOOKBACK, label: str = LABEL, drop_last: bool = True
) -> DataFrame:
    """Arrays of `lookback` consecutive rows ending at each row, with that row's label.

    Training drops the last row of every series, serving keeps it.
    """
    rows, w = _with_full_window(df, series, lookback, drop_last)
    frame = w.rowsBetween(-(lookback - 1), 0)
    listed = rows.withColumn("sequence", F.collect_list(F.struct(*features)).over(frame))
    out = [*series, "fetched_at", *([label] if label in df.columns else []), "sequence"]
    return own_rows(listed).filter("_full").select(*out)


def sequence_persistence(df: DataFrame, series: list[str], lookback: int = LOOKBACK, label: str = LABEL) -> DataFrame:
    """Persistence metrics over the rows that end a training sequence."""
    slim = df.select(*series, "fetched_at", "aqi", label)
    rows, _ = _with_full_window(slim, series, lookback, True)
    return regression_metrics(own_rows(rows).filter("_full"), label, "aqi")
