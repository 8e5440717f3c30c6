"""Raw snapshots to the 25-column feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from hazeflow.functions import scalars as S
from hazeflow.functions.projections import conform_schema, nan_to_null
from hazeflow.operators.lookback import derived_features
from hazeflow.schemas import FEATURE_SCHEMA, MEASURES


def build_features(snapshots: DataFrame, keep: list[str] | None = None, **options) -> DataFrame:
    """Calendar, rolling, as-of and ratio features for every snapshot row.

    `fetched_at` may be a timestamp or ISO text. Text keeps its own wall clock for the calendar
    columns while the instant orders the series. `keep` names further columns to carry along;
    options go to `look_back`.
    """
    df = snapshots
    clock = F.col("fetched_at")
    if dict(df.dtypes)["fetched_at"] == "string":
        df = df.withColumn("_clock", S.wall_clock(clock)).withColumn("fetched_at", S.parse_ts(clock))
        clock = F.col("_clock")
    df = nan_to_null(df.withColumns({c: F.col(c).try_cast("double") for c in MEASURES if c in df.columns}))
    df = df.withColumns({c: F.lit(None).cast("double") for c in MEASURES if c not in df.columns})
    featured = derived_features(df, **options).withColumns(S.time_features(clock))
    kept = [f for f in featured.schema.fields if f.name in (keep or [])]
    return conform_schema(featured, StructType(FEATURE_SCHEMA.fields + kept))
