"""Landed snapshots to the stored feature table, one micro-batch at a time."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hazeflow.functions.projections import conform_schema
from hazeflow.operators.keyed import append, keep_last
from hazeflow.operators.lookback import PAST_24H, ROLLING_24H
from hazeflow.plans.features import build_features
from hazeflow.schemas import KEYS, SNAPSHOT_SCHEMA
from hazeflow.scratch import materialize
from hazeflow.sources.store import KeyedTable, feature_table

REACH_HOURS = max(PAST_24H.hours + PAST_24H.tolerance, ROLLING_24H.hours)
REACH_DAYS = 2  # calendar days a look-back of 26 hours can touch before its own


def _around(days: list, before: int, after: int) -> list:
    return sorted({d + timedelta(days=i) for d in days for i in range(-before, after + 1)})


def _after_late_rows(history: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored rows whose look-back may contain a row of the batch."""
    spans = batch.groupBy("city", F.to_date("fetched_at").alias("_d")).agg(
        F.min("fetched_at").alias("_from"), (F.max("fetched_at") + F.expr(f"INTERVAL {int(REACH_HOURS)} HOURS")).alias("_to")
    )
    spans = spans.withColumn("_day", F.explode(F.sequence("_d", F.date_add("_d", REACH_DAYS)))).drop("_d")
    keyed = history.withColumn("_day", F.to_date("fetched_at"))
    hit = (F.col("fetched_at") > F.col("_from")) & (F.col("fetched_at") <= F.col("_to"))
    return keyed.join(spans, ["city", "_day"]).filter(hit).select(*KEYS).distinct()


def add_readings(snapshots: DataFrame, table: KeyedTable, recompute_late: bool = False) -> None:
    """Features for new snapshots from the stored history, upserted.

    Stored rows are not recomputed when an older row arrives late, unless asked for.
    Delivering the same rows again changes nothing.
    """
    batch = materialize(keep_last(conform_schema(snapshots, SNAPSHOT_SCHEMA).filter(F.col("fetched_at").isNotNull())), "batch")
    days = [r["d"] for r in batch.select(F.to_date("fetched_at").alias("d")).distinct().collect()]
    if not days:
        return
    stored = table.read_days(_around(days, REACH_DAYS, REACH_DAYS if recompute_late else 0))
    history = stored.select(*SNAPSHOT_SCHEMA.fieldNames()).join(batch.select("city").distinct(), "city", "left_semi")
    if recompute_late:
        due = _after_late_rows(history, batch).withColumn("_due", F.lit(True))
        history = history.join(due, KEYS, "left")
    else:
        history = history.withColumn("_due", F.lit(None).cast("boolean"))
    rows = append(history, batch.withColumn("_due", F.lit(True)))
    rows = materialize(keep_last(rows, KEYS, ["_seq"]).drop("_seq"), "rows")  # the look-back reads them twice
    fresh = build_features(rows, keep=["_due"], unique=True).filter("_due").drop("_due")
    table.upsert(fresh)


def stream_features(
    spark: SparkSession,
    landing: str,
    table_path: str,
    checkpoint: str,
    schema: StructType = SNAPSHOT_SCHEMA,
    files_per_batch: int | None = None,
    recompute_late: bool = False,
) -> StreamingQuery:
    """Process everything landed since the last run, then stop."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def process(batch: DataFrame, _batch_id: int) -> None:
        add_readings(batch, feature_table(batch.sparkSession, table_path), recompute_late)

    return (
        reader.parquet(landing)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
