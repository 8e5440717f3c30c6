"""Keyed tables: last write wins, append, newest rows, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hazeflow.schemas import KEYS


def keep_last(df: DataFrame, keys: list[str] = KEYS, order: list[str] | None = None) -> DataFrame:
    """One row per key, the one with the greatest `order` (ties by the other columns).

    Spark keeps one row per key of each input partition, so a key with many copies shrinks before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    rank = F.struct(*[F.col(c) for c in order or []], *[F.col(c) for c in rest if c not in (order or [])])
    best = Window.partitionBy(*keys).orderBy(rank.desc())
    return df.withColumn("_rank_in_key", F.row_number().over(best)).filter("_rank_in_key = 1").drop("_rank_in_key")


def append(existing: DataFrame, new: DataFrame, order: str = "_seq") -> DataFrame:
    """Existing rows, then new ones, told apart by `order` for `keep_last`."""
    return existing.withColumn(order, F.lit(0)).unionByName(new.withColumn(order, F.lit(1)), allowMissingColumns=True)


def upserted(existing: DataFrame, new: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return keep_last(append(existing, new), keys, ["_seq"]).drop("_seq")


def chronological(df: DataFrame, by: str = "fetched_at") -> DataFrame:
    """Sorted by city and time; a hash of the row spreads many rows of one instant."""
    return df.orderBy(*[c for c in ("city",) if c in df.columns], by, F.xxhash64(*df.columns))


def latest_row(df: DataFrame, by: str = "fetched_at") -> DataFrame:
    """Newest row of each city."""
    rest = [c for c in df.columns if c != "city"]
    rank = F.when(F.col(by).isNotNull(), F.struct(by, *[c for c in rest if c != by]))
    newest = df.groupBy("city").agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return newest.select(*[F.col(c) if c == "city" else F.col(f"_row.{c}") for c in df.columns])


def last_n(df: DataFrame, n: int, by: str = "fetched_at") -> DataFrame:
    """Last n rows of each city; Spark trims each input partition to n rows before the shuffle."""
    newest_first = Window.partitionBy("city").orderBy(F.desc(by), F.xxhash64(*df.columns))
    return df.withColumn("_rn", F.row_number().over(newest_first)).filter(F.col("_rn") <= n).drop("_rn")


def preview(df: DataFrame, n: int, by: list[str]) -> DataFrame:
    return df.orderBy(*by).limit(n)


def preview_rest(df: DataFrame, n: int) -> DataFrame:
    """How many rows a preview of n leaves out."""
    return df.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("remaining"))
