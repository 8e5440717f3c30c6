"""Positions in a global order, and what follows from them, without a single-task sort.

A global `orderBy` range-partitions on sampled bounds, so every partition gets a similar
share of the rows however the keys are spread. Numbering rows inside the partitions and
adding each partition's start gives exact positions; only one row per partition is ever
collected in one place.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazeflow.scratch import materialize

PART, POS = "_part", "_pos"
_TAG, _BLOCK, _OWN = "_tag", "_block", "_own"
_ROW_BITS = 33  # layout of monotonically_increasing_id: partition above, row number below

BLOCK_ROWS = 1 << 16


def lay_out(df: DataFrame, keys: list[str], unique: bool = False) -> DataFrame:
    """`df` in global key order, written once; `_part` and `_tag` say where each row lies.

    Unless the keys are `unique`, rows that share them are ordered by a hash of their content, so
    that they may fill several partitions and a lost task recomputes the same order. Exact copies
    stay together: collapse them first, as `keep_last` does.
    """
    ties = [] if unique else [F.xxhash64(*df.columns)]
    tagged = df.orderBy(*keys, *ties).withColumn(_TAG, F.monotonically_increasing_id())
    return materialize(tagged, "ordered").withColumn(PART, F.shiftright(_TAG, _ROW_BITS))


def add_positions(laid: DataFrame) -> DataFrame:
    """Zero-based `_pos` over the whole table; the broadcast side has one row per partition."""
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        laid.groupBy(PART)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(PART, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    row = F.col(_TAG).bitwiseAND((1 << _ROW_BITS) - 1)
    return laid.join(F.broadcast(starts), PART).withColumn(POS, F.col("_start") + row).drop("_start", _TAG)


def order_index(df: DataFrame, keys: list[str]) -> DataFrame:
    return add_positions(lay_out(df, keys))


def row_blocks(indexed: DataFrame, before: int = 0, after: int = 0, block: int = BLOCK_ROWS) -> DataFrame:
    """Equal blocks of positions, each with copies of the rows just before and after it."""
    first = F.expr(f"greatest({POS} - {int(after)}, 0) div {block}")
    last = F.expr(f"({POS} + {int(before)}) div {block}")
    return indexed.withColumn(_BLOCK, F.explode(F.sequence(first, last))).withColumn(
        _OWN, F.col(_BLOCK) == F.expr(f"{POS} div {block}")
    )


def block_window(rows: DataFrame):
    return Window.partitionBy(_BLOCK).orderBy(POS)


def own_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(_OWN).drop(_OWN, _BLOCK)


def same_series(window, series: list[str], offset: int) -> Column:
    """True where the row `offset` positions away exists and belongs to the same series."""
    move = F.lead if offset >= 0 else F.lag
    there = move(F.struct(*series), abs(offset)).over(window)
    return F.coalesce(there.eqNullSafe(F.struct(*series)), F.lit(False))


def running_with_carry(
    laid: DataFrame,
    series: list[str],
    totals: dict[str, Column] | None = None,
    forward: Iterable[str] = (),
    backward: Iterable[str] = (),
) -> DataFrame:
    """Running sums and nearest non-null values along each series of a laid-out table.

    `totals` maps an output name to the value summed from the series' start to the row.
    For each column in `forward`, `<c>__prev` is the latest non-null value at or before the
    row; for each in `backward`, `<c>__next` is the first non-null value after it.
    Each partition works on its own rows; what crosses a partition edge comes from a
    summary with one row per (partition, series).
    """
    totals, forward, backward = totals or {}, list(forward), list(backward)
    local = Window.partitionBy(PART, *series).orderBy(_TAG)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    pieces = [F.sum(v).alias(name) for name, v in totals.items()]
    pieces += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(_TAG))).alias(f"{c}__prev") for c in forward]
    pieces += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(_TAG))).alias(f"{c}__next") for c in backward]
    summary = laid.groupBy(PART, *series).agg(*pieces)

    along = Window.partitionBy(*series).orderBy(PART)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    over = f"over (partition by {', '.join(series)} order by {PART})"
    carry = summary.select(
        PART,
        *[F.col(s).alias(f"_k{i}") for i, s in enumerate(series)],
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}__in") for n in totals],
        *[F.last(f"{c}__prev", ignorenulls=True).over(before).alias(f"{c}__prev_in") for c in forward],
        *[F.expr(f"lead({c}__next, 1) ignore nulls {over}").alias(f"{c}__next_in") for c in backward],
    ).withColumnRenamed(PART, "_kp")

    over = f"over (partition by {', '.join([PART, *series])} order by {_TAG})"
    stepped = laid.withColumns(
        {
            **{f"{n}__run": F.coalesce(F.sum(v).over(upto), F.lit(0)) for n, v in totals.items()},
            **{f"{c}__prev": F.last(c, ignorenulls=True).over(upto) for c in forward},
            **{f"{c}__next": F.expr(f"lead({c}, 1) ignore nulls {over}") for c in backward},
        }
    )
    match = F.col(PART) == F.col("_kp")
    for i, s in enumerate(series):
        match = match & F.col(s).eqNullSafe(F.col(f"_k{i}"))
    joined = stepped.join(carry, match, "left")
    result = joined.withColumns(
        {
            **{n: F.col(f"{n}__run") + F.col(f"{n}__in") for n in totals},
            **{f"{c}__prev": F.coalesce(f"{c}__prev", f"{c}__prev_in") for c in forward},
            **{f"{c}__next": F.coalesce(f"{c}__next", f"{c}__next_in") for c in backward},
        }
    )
    return result.select(
        *laid.columns, *totals, *[f"{c}__prev" for c in forward], *[f"{c}__next" for c in backward]
    )


def value_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Non-null values of each group in order, equal ones counted in `_copies` before the shuffle."""
    present = df.filter(F.col(value).isNotNull()).select(*group, value)
    return lay_out(present.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_copies")), [*group, value], unique=True)


def pick_positions(counts: DataFrame, group: list[str], value: str, wanted: DataFrame, position: str) -> DataFrame:
    """The values at given zero-based positions of each sorted group.

    `counts` comes from `value_counts`; `wanted` has the group columns and a `position`
    column, a handful of rows per group. Only the partitions that hold a wanted position are
    numbered row by row.
    """
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        counts.groupBy(PART, *group)
        .agg(F.sum("_copies").alias("_span"))
        .withColumn("_lo", F.coalesce(F.sum("_span").over(earlier), F.lit(0)))
    )
    inside = (F.col(position) >= F.col("_lo")) & (F.col(position) < F.col("_lo") + F.col("_span"))
    targets = spans.join(wanted, group).filter(inside)
    holding = targets.select(PART, *group, "_lo").distinct()
    upto = Window.partitionBy(PART, *group).orderBy(_TAG).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = counts.join(holding, [PART, *group]).withColumn("_hi", F.col("_lo") + F.sum("_copies").over(upto))
    located = numbered.select(PART, *group, value, (F.col("_hi") - F.col("_copies")).alias("_from"), "_hi")
    at = (F.col(position) >= F.col("_from")) & (F.col(position) < F.col("_hi"))
    return targets.select(PART, *group, position).join(located, [PART, *group]).filter(at).select(*group, position, value)


def quantiles(counts: DataFrame, group: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per group, one column per point."""
    sizes = counts.groupBy(*group).agg(F.sum("_copies").alias("_n"))
    rank = F.struct(*[(F.lit(q) * (F.col("_n") - 1)).alias(name) for name, q in points.items()])
    ranks = sizes.select(*group, rank.alias("_rank"))
    needed = F.array(*[f(F.col(f"_rank.{name}")).cast("long") for name in points for f in (F.floor, F.ceil)])
    wanted = ranks.select(*group, F.explode(F.array_distinct(needed)).alias("_at"))
    found = pick_positions(counts, group, value, wanted, "_at")
    table = found.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_at", value))).alias("_found"))
    columns = []
    for name in points:
        r = F.col(f"_rank.{name}")
        low = F.element_at("_found", F.floor(r).cast("long"))
        high = F.element_at("_found", F.ceil(r).cast("long"))
        columns.append((low + (high - low) * (r - F.floor(r))).alias(name))
    return ranks.join(table, group).select(*group, *columns)
