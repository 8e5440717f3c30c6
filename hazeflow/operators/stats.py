"""Correlations, trends and distributions behind the exploratory charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazeflow.functions import scalars as S
from hazeflow.operators.audit import QUARTILES
from hazeflow.operators.ordering import quantiles, value_counts
from hazeflow.schemas import LABEL, numeric_columns

# Groupings with few keys (hours, weekdays, months, seasons).
BOX_AXES = ["hour", "day_of_week", "month", "season"]


def _clean(c: str) -> Column:
    return S.nan_as_null(F.col(c).cast("double"))


def pearson(x: Column, y: Column) -> Column:
    """Pairwise-complete Pearson r; NULL where one side never varies."""
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x)))


def _correlations(df: DataFrame, xs: list[str], ys: list[str]) -> DataFrame:
    """Rows (x, y, r) for all pairs: one row per x column, one aggregate column per y."""
    sides = F.array(*[F.struct(F.lit(x).alias("x"), _clean(x).alias("_x")) for x in xs])
    spread = df.select(F.inline(sides), *[_clean(y).alias(f"_y{i}") for i, y in enumerate(ys)])
    wide = spread.groupBy("x").agg(*[pearson(F.col("_x"), F.col(f"_y{i}")).alias(f"_r{i}") for i in range(len(ys))])
    rows = F.array(*[F.struct(F.lit(y).alias("y"), F.col(f"_r{i}").alias("r")) for i, y in enumerate(ys)])
    return wide.select("x", F.inline(rows))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or numeric_columns(df.schema)
    return _correlations(df, columns, columns)


def top_correlated(df: DataFrame, n: int = 5, target: str = "aqi") -> DataFrame:
    """The n columns with the strongest correlation to `target`, with its sign."""
    others = [c for c in numeric_columns(df.schema) if c not in (target, LABEL)]
    rows = _correlations(df, others, [target]).select(F.col("x").alias("feature"), "r")
    ranked = rows.filter(F.col("r").isNotNull()).withColumn("magnitude", F.abs("r"))
    return ranked.orderBy(F.desc("magnitude"), "feature").limit(n)


def linear_trend(df: DataFrame, xs: list[str], y: str = "aqi") -> DataFrame:
    """Least-squares line of y on each x."""
    def fit(x):
        a, b = _clean(x), _clean(y)
        sxx, sxy, syy = F.regr_sxx(b, a), F.regr_sxy(b, a), F.regr_syy(b, a)
        slope = F.try_divide(sxy, sxx)
        return F.struct(
            F.lit(x).alias("x"),
            slope.alias("slope"),
            (F.regr_avgy(b, a) - slope * F.regr_avgx(b, a)).alias("intercept"),
            F.try_divide(sxy * sxy, sxx * syy).alias("r2"),
            F.regr_count(b, a).alias("n"),
        )

    one = df.agg(*[fit(x).alias(f"_t{i}") for i, x in enumerate(xs)])
    return one.select(F.inline(F.array(*[F.col(f"_t{i}") for i in range(len(xs))])))


def box_stats(df: DataFrame, by: str, value: str = "aqi") -> DataFrame:
    """Quartiles, mean, 1.5-IQR whiskers and outlier count per key of a calendar column."""
    if by not in BOX_AXES:
        raise ValueError(f"group by one of {BOX_AXES}")
    counts = value_counts(df.select(by, _clean(value).alias("_x")).filter(F.col(by).isNotNull()), [by], "_x")
    box = quantiles(counts, [by], "_x", QUARTILES)
    reach = (F.col("p75") - F.col("p25")) * 1.5
    fenced = box.withColumns({"_low": F.col("p25") - reach, "_high": F.col("p75") + reach})
    x, inside = F.col("_x"), (F.col("_x") >= F.col("_low")) & (F.col("_x") <= F.col("_high"))
    # at most 24 keys, see BOX_AXES
    return (
        counts.join(F.broadcast(fenced), by)
        .groupBy(by, "p25", "p50", "p75")
        .agg(
            F.sum("_copies").alias("n"),
            (F.sum(x * F.col("_copies")) / F.sum("_copies")).alias("mean"),
            F.min(F.when(inside, x)).alias("_lowest"),
            F.max(F.when(inside, x)).alias("_highest"),
            F.sum(F.when(inside, 0).otherwise(F.col("_copies"))).alias("outliers"),
        )
        .select(
            by,
            "n",
            "mean",
            "p25",
            "p50",
            "p75",
            F.least("_lowest", "p25").alias("whisker_low"),
            F.greatest("_highest", "p75").alias("whisker_high"),
            "outliers",
        )
    )


def histogram(df: DataFrame, width: float, value: str = "aqi") -> DataFrame:
    bin_start = F.floor(_clean(value) / width) * F.lit(float(width))
    return (
        df.filter(_clean(value).isNotNull())
        .groupBy(bin_start.alias("bin_start"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def season_axis(df: DataFrame) -> DataFrame:
    """One row naming the axis: month if several occur, else season, else a histogram."""
    seen = df.groupBy("month", "season").agg(F.count(F.lit(1)))
    counts = seen.agg(F.countDistinct("month").alias("months"), F.countDistinct("season").alias("seasons"))
    axis = F.when(F.col("months") > 1, "month").when(F.col("seasons") > 1, "season").otherwise("histogram")
    return counts.select("months", "seasons", axis.alias("axis"))


def seasonal_profile(df: DataFrame, width: float = 50.0) -> DataFrame:
    """Box statistics on the chosen axis, or the histogram."""
    axis = season_axis(df).first()["axis"]
    return histogram(df, width) if axis == "histogram" else box_stats(df, axis)


def exceedance_hours(df: DataFrame, levels=(150, 200, 300)) -> DataFrame:
    """Readings per city above each threshold line."""
    return df.groupBy("city").agg(*[F.count_if(S.exceeds(F.col("aqi"), v)).alias(f"above_{v}") for v in levels])
